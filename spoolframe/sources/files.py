"""Files as rows, and rows out of files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions import media as M
from . import containers, documents, movies
from .containers import BadFile

#: Parser name -> (function, columns of a row).
PARSERS = {**containers.PARSERS, **movies.PARSERS, **documents.PARSERS}

#: Bytes that a file may have at most to be read; one value of a column holds no more.
MOST_BYTES = (1 << 31) - 1
#: Errors that bytes can raise in a parser beside ``BadFile``; each becomes the row's error.
#: ``BadFile`` is a ``ValueError``, and so are values that a column cannot hold.
UNREADABLE = (struct.error, IndexError, KeyError, OverflowError, RecursionError, ValueError, zlib.error)
#: Rows that are put together before they go back to Spark.
BATCH_ROWS = 2000
#: Bytes of files whose rows are put together.
BATCH_BYTES = 32 << 20


def reason(error: Exception) -> str:
    """What a row says of the file that could not be read."""
    return str(error) if isinstance(error, BadFile) else f"{type(error).__name__}: {error}"


def allowed_source(url: Column) -> Column:
    """Whether a URL may be read: file, or http(s) with a host."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (scheme == "file") | (scheme.isin("http", "https") & (F.regexp_extract(url, r"^[A-Za-z]+://([^/]+)", 1) != ""))


def read_files(spark: SparkSession, path: str, extensions: list[str] | None = None, most: int = MOST_BYTES, recursive: bool = False) -> DataFrame:
    """``path, modificationTime, length, content`` of the files of a folder that are not hidden and not too long.

    ``length`` is pushed into the scan, so longer files are never read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(sorted({*extensions, *(e.upper() for e in extensions)})) + "}")
    return reader.load(path).where((F.col("length") <= most) & ~M.last_component(F.col("path")).startswith("."))


def parse(files: DataFrame, parser: str, keep: list[str], content: str = "content") -> DataFrame:
    """Rows of a parser over a column of bytes: the ``keep`` columns, the parser's, and ``error``.

    A file that cannot be read gives one row with its error and nulls, so one bad
    file never stops a run. Null bytes give such a row too. Files are parsed where
    they are read; nothing is shuffled.
    """
    return _parsed(files, [parser], keep, content, StructType.fromDDL(PARSERS[parser][1]), False)


def parse_each(files: DataFrame, parsers: list[str], keep: list[str], content: str = "content") -> DataFrame:
    """Rows of several parsers in one pass over the bytes, which are made or read once: as ``parse`` of each, with ``parser``.

    A column that several parsers have is one, and is null in the rows of those that lack it.
    """
    columns: dict[str, StructField] = {}
    for parser in parsers:
        for c in StructType.fromDDL(PARSERS[parser][1]).fields:
            if columns.setdefault(c.name, c).dataType != c.dataType:
                raise ValueError(f"the parsers differ in the type of {c.name!r}")
    return _parsed(files, parsers, keep, content, StructType([*columns.values()]), True)


def _parsed(files: DataFrame, parsers: list[str], keep: list[str], content: str, columns: StructType, named: bool) -> DataFrame:
    functions = [(p, PARSERS[p][0]) for p in parsers]
    kept = files.select(*keep).schema
    out = StructType([*kept.fields, *columns.fields, *StructType.fromDDL(("parser string, " if named else "") + "error string").fields])
    shape = to_arrow_schema(out)

    def failed(own: dict, error: Exception) -> list[dict]:
        return [{**own, **dict.fromkeys(columns.names), "error": reason(error)}]

    def together(held: list[tuple[dict, list[dict]]]) -> Iterator[pa.RecordBatch]:
        """The rows of several files at once; file by file only where one has a value that its column cannot hold."""
        try:
            yield pa.RecordBatch.from_pylist([r for _, rows in held for r in rows], schema=shape)
            return
        except UNREADABLE:
            pass
        for own, rows in held:
            try:
                made = pa.RecordBatch.from_pylist(rows, schema=shape)
            except UNREADABLE as e:
                made = pa.RecordBatch.from_pylist(failed(own, e), schema=shape)
            yield made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, size = [], 0, 0
        for batch in batches:
            contents = batch.column(len(kept.names))
            for i, keys in enumerate(batch.select(kept.names).to_pylist()):
                data = contents[i].as_py()
                for name, function in functions:
                    own = {**keys, "parser": name} if named else keys
                    try:
                        if data is None:
                            raise BadFile("no bytes")
                        rows = [{**own, **r, "error": None} for r in function(data)]
                    except UNREADABLE as e:
                        rows = failed(own, e)
                    held.append((own, rows))
                    count += len(rows)
                size += len(data or b"")
                if count >= BATCH_ROWS or len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield from together(held)
                    held, count, size = [], 0, 0
        if held:
            yield from together(held)

    return files.select(*keep, content).mapInArrow(run, out)


def register_table_functions(spark: SparkSession) -> None:
    """The parsers as SQL table functions: ``SELECT * FROM zip_entries(content)``, with lateral joins.

    As in ``parse``, a file that cannot be read is one row of nulls with its ``error``.
    """
    from pyspark.sql.functions import udtf

    for name, (function, columns) in PARSERS.items():
        fields = StructType.fromDDL(columns).names

        class Parse:
            _function, _fields = staticmethod(function), fields

            def eval(self, content: bytes):
                try:
                    if content is None:
                        raise BadFile("no bytes")
                    rows = [(*(row[f] for f in self._fields), None) for row in self._function(content)]
                except UNREADABLE as e:
                    rows = [(*(None for _ in self._fields), reason(e))]
                yield from rows

        spark.udtf.register(name, udtf(Parse, returnType=f"{columns}, error string"))


def table_function_names() -> list[str]:
    """Names under which ``register_table_functions`` makes the parsers known."""
    return sorted(PARSERS)


def waves(rows: DataFrame, pcm: str, rate: str, channels: str, bits: str, out: str = "wave") -> DataFrame:
    """Rows with their samples as wave files; null where a value is missing or no layout fits."""

    @F.pandas_udf("binary")
    def made(samples: pd.Series, rates: pd.Series, counts: pd.Series, widths: pd.Series) -> pd.Series:
        fine = lambda *v: all(x is not None and x == x for x in v) and min(v[1:]) > 0
        return pd.Series([containers.wav_write(bytes(v[0]), *(int(x) for x in v[1:])) if fine(*v) else None for v in zip(samples, rates, counts, widths)], dtype=object)

    return rows.withColumn(out, made(pcm, rate, channels, bits))


def tagged(rows: DataFrame, content: str, items: str, out: str = "tagged") -> DataFrame:
    """ISO media files with the values of ``items`` (array of struct(key, value)) in place of their item list.

    ``out`` is struct(content, error); media bytes stay as they are. Files that
    cannot be edited, null ones among them, have their reason.
    """

    @F.pandas_udf("content binary, error string")
    def made(files: pd.Series, lists: pd.Series) -> pd.DataFrame:
        out = []
        for data, pairs in zip(files, lists):
            try:
                if data is None:
                    raise BadFile("no bytes")
                out.append((movies.with_items(data, [(p["key"], p["value"]) for p in (() if pairs is None else pairs)]), None))
            except UNREADABLE as e:
                out.append((None, reason(e)))
        return pd.DataFrame(out, columns=["content", "error"])

    return rows.withColumn(out, made(content, items))


def _by_key(rows: DataFrame, key: str) -> DataFrame:
    """Rows with those of a key in one task, in as many tasks as a shuffle has: small rows are not put together in a few, as files are made of them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _one_file(rows: DataFrame, key: str, order: str, columns: list[str], make: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """``(key, content, error)``: a file of each key's rows in order. A file is one value, so it is made in one task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        try:
            content, error = make(group.sort_values(order, kind="stable")), None
        except UNREADABLE as e:
            content, error = None, reason(e)
        return pd.DataFrame({key: [group[key].iloc[0]], "content": [content], "error": [error]})

    kept = rows.select(key, order, *columns)
    return _by_key(kept, key).groupBy(key).applyInPandas(run, f"{key} {kept.schema[key].dataType.simpleString()}, content binary, error string")


def pdf_books(pages: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """``(key, content, error)``: each key's pictures in order as the pages of a PDF."""
    return _one_file(pages, key, order, [content], lambda g: documents.pdf_write([bytes(x) for x in g[content]]))


def animations(frames: DataFrame, key: str, order: str, rgba: str, width: str, height: str, delay: str, kind: str = "apng", loops: int = 0) -> DataFrame:
    """``(key, content, error)``: each key's RGBA frames of one size in order as an animated PNG or GIF."""
    write = {"apng": documents.apng_write, "gif": documents.gif_write}[kind]
    return _one_file(frames, key, order, [rgba, width, height, delay], lambda g: write([bytes(x) for x in g[rgba]], int(g[width].iloc[0]), int(g[height].iloc[0]), [float(x) for x in g[delay]], loops))


def book(pages: DataFrame, key: str, order: str, name: str, content: str) -> DataFrame:
    """``(key, content)``: each key's pages as one stored ZIP in order. A book is one file, so it is made in one task."""

    def make(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        return pd.DataFrame({key: [group[key].iloc[0]], content: [containers.zip_write(list(zip(group[name], group[content])))]})

    kept = pages.select(key, order, name, content)
    return _by_key(kept, key).groupBy(key).applyInPandas(make, f"{key} {kept.schema[key].dataType.simpleString()}, {content} binary")
