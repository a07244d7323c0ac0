"""Smaller decisions of a library: capabilities, canvases, queues, archives' leftovers and extractor tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Type identifiers of picture formats, the first being the one that is written.
TYPE_IDS = {
    "heic": ["public.heic", "public.heif", "public.heic-image"],
    "heics": ["public.heics", "public.heif-sequence"],
    "avif": ["public.avif", "public.avci"],
    "jpeg": ["public.jpeg"],
    "png": ["public.png"],
    "tiff": ["public.tiff"],
    "gif": ["com.compuserve.gif"],
    "webp": ["org.webmproject.webp", "com.google.webp"],
    "jpegXL": ["public.jpeg-xl", "public.jxl"],
    "jp2": ["public.jpeg-2000", "public.jp2"],
    "pdf": ["com.adobe.pdf"],
}

#: States of a download that end it.
TERMINAL = ["finished", "failed", "cancelled"]


def format_of_type(identifier: Column) -> Column:
    """The picture format of a type identifier, without regard to case; null if none."""
    table = F.create_map(*(F.lit(x) for f, ids in TYPE_IDS.items() for i in ids for x in (i, f)))
    return table[F.lower(identifier)]


def capabilities(probed: Column, built_in: list[str]) -> Column:
    """Formats that can be written: those the system was found to write and those built in."""
    return F.array_sort(F.array_union(probed, F.array(*map(F.lit, built_in))))


def writable_type(fmt: Column, probed: Column) -> Column:
    """The identifier by which a format is written: its first one that the system was found to have."""
    table = F.create_map(*(x for f, ids in TYPE_IDS.items() for x in (F.lit(f), F.array(*map(F.lit, ids)))))
    return F.try_element_at(F.filter(table[fmt], lambda i: F.array_contains(probed, i)), F.lit(1))


def readable_formats(types: Column) -> Column:
    """Formats that can be decoded: those of which a type identifier, in any case, is among the system's ``types``."""
    found = F.transform(types, format_of_type)
    return F.array_sort(F.array_distinct(F.filter(found, lambda f: f.isNotNull())))


def digest_matches(content: Column, expected: Column) -> Column:
    """Whether bytes have a SHA-256 given in hex, in any case."""
    return F.sha2(content, 256) == F.lower(F.trim(expected))


def canvas(frames: DataFrame, key: str, rule: str = "first", width: int | None = None, height: int | None = None) -> DataFrame:
    """``(key, width, height, reason)`` of an animation's canvas from frames ``(key, pos, width, height)``.

    ``first`` takes the first frame's size, ``fixed`` a given one, ``uniform``
    asks that all frames have one size.
    """
    first = F.min_by(F.struct("width", "height"), "pos")
    got = frames.groupBy(key).agg(first.alias("f"), F.count_distinct("width", "height").alias("sizes"))
    if rule == "fixed":
        bad = width is None or height is None or width <= 0 or height <= 0
        w, h, reason = F.lit(width).cast("int"), F.lit(height).cast("int"), F.when(F.lit(bad), "the canvas has no size")
    elif rule in ("first", "uniform"):
        w, h = F.col("f.width"), F.col("f.height")
        reason = F.when(F.lit(rule == "uniform") & (F.col("sizes") > 1), "frames differ in size")
    else:
        raise ValueError(f"no canvas rule {rule!r}")
    return got.select(key, F.when(reason.isNull(), w).alias("width"), F.when(reason.isNull(), h).alias("height"), reason.alias("reason"))


def distinct_bytes(references: DataFrame, key: str, source: str, size: str) -> DataFrame:
    """Bytes of the distinct sources that each key refers to."""
    return references.groupBy(key, source).agg(F.max(size).alias(size)).groupBy(key).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def left_over(members: DataFrame, key: str, name: str, page: Column) -> DataFrame:
    """Names of an archive's members that are no pages, sorted: what an edit drops."""
    return members.groupBy(key).agg(F.sort_array(F.collect_list(F.when(~page, F.col(name)))).alias("dropped"))


def download_states(items: DataFrame, key: str, state: str) -> DataFrame:
    """Per key how many downloads are done and how many still wait."""
    done = F.col(state).isin(TERMINAL)
    return items.groupBy(key).agg(F.count_if(done).alias("finished"), F.count_if(~done).alias("pending"))


def pending(items: DataFrame, state: str) -> DataFrame:
    """Downloads that have not ended; these run."""
    return items.where(~F.coalesce(F.col(state).isin(TERMINAL), F.lit(False)))


def removal_order(paths: DataFrame, path: str) -> DataFrame:
    """Folders with the order in which they are removed: the longest path first."""
    return paths.withColumn("removal_key", F.struct((-F.length(path)).alias("length"), F.col(path).alias("path")))


def merged_clauses(rows: DataFrame, key: str, clauses: str, pos: str) -> DataFrame:
    """All version clauses on a key, each once, in the order that they first came."""
    each = rows.select(key, pos, F.posexplode(clauses).alias("i", "clause"))
    first = each.groupBy(key, "clause").agg(F.min(F.struct(pos, "i")).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "clause"))), lambda x: x["clause"]).alias(clauses))


def extractor_of(urls: DataFrame, patterns: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """URLs with the first extractor whose pattern they meet, or null; the pattern table is a constant of the query."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        out = F.when(F.col(url).rlike(pattern), F.lit(name)).otherwise(out)
    return urls.withColumn("extractor", out)


def chapters_supported(ext: Column) -> Column:
    """Null where a container holds chapters, else why it does not."""
    e = F.lower(ext)
    return F.when(e.isin("mp4", "m4a", "m4b", "m4v", "mov"), F.lit(None).cast("string")).when(e == "mp3", "chapters of this container are not written").otherwise("this container holds no chapters")


def first_locale(groups: DataFrame, key: str, locale_pos: str, rows: str) -> DataFrame:
    """The chapters of the first locale that has any: ``groups(key, locale_pos, rows)``."""
    return groups.where(F.size(rows) > 0).groupBy(key).agg(F.min_by(rows, locale_pos).alias(rows))


def rendition_json(columns: dict[str, Column]) -> Column:
    """A rendition as extractor JSON; a codec that is known to be absent is ``none``."""
    return F.to_json(F.struct(*(value.alias(name) for name, value in columns.items())))


def release_year(version: Column) -> Column:
    """The year that a dated version starts with, or null."""
    return F.substring(version, 1, 4).try_cast("int")
