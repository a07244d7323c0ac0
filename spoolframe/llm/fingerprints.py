"""Document fingerprints from closed syncmers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .shingles import mix

#: Bytes of a k-mer and of the substring whose least hash places it; one in (K - S + 1) / 2 k-mers is chosen.
K, S = 16, 9
#: Cells of a fingerprint, 16 bits each.
CELLS = 128
#: Most id ranges that documents are dealt into.
RANGE_ROWS = 4096
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MIXER = np.uint64(0x9E3779B97F4A7C15)


def _windows(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` bytes."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Doubling: the hash of 2m bytes is that of its halves, so log2(width) passes do.
    out, done, have, m = None, 0, _BYTE[data], 1
    for bit in range(width.bit_length()):
        if width >> bit & 1:
            part = have[done : done + n]
            out = part.copy() if out is None else out * _MIXER + (part ^ (part >> np.uint64(29)))
            done += m
        if width >> (bit + 1):
            have = have[:-m] * np.uint64(0xC2B2AE3D27D4EB4F) + (have[m:] ^ (have[m:] >> np.uint64(31)))
            m *= 2
    return mix(out)


def syncmers(data: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the closed syncmers of a text's UTF-8 bytes.

    A k-mer is one if the least of its s-mers is its first or last. That depends
    on the k-mer alone, so a passage has the same anchors wherever it stands. A
    text shorter than ``k`` bytes has one anchor, itself; an empty one none.
    """
    if len(data) < k:
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.zeros(1, np.int64), np.frombuffer(hashlib.blake2b(data.tobytes(), digest_size=8).digest(), np.uint64)
    small, span = _windows(data, s), k - s + 1
    n = len(data) - k + 1
    # Least of the s-mers inside: windows of span - 2 by doubling.
    inner, m, low = span - 2, 1, small
    while 2 * m <= inner:
        low = np.minimum(low[:-m], low[m:])
        m *= 2
    low = np.minimum(low[1 : n + 1], low[1 + inner - m : 1 + inner - m + n])
    edge = np.minimum(small[:n], small[span - 1 : span - 1 + n])
    at = np.flatnonzero(edge <= low)
    if not len(at):  # bounded texts may have none; their first k-mer stands in
        at = np.zeros(1, np.int64)
    return at, mix(small[at] * _MIXER + small[at + span - 1])


def sketch(hashes: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """The least anchor hash in each cell of the hash space, 16 bits of it; empty cells borrow from the next full one.

    Equal anchor sets give equal sketches, and the share of equal cells follows
    the Jaccard similarity of the sets. No anchors: an empty sketch.
    """
    if not len(hashes):
        return np.zeros(0, np.uint16)
    cell = (hashes >> np.uint64(40)).astype(np.int64) % cells
    value = np.full(cells, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(value, cell, hashes)
    full = np.flatnonzero(np.bincount(cell, minlength=cells))
    source = full[np.searchsorted(full, np.arange(cells)) % len(full)]
    far = (np.arange(cells) - source) % cells
    return (mix(value[source] + far.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def fingerprint(text: str) -> np.ndarray:
    return sketch(syncmers(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))[1])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal cells; two empty ones are alike, an empty one and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def hexed(a: np.ndarray) -> str:
    return a.astype(">u2").tobytes().hex()


def anchors(docs: DataFrame, k: int = K, s: int = S, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, starts, hashes)``: the anchors of each text, for positional matching; ``starts`` are byte offsets.

    Null and empty texts have none. Repeated rows and null ids are rows of their
    own; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                found = [syncmers(data[a:b], k, s) for a, b in zip(offsets[:-1], offsets[1:])]
                lists = pa.array(np.cumsum([0, *(len(x) for x, _ in found)]), pa.int32())
                columns = [np.concatenate([np.asarray(f[i]).view(np.int64) for f in found]) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.ListArray.from_arrays(lists, pa.array(c)) for c in columns)], names=["id", "starts", "hashes"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, starts array<long>, hashes array<long>").withColumnRenamed("id", id_col)


def _ranges(docs: DataFrame, id_col: str) -> list[int]:
    """Lower bounds of id ranges: at most ``RANGE_ROWS``, whatever the table's size."""
    spark = docs.sparkSession
    count = min(RANGE_ROWS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    got = docs.select(F.col(id_col).cast("long").alias("id")).agg(F.percentile_approx("id", [i / count for i in range(1, count)], 20 * count).alias("q")).first()
    return sorted(set(got["q"] or []))


def next_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of whole texts, of their edited texts, and likeness to both and to the next document.

    The edited text is the text with its last floor(n / 2) code points replaced
    by the first as many (or all) of the next document's in ascending id order;
    after the last comes the first. Columns: the id, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    Documents are dealt by id into ranges, sorted in each, and read as a stream,
    so a row's next is the next row. The first document of a range is sent to the
    range before it as well: one extra text per range. Null text counts as empty.
    A null id comes before all others. Repeated ids are ordered by their text; a
    single row is its own next. Other columns are ignored; an empty table gives
    an empty result.
    """
    bounds = _ranges(docs, id_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The range of an id: how many bounds it reaches. The bounds are at most RANGE_ROWS numbers.
    table = sorted(bounds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(table, np.int64)
        for b in batches:
            ids = b.column(0)
            at = np.searchsorted(edges, ids.fill_null(-(1 << 63)).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), *b.columns[1:]], names=["id", "range", *b.schema.names[1:]])

    narrow = source.select("id").mapInArrow(place, "id long, range int").groupBy("range").agg(F.min("id").alias("least"), F.max(F.col("id").isNull()).alias("none"), F.count("*").alias("n")).collect()
    present = sorted((r["range"], None if r["none"] else r["least"]) for r in narrow)
    goes = {least: present[i - 1][0] for i, (_, least) in enumerate(present)}  # the range before; of the first, the last

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(table, np.int64)
        firsts = np.array([x for x in goes if x is not None], np.int64)
        for b in batches:
            ids = b.column(0)
            at = np.searchsorted(edges, ids.fill_null(-(1 << 63)).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), pa.array(np.zeros(len(b), np.int8)), b.column(1)], names=["id", "range", "tail", "text"])
            known = np.isin(ids.fill_null(0).to_numpy(), firsts) & ids.is_valid().to_numpy(zero_copy_only=False)
            if None in goes:
                known |= ids.is_null().to_numpy(zero_copy_only=False)
            extra = b.filter(pa.array(known))
            if len(extra):
                to = pa.array([goes[x] for x in extra.column(0).to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([extra.column(0), to, pa.array(np.ones(len(extra), np.int8)), extra.column(1)], names=["id", "range", "tail", "text"])

    count = max(1, min(len(present), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = source.mapInArrow(deal, "id long, range int, tail byte, text string").repartition(count, "range").sortWithinPartitions("range", "tail", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 7
            rows.clear()
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for who, at, tail, text in zip(*(c.to_pylist() for c in batch.columns)):
                mark = fingerprint(text)
                if held is not None and held[1] == at and not held[2]:
                    half = len(held[3]) // 2
                    edited = held[3][: len(held[3]) - half] + text[:half]
                    print_ = fingerprint(edited)
                    rows.append((held[0], len(held[3]), hashlib.sha256(edited.encode()).hexdigest(), hexed(held[4]), hexed(print_), likeness(held[4], print_), likeness(held[4], mark)))
                held = (who, at, tail, text, mark)
            yield out()

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)
