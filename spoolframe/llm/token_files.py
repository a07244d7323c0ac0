"""Token ids in fixed-width bit-packed files with block offsets."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, slices
from .tokenizing import encoder

MAGIC = b"SPTOKEN1"
#: Ids in a block; a block starts at a whole byte.
BLOCK = 8192
#: bits an id, ids a block, ids, documents, byte offset of the index, magic
FOOTER = struct.Struct("<IIQQQ8s")

# File layout: blocks | block byte offsets (u8 each) | doc ids (i8 each) | ends of documents in ids (u8 each) | footer.
# The footer comes last, so a file is written in one sequential pass.


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive little-endian fields of ``bits`` bits."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    rows = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(rows.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of a block."""
    if bits == 16:
        return np.frombuffer(data, "<u2", count).astype("<u4")
    rows = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    whole = np.zeros((count, 32), np.uint8)
    whole[:, :bits] = rows
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Writes one file block by block; memory is one block and the index."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits = sink, bits
        self.buffer, self.held = [], 0
        self.blocks, self.docs, self.ends = [], [], []
        self.count, self.at = 0, 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.buffer.append(ids)
        self.held += len(ids)
        self.count += len(ids)
        self.docs.append(doc_id)
        self.ends.append(self.count)
        if self.held >= BLOCK:
            ids = np.concatenate(self.buffer)
            whole = self.held - self.held % BLOCK
            for a in range(0, whole, BLOCK):
                self._block(ids[a : a + BLOCK])
            self.buffer, self.held = [ids[whole:]], self.held - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.blocks.append(self.at)
        self.at += len(data)
        self.sink.write(data)

    def close(self) -> None:
        """Writes the last block, the index and the footer."""
        if self.held:
            self._block(np.concatenate(self.buffer))
        index = np.array([*self.blocks, self.at], "<u8").tobytes() + np.array(self.docs, "<i8").tobytes() + np.array(self.ends, "<u8").tobytes()
        self.sink.write(index + FOOTER.pack(self.bits, BLOCK, self.count, len(self.docs), self.at, MAGIC))


class Reader:
    """Random access to one file: any range of ids costs the blocks that it touches."""

    def __init__(self, source):
        self.source = source
        self.bits, self.block, self.count, docs, at, magic = FOOTER.unpack(source.read_at(FOOTER.size, source.size() - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        n = -(-self.count // self.block) + 1
        index = source.read_at(8 * (n + 2 * docs), at)
        self.offsets = np.frombuffer(index, "<u8", n)
        self.docs = np.frombuffer(index, "<i8", docs, 8 * n)
        self.ends = np.frombuffer(index, "<u8", docs, 8 * (n + docs)).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        a = int(self.offsets[first])
        data = self.source.read_at(int(self.offsets[last + 1]) - a, a)
        parts = []
        for k in range(first, last + 1):
            lo, hi = int(self.offsets[k]) - a, int(self.offsets[k + 1]) - a
            parts.append(unpack_bits(data[lo:hi], self.bits, min(self.block, self.count - k * self.block)))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 2, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int, int]]:
    """Writes ids in ascending order of the document id; returns ``(file, first id, documents, ids)`` in order.

    Documents are range-partitioned by id and sorted, each partition streams one
    file, and each file is written under an attempt's name and then renamed, so a
    retried or doubled task leaves one whole file. ``folder`` must be one that
    all executors reach. The returned manifest has a row per file, not per
    document.

    Null and empty texts are their end token alone (no ids without one). Repeated
    ids are documents of their own, ordered by their text. Rows with a null id are
    left out, as the order has no place for them. Other columns are ignored; an
    empty table gives no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer)
        task = TaskContext.get()
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"{path}/tokens-{task.partitionId():06d}.bin"
        trial = f"{name}.{task.taskAttemptId()}"
        least, writer, body = None, None, None
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                ids, bounds = model.encode_many(data, offsets)
                for k, who in enumerate(part.column(0).to_pylist()):
                    if writer is None:
                        least, body = who, fs.open_output_stream(trial)
                        writer = Writer(body, bits_for(model.vocabulary))
                    own = ids[bounds[k] : bounds[k + 1]]
                    writer.add(who, np.append(own, np.uint32(end_id)) if end_id is not None else own)
        if writer is None:
            return
        writer.close()
        body.close()
        if fs.get_file_info(name).type != pafs.FileType.NotFound:  # some stores do not move onto a file
            fs.delete_file(name)
        fs.move(trial, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([least], pa.int64()), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.count], pa.int64())], names=["file", "least", "docs", "ids"])

    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(count, "id").sortWithinPartitions("id", "text")
    rows = ordered.mapInArrow(run, "file string, least long, docs long, ids long").collect()
    return [tuple(r) for r in sorted(rows, key=lambda r: r.least)]


def read_token_files(spark, manifest: list[tuple[str, int, int, int]], folder: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32[, ids])`` per document, read back from the files."""
    at, rows = 0, []
    for name, _, _, ids in manifest:
        rows.append((name, at))
        at += ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(name) as source:
                    reader = Reader(source)
                    k = 0
                    while k < len(reader.docs):
                        start = int(reader.ends[k - 1]) if k else 0
                        stop = max(k + 1, int(np.searchsorted(reader.ends, start + (1 << 19), side="right")))
                        ids = reader.ids(start, int(reader.ends[stop - 1]))
                        starts = np.concatenate([[start], reader.ends[k : stop - 1]])
                        raw = ids.astype("<u4").tobytes()
                        lo, hi = (starts - start).tolist(), (reader.ends[k:stop] - start).tolist()
                        own = [raw[4 * a : 4 * b] for a, b in zip(lo, hi)]
                        columns = [pa.array(reader.docs[k:stop]), pa.array(starts + base), pa.array(reader.ends[k:stop] - starts), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                        names = ["id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            columns, names = [*columns, pa.array(own, pa.binary())], [*names, "ids"]
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                        k = stop

    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    files = spark.createDataFrame(rows or [("", 0)], "file string, base long").where("file <> ''")
    return files.repartition(max(1, len(rows))).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Writes the files to a fresh folder in the shared one and reads them back (see the two functions)."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return read_token_files(spark, write_token_files(docs, tokenizer, folder, end_id, None, id_col, text_col), folder, id_col, with_ids)
