"""Sum-of-squares online packing of token sequences into fixed windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokenizing import encoder

#: An open window with no more free tokens than this is left as it is when a task ends.
SPARE = 8
#: Tokens that open windows may hold before they are closed and packing starts anew; bounds a task's memory.
HELD_TOKENS = 4_000_000
#: Sequence numbers of a task start at its partition times this.
PER_TASK = 1 << 40

SCHEMA = "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Places pieces one at a time.

    ``level[h]`` counts open windows filled to ``h``. A piece of ``s`` tokens goes
    to the level (or a new window) that makes the sum of the squared counts least;
    ties go to the fullest. A window that is full leaves at once. Pieces that fit
    no open window, such as many of just over half a window, pile up; once open
    windows hold more than ``most`` tokens all are closed as at the end (see
    ``finish``), so memory is bounded.
    """

    def __init__(self, window: int, first: int = 0, most: int = HELD_TOKENS):
        self.window, self.sequence, self.most, self.held = window, first, most, 0
        self.level = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]

    def _close(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for piece in pieces:
            yield *piece[:3], piece[3], self.sequence, at, piece[4]
            at += piece[2]
        self.sequence += 1

    def add(self, who, start: int, ids: np.ndarray, tokens: int) -> Iterator[tuple]:
        w, s = self.window, len(ids)
        piece = [who, start, s, tokens, ids]
        if s == w:
            yield from self._close([piece])
            return
        gain = 2 * self.level[s : w + 1] + 1  # the level that the piece makes; a full window is not counted
        gain[-1] = 0
        gain[1:] -= 2 * self.level[1 : w - s + 1] - 1  # the level that it leaves; at 0 it opens a window
        gain[1:][self.level[1 : w - s + 1] == 0] = np.iinfo(np.int64).max
        best = len(gain) - 1 - int(np.argmin(gain[::-1]))
        pieces = self.open[best].pop() if best else []
        self.level[best] -= bool(best)
        pieces.append(piece)
        if best + s == w:
            self.held -= best
            yield from self._close(pieces)
        else:
            self.open[best + s].append(pieces)
            self.level[best + s] += 1
            self.held += s
            if self.held > self.most:
                yield from self.finish()

    def finish(self, spare: int = SPARE) -> Iterator[tuple]:
        """Closes what is open: nearly full windows as they are, the others cut anew.

        The others' pieces fill windows one after the other; what is left over is
        cut into powers of two, which need no padding.
        """
        rest: list[list] = []
        for h in range(self.window - 1, 0, -1):
            for pieces in self.open[h]:
                if self.window - h <= spare:
                    yield from self._close(pieces)
                else:
                    rest += pieces
            self.open[h] = []
        self.level[:], self.held = 0, 0
        left = sum(p[2] for p in rest)
        goal, batch, room = 0, [], 0
        for who, start, size, tokens, ids in rest:
            at = 0
            while at < size:
                if not room:
                    goal = room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                take = min(room, size - at)
                batch.append([who, start + at, take, tokens, ids[at : at + take]])
                at, room, left = at + take, room - take, left - take
                if not room:
                    yield from self._close(batch)
                    batch = []


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as pieces of sequences of at most ``window`` tokens, one row per piece.

    Columns: the id, ``start`` (the document's tokens before the piece),
    ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence (no gaps, from 0) and
    ``ids`` (little-endian 32-bit ids). Each token, ``end_id`` included, is in
    exactly one piece. Windows that a long document fills are sequences of their
    own; the rest of each document is packed whole by ``Packer``. When a task
    ends, or its open windows hold ``HELD_TOKENS``, they are cut anew (see
    ``Packer.finish``), the only place where a rest is cut. Sequences are of one task each, so nothing is
    shuffled, skew cannot arise, and a lost task is redone with the same numbers.

    Null and empty texts are their end token alone, or no piece without one.
    Repeated rows are packed each for itself. A null id stays null. Other columns
    are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_many
        packer = Packer(window, TaskContext.get().partitionId() * PER_TASK)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 7
            arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array([np.asarray(x, "<u4").tobytes() for x in columns[6]], pa.binary())]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                ids, bounds = encode(data, offsets)
                for k, who in enumerate(part.column(0).to_pylist()):
                    own = ids[bounds[k] : bounds[k + 1]]
                    own = np.append(own, np.uint32(end_id)) if end_id is not None else own.copy()
                    for at in range(0, len(own), window):
                        rows.extend(packer.add(who, at, own[at : at + window], len(own)))
                yield out()
        rows.extend(packer.finish())
        yield out()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)
