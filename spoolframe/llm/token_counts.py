"""Greedy word-piece lengths by a linear longest-match automaton."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .shingles import _SPACE, strangers, word_keys

#: Distinct words that a worker remembers before it starts over.
CACHE_WORDS = 1_000_000


class Automaton:
    """A vocabulary trie with failure links that count, not build, the pieces they pop.

    ``first`` are pieces that may open a word, ``rest`` those that may follow.
    ``fail[v]`` is where matching goes on when no edge of ``v`` fits, and
    ``popped[v]`` how many pieces greedy longest match has then finished. Every
    byte of a word is read once, so the time is linear in the word.
    """

    def __init__(self, first: set[bytes], rest: set[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]  # 0: start of a word, 1: after a piece
        self.end = [False, False]
        parent = [(-1, -1), (-1, -1)]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                v = root
                for b in piece:
                    to = self.next[v].get(b)
                    if to is None:
                        to = self.next[v][b] = len(self.next)
                        self.next.append({})
                        self.end.append(False)
                        parent.append((v, b))
                    v = to
                self.end[v] = v > 1
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        level = [v for root in (0, 1) for v in self.next[root].values()]
        while level:
            for v in level:
                up, b = parent[v]
                if self.end[v]:
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                z, n = self.fail[up], self.popped[up]
                while z >= 0 and b not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][b], n
            level = [w for v in level for w in self.next[v].values()]

    def count(self, word: bytes) -> int:
        """Pieces of a word, or -1 where greedy matching leaves a part unmatched."""
        nexts, fail, popped = self.next, self.fail, self.popped
        v, n = 0, 0
        for b in word:
            to = nexts[v].get(b)
            while to is None:
                n += popped[v]
                v = fail[v]
                if v < 0:
                    return -1
                to = nexts[v].get(b)
            v = to
        while v != 1:
            n += popped[v]
            v = fail[v]
            if v < 0:
                return -1
        return n


def byte_bpe_pieces(path: str) -> tuple[set[bytes], set[bytes]]:
    """Word-opening and following pieces of a byte-level vocabulary file.

    Pieces with a leading space open words; pieces without follow, and single bytes do both.
    """
    import json

    from .tokenizing import _ALPHABET

    back = {chr(c): b for b, c in _ALPHABET.items()}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    pieces = [bytes(back[c] for c in p) for p in vocabulary if all(c in back for c in p)]
    single = {bytes([b]) for b in range(256)}
    return {p[1:] for p in pieces if p[:1] == b" " and len(p) > 1} | single, {p for p in pieces if p[:1] != b" "} | single


_automata: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_tokens, n_unknown)`` per row: greedy word-piece lengths of whole texts.

    Words are runs of bytes other than 0x20 and 0x09-0x0D. A word that greedy
    matching cannot finish counts as one unknown token. The pieces of the file
    ``vocabulary`` (see ``byte_bpe_pieces``) are read by each worker once; a
    word's length is worked out once per run of texts. Words are brought together
    by a key and then compared byte for byte, so no two words are taken for one.

    Null and empty texts count zero. Repeated rows and null ids are rows of their
    own; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _automata:
            _automata[vocabulary] = Automaton(*byte_bpe_pieces(vocabulary)), {}
        machine, known = _automata[vocabulary]
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                starts, sizes, key = _words(data, offsets)
                codes, distinct = pd.factorize(key)
                if len(known) + len(distinct) > CACHE_WORDS:
                    known.clear()
                first = np.zeros(len(distinct), np.int64)
                first[codes[::-1]] = np.arange(len(codes))[::-1]
                raw, value = data.tobytes(), np.zeros(len(distinct), np.int64)

                def length(a: int, b: int) -> int:
                    n = known.get(raw[a:b])
                    if n is None:
                        n = known[raw[a:b]] = machine.count(raw[a:b])
                    return n

                for i, at in enumerate(first.tolist()):
                    value[i] = length(int(starts[at]), int(starts[at] + sizes[at]))
                each = value[codes] if len(codes) else np.zeros(0, np.int64)
                for at in strangers(data, starts, sizes, codes, first).tolist():  # a key that stands for another word
                    each[at] = length(int(starts[at]), int(starts[at] + sizes[at]))
                before = np.searchsorted(starts, offsets)
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[before])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.diff(before)), pa.array(total(np.where(each < 0, 1, each))), pa.array(total((each < 0).astype(np.int64)))],
                    names=["id", "n_words", "n_tokens", "n_unknown"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and hash of each word of the texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = ~_SPACE[data]
    start = np.ones(len(data), bool)
    start[1:] = inside[1:] != inside[:-1]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(start)
    sizes = np.diff(np.append(starts, len(data)))
    key = word_keys(data, starts, sizes)
    word = inside[starts]
    return starts[word], sizes[word], key[word]
