"""The tokenizers library over whole texts, one library call per distinct word.

Both models cut a text into pre-tokens and encode each by itself, so a text's ids
are its pre-tokens' ids in a row. Most words of a corpus are repeats: pre-tokens
are found and hashed as arrays over many texts at once, and the library's model
encodes each distinct one. Keys only bring equal pre-tokens together: every one is
compared byte for byte with the one that stands for its key, and what is
remembered between texts is known by its bytes. A text with characters or
contractions outside the plain rules below, or with a pre-token whose key stands
for another, goes to the library whole, as its Unicode rules are its own.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from .shingles import strangers, word_keys

#: Distinct pre-tokens that a worker remembers before it starts over.
CACHE_WORDS = 600_000

# Byte classes: white space, letter, digit, other, and bytes that are not plain.
_WHITE, _LETTER, _DIGIT, _OTHER, _STRANGE = range(5)
_CLASS = np.full(256, _STRANGE, np.uint8)
_CLASS[[0x09, 0x0A, 0x0D, 0x20]] = _WHITE
_CLASS[0x21:0x7F] = _OTHER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[0x80:0xC0] = _LETTER  # second bytes
_CLASS[0xC3:0xC6] = _LETTER  # U+00C0 to U+017F, but for the ones here that are no letters or change length in lower case
_NOT_PLAIN = [(0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0), (0xC5, 0x89), (0xC5, 0xBF)]
_AFTER_QUOTE = np.zeros(256, bool)
_AFTER_QUOTE[list(b"sStTmMdDrRvVlL")] = True

# The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: (b if b in _SHOWN else 256 + sum(x not in _SHOWN for x in range(b))) for b in range(256)}


class Encoder:
    """Encodes texts to ids; equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocabulary = self.model.get_vocab_size()
        self.words = self.model.pre_tokenizer.__class__.__name__ != "ByteLevel"  # word model: white space dropped, lower case
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, word: bytes) -> int:
        text = word.decode("utf-8")
        text = (text.lower() if self.words else text).encode("utf-8").decode("latin-1").translate(_ALPHABET)
        ids = [t.id for t in self.model.model.tokenize(text)]
        at = len(self.slot)
        if at == len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[at], self.length[at] = self.used, len(ids)
        self.used += len(ids)
        self.slot[word] = at
        return at

    def _starts(self, data: np.ndarray, cls: np.ndarray, heads: np.ndarray) -> np.ndarray:
        start = np.ones(len(data), bool)
        start[1:] = cls[1:] != cls[:-1]
        if self.words:
            start |= cls == _DIGIT
            start[heads] = True
            return start
        start[heads] = True
        first = np.zeros(len(data), bool)
        first[heads] = True
        # Of white space before something else the last character stands alone, or leads the next word if it is a space.
        after = np.flatnonzero(start & (cls != _WHITE) & ~first)
        after = after[cls[after - 1] == _WHITE]
        start[after - 1] = True
        start[after[data[after - 1] == 0x20]] = False
        return start

    def encode_many(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, the offset of each text's ids) for UTF-8 bytes and text offsets."""
        count = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(count + 1, np.int64)
        cls = _CLASS[data]
        odd = cls == _STRANGE
        for a, b in _NOT_PLAIN:
            odd[:-1] |= (data[:-1] == a) & (data[1:] == b)
        odd[:-1] |= (data[:-1] == 0x27) & _AFTER_QUOTE[data[1:]]
        strange = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1)
        heads = offsets[:-1][np.diff(offsets) > 0]
        starts = np.flatnonzero(self._starts(data, cls, heads))
        lengths = np.diff(np.append(starts, len(data)))
        key = word_keys(data, starts, lengths)
        if self.words:
            keep = cls[starts] != _WHITE
            starts, lengths, key = starts[keep], lengths[keep], key[keep]
        codes, distinct = pd.factorize(key)
        first = np.zeros(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        other = starts[strangers(data, starts, lengths, codes, first)]
        strange = np.union1d(strange, np.searchsorted(offsets, other, side="right") - 1)
        if len(strange):  # their pre-tokens are not looked at
            at = np.searchsorted(offsets, starts, side="right") - 1
            keep = ~np.isin(at, strange)
            starts, lengths, key = starts[keep], lengths[keep], key[keep]
            codes, distinct = pd.factorize(key)
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
        if len(self.slot) + len(distinct) > CACHE_WORDS:
            self._clear()
        slots, get, raw = np.zeros(len(distinct), np.int64), self.slot.get, data.tobytes()
        lo = starts[first]
        for i, (a, b) in enumerate(zip(lo.tolist(), (lo + lengths[first]).tolist())):
            s = get(raw[a:b])
            slots[i] = self._learn(raw[a:b]) if s is None else s
        slot = slots[codes]
        size = self.length[slot]
        before = np.cumsum(size) - size
        total = int(size.sum())
        ids = self.pool[np.repeat(self.start[slot] - before, size) + np.arange(total)]
        ends = np.append(before, total)
        bounds = ends[np.searchsorted(starts, offsets)]
        if len(strange):
            parts, sizes, last = [], np.diff(bounds), 0
            for i in strange.tolist():
                own = np.array(self.model.encode(raw[offsets[i] : offsets[i + 1]].decode("utf-8"), add_special_tokens=False).ids, np.uint32)
                parts += [ids[last : bounds[i]], own]
                last, sizes[i] = bounds[i], len(own)
            ids = np.concatenate([*parts, ids[last:]])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
        return ids, bounds


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, made once and kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
