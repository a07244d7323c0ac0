"""Word shingles of whole texts as sorted 64-bit sets, computed on byte arrays."""

from __future__ import annotations

import hashlib

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SIZE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64)
#: Bytes of a run that its key takes eight at a time; the keys of longer runs are digests of their bytes.
SHORT = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, with zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit key of each run of bytes, from its length and its bytes by eights; of runs over ``SHORT`` bytes a BLAKE2 digest."""
    eights = _eights(data)
    key = mix(lengths.astype(np.uint64) + _ODD)
    at, left, live = starts, lengths, None
    for _ in range(SHORT // 8):
        part = eights[at] & _FIRST[np.minimum(left, 8)]
        if live is None:
            key = mix(key * _ODD + part)
        else:
            key[live] = mix(key[live] * _ODD + part)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(lengths > SHORT).tolist():
        run = data[starts[i] : starts[i] + lengths[i]].tobytes()
        key[i] = int.from_bytes(hashlib.blake2b(run, digest_size=8).digest(), "little")
    return key


def strangers(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The runs whose bytes are not those of the run ``first`` of their code, byte for byte; none but where two keys meet."""
    model = first[codes]
    other = np.flatnonzero(model != np.arange(len(codes)))  # the first of a code is itself
    model = model[other]
    found = [other[lengths[other] != lengths[model]]]
    fine = lengths[other] == lengths[model]
    other, model = other[fine], model[fine]
    eights, at, to, left = _eights(data), starts[other], starts[model], lengths[other]
    for _ in range(SHORT // 8):
        mask = _FIRST[np.minimum(left, 8)]
        same = (eights[at] & mask) == (eights[to] & mask)
        found.append(other[~same])
        more = np.flatnonzero(same & (left > 8))
        if not len(more):
            break
        other, at, to, left = other[more], at[more] + 8, to[more] + 8, left[more] - 8
    else:
        for i, a, b, n in zip(other.tolist(), at.tolist(), to.tolist(), left.tolist()):
            if not np.array_equal(data[a : a + n], data[b : b + n]):
                found.append(np.array([i]))
    return np.concatenate(found)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each document).

    A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    start[heads] = inside[heads]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    # A word ends where white space or the next document begins.
    after = np.flatnonzero(~inside)
    stop = np.append(after, len(data))[np.searchsorted(after, starts)]
    lengths = np.minimum(stop, np.append(starts[1:], len(data))) - starts
    return word_keys(_LOWER[data], starts, lengths), np.searchsorted(starts, offsets)


def sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each document its sorted distinct shingle hashes.

    With fewer than ``width`` words the whole sequence is the one shingle; with
    none the set is empty.
    """
    hashes, before = words(data, offsets)
    full = max(len(hashes) - width + 1, 0)
    rolled = np.zeros(full, np.uint64)
    for i in range(width):
        rolled += hashes[i : i + full] * _PLACE[i]
    rolled = mix(rolled)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= width:
            x = np.sort(rolled[a : b - width + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x)
        elif b > a:
            out.append(mix((hashes[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _SIZE[b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
