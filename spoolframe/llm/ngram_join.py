"""N-gram Jaccard self-join on a prefix tree, with classes of linked documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, components, join_counted, slices
from .shingles import mix, sets

#: Bits of the id filter that goes to every task; its size is fixed (1 MB).
FILTER_BITS = 1 << 23
#: Shingles that one prefix tree holds, about; larger blocks are dealt into chunks.
TREE_SHINGLES = 500_000
#: Sets, and shingles of sets, whose sketches are dealt as one chunk, about.
CHUNK_SETS, CHUNK_SHINGLES = 8192, 1 << 23
_SALT = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA5A3564E3C6F1B27, 0xC2B2AE3D27D4EB4F)]


def _digest(x: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit sums that stand for a whole set."""
    return tuple(int(mix(x ^ s).sum(dtype=np.uint64).astype(np.int64)) for s in _SALT[:2])


def _margin(n: int) -> int:
    """How many of its first steps a set must at least have in common with another."""
    return 1 + n // 25


def _steps(x: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first steps of a set, hashes of neighbours in the global order; steps are the edges of its path in a prefix tree.

    A shingle that only this set has breaks two of its steps, one that only the
    other has breaks one; linked sets lack so few that at most
    ``2 * n * (den - num) / den`` steps break. So each of two linked sets has at
    least the smaller one's ``_margin`` of these first steps in common with the
    other. Common shingles meet by chance, common steps hardly do.
    """
    most = 2 * len(x) * (den - num) // den
    front = x[: most + _margin(len(x)) + 1]
    return mix(front[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix(front[1:]))


def _size_class(n: int, num: int, den: int) -> tuple[int, int, int]:
    """(class, smallest and largest size in it): a linked pair is in one class or two neighbours."""
    c, low = 0, 1
    while low * den // num < n:
        low, c = low * den // num + 1, c + 1
    return c, low, low * den // num


def signatures(x: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of parts of a set such that two linked, unequal sets have one in common.

    In a size class whose linked pairs differ in at most D shingles the space of
    shingles is dealt into G > D/2 groups of three cells. Some group of a linked
    pair has one differing shingle at most, so two of its cells are equal. Pairs
    of cells that are both empty say nothing; G has a reserve of groups so that a
    set with few such groups need not name them, and a set with more names all.
    """
    n, out = len(x), []
    c, low, high = _size_class(n, num, den)
    for cls, top in ((c, high), (c + 1, (high + 1) * den // num)):
        if cls > c and n * den // num <= high:
            continue
        most = 2 * top * (den - num) // (den + num)
        if not most:
            continue
        base = most // 2 + 1
        groups = base + 2 + base // 8
        cell = (mix(x ^ _SALT[2]) % np.uint64(3 * groups)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cells, first = np.unique(cell[order], return_index=True)
        value = np.zeros(3 * groups, np.uint64)
        value[cells] = mix(np.add.reduceat(mix(x)[order], first))
        value = value.reshape(groups, 3)
        other = np.roll(value, -1, axis=1)
        empty = (value == 0) & (other == 0)
        tag = mix(np.arange(3 * groups, dtype=np.uint64) + np.uint64(cls * 1_000_003 + 7)).reshape(groups, 3)
        both = mix(mix(value + tag) + other * np.uint64(3))
        spare = groups - base
        out.append(both.ravel() if empty.any(axis=1).sum() > spare else both[~empty])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class PrefixTree:
    """Sets as ordered rank lists in a path-compressed trie, searched for links.

    Each node knows the smallest and largest set below it, the longest rest and
    whether all its sets are of one class. A search walks the tree once per set,
    so sets that share a path share its overlap count, and it leaves a subtree as
    soon as the rest cannot reach the overlap that its smallest set needs.
    """

    __slots__ = ("num", "den", "parent", "size", "root")

    def __init__(self, num: int, den: int, sizes: list[int]):
        self.num, self.den, self.size = num, den, sizes
        self.parent = list(range(len(sizes)))
        self.root: list | None = None

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    # A node: [ranks on its edge, children by first rank, sets that end here, min size, max size, longest rest, a set, mixed classes]
    def insert(self, ranks: list[int], who: int) -> None:
        n = self.size[who]
        node, at, total = self.root, 0, len(ranks)
        if node is None:
            node = self.root = [[], {}, [], n, n, 0, who, False]
        while True:
            node[3], node[4] = min(node[3], n), max(node[4], n)
            node[5] = max(node[5], total - at)
            if not node[7] and self.find(node[6]) != self.find(who):
                node[7] = True
            if at == total:
                node[2].append(who)
                return
            child = node[1].get(ranks[at])
            if child is None:
                node[1][ranks[at]] = [ranks[at:], {}, [who], n, n, 0, who, False]
                return
            edge, k = child[0], 1
            while k < len(edge) and at + k < total and edge[k] == ranks[at + k]:
                k += 1
            if k < len(edge):
                upper = [edge[:k], {edge[k]: child}, [], child[3], child[4], child[5] + len(edge) - k, child[6], child[7]]
                child[0] = edge[k:]
                node[1][ranks[at]] = child = upper
            node, at = child, at + k

    def search(self, ranks: list[int], who: int) -> Iterator[int]:
        """Sets in other classes that link with ``who``; the caller joins them as they come."""
        if self.root is None:
            return
        n, num, both, total = self.size[who], self.num, self.num + self.den, len(ranks)
        least, most = -(-n * num // self.den), n * self.den // num
        stack = [(self.root, 0, 0)]
        while stack:
            node, at, same = stack.pop()
            if node[4] < least or node[3] > most or not node[7] and self.find(node[6]) == self.find(who):
                continue
            need = -(-(n + max(node[3], least)) * num // both)
            edge, left = node[0], len(node[0]) + node[5]
            dead = False
            for r in edge:
                while at < total and ranks[at] < r:
                    at += 1
                if at < total and ranks[at] == r:
                    at, same = at + 1, same + 1
                left -= 1
                if same + min(total - at, left) < need:
                    dead = True
                    break
            if dead or same + min(total - at, node[5]) < need:
                continue
            for y in node[2]:
                if same * both >= (n + self.size[y]) * num and self.find(y) != self.find(who):
                    yield y
            later = ranks[at] if at < total else None
            for first, child in node[1].items():
                if first != later:
                    stack.append((child, at, same))
            if later is not None and later in node[1]:
                stack.append((node[1][later], at, same))


def links_within(members: list[np.ndarray], num: int, den: int, classes: list[int] | None = None, asked: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links that span the classes of ``members`` (distinct sets), as index pairs.

    Paths follow the one global order of shingles, that of their hashes. One that
    only a single set holds is a sure difference and on no path; sets with too
    many of them are out before the tree is built. Sets of one class of
    ``classes`` count as linked already; where ``asked`` is given, only links of
    the sets that it names are looked for.
    """
    if len(members) < 2:
        return []
    tokens, ranks, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    shared = count[ranks] > 1
    ends = np.cumsum([0, *(len(m) for m in members)])
    sizes, lists, waiting = [len(m) for m in members], {}, []
    for i, n in enumerate(sizes):
        span = slice(ends[i], ends[i + 1])
        own = ranks[span][shared[span]]
        if len(own) * den >= n * num:  # else no set can share enough with it
            lists[i] = own.tolist()
            waiting.append((asked is not None and asked[i], n - len(own), i))
    tree, found = PrefixTree(num, den, sizes), []
    if classes is not None:
        first: dict[int, int] = {}
        tree.parent = [first.setdefault(c, i) for i, c in enumerate(classes)]
    for late, _, i in sorted(waiting):
        if asked is None or late:
            for y in tree.search(lists[i], i):
                if tree.find(y) != tree.find(i):
                    tree.parent[max(tree.find(y), tree.find(i))] = min(tree.find(y), tree.find(i))
                    found.append((i, y))
        tree.insert(lists[i], i)
    return found


def sketch(x: np.ndarray) -> bytes:
    """For each of at least ``len(x)`` cells, a power of two, whether an odd number of the set's shingles is in it.

    Each shingle that only one of two sets has changes one cell, so sketches
    differ in no more cells than the sets in shingles. Half as many cells are the
    exclusive or of both halves.
    """
    cells = max(64, 1 << (len(x) - 1).bit_length())
    odd = np.bincount((mix(x ^ _SALT[1]) % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def near_sets(sizes: list[int], sketches: list[bytes], sides: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Index pairs that span the classes of sets whose sizes and sketches let them link; with two sides only pairs of both.

    Every linked pair is in one class. A row is compared with all smaller ones at
    once, from the least size that can link with it on.
    """
    order = np.argsort(sizes, kind="stable")
    n, side = np.array(sizes, np.int64)[order], np.array(sides)[order]
    rows = [np.frombuffer(sketches[i], "<u8") for i in order.tolist()]
    width, across = np.array([len(x) for x in rows]), len(set(sides)) > 1
    tables = {}
    for w, s in set(zip(width.tolist(), side.tolist())):
        at = np.flatnonzero((width == w) & (side == s))
        tables[w, s] = at, n[at], np.stack([rows[i] for i in at.tolist()])
    name, found = np.arange(len(rows)), []
    for i, x in enumerate(rows):
        least, hits = -(-int(n[i]) * num // den), []
        while True:
            table = tables.get((len(x), 1 - int(side[i]) if across else int(side[i])))
            if table is not None:
                at, size, cells = table
                a, z = np.searchsorted(size, least), np.searchsorted(at, i)
                both = size[a:z] + n[i]
                differ = np.bitwise_count(cells[a:z] ^ x).sum(axis=1, dtype=np.int64)
                hits.append(at[a:z][differ <= both - 2 * -(-both * num // (num + den))])
            if len(x) == 1:
                break
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        hit = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        names, first = np.unique(name[hit], return_index=True)
        for other, y in zip(names.tolist(), hit[first].tolist()):
            if other != name[i]:
                found.append((int(order[i]), int(order[y])))
                name[name == other] = name[i]
    return found


def _scan(id_col: str, text_col: str, width: int):
    """Per document: id, size and digests of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, text_col):
                found = sets(data, offsets, width)
                digests = [_digest(x) for x in found]
                columns = [rows.column(rows.schema.get_field_index(id_col)).cast(pa.int64()), pa.array([len(x) for x in found], pa.int64())]
                columns += [pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "d1", "d2"])

    return run


#: Steps that a task holds before it combines them; bounds its memory.
HELD_STEPS = 1_000_000
#: Lanes of a partition; one is held at a time.
LANES = 4
#: What a row of steps holds: steps with the set that each is of, steps that sets of one task share, and sets with how often they did.
_SINGLE, _SHARED, _COUNTED = range(3)


def _lane_bounds(lanes: int) -> np.ndarray:
    """Where each range of hashes begins; steps are hashes, so ranges of one width hold as many."""
    return np.array([(k << 64) // lanes for k in range(1, lanes)], np.uint64)


def _by_lane(keys: np.ndarray, values: np.ndarray | None, kind: int, bounds: np.ndarray) -> Iterator[tuple]:
    """(lane, kind, keys, values) with the bytes of each lane's part of rows that are sorted by key."""
    cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    for lane in np.flatnonzero(np.diff(cuts)).tolist():
        span = slice(cuts[lane], cuts[lane + 1])
        yield lane, kind, keys[span].tobytes(), b"" if values is None else values[span].tobytes()


_STEP_ROWS = "part int, lane int, kind int, a binary, b binary"


def _step_batches(rows: Iterator[tuple], at_once: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        lane, kind, a, b = zip(*held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x // LANES for x in lane], pa.int32()), pa.array(lane, pa.int32()), pa.array(kind, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["part", "lane", "kind", "a", "b"])

    for row in rows:
        held.append(row)
        if len(held) >= at_once:
            yield out()
    if held:
        yield out()


def _deal_steps(text_col: str, width: int, num: int, den: int, lanes: int):
    """Steps of the sets of a task, a row for each lane of them.

    A step that one set of the task has goes with the set's digest. Steps that
    sets of the task share are counted for those here, and go once without a set,
    so a common step costs a task one number.
    """
    bounds = _lane_bounds(lanes)

    def combine(steps: list[np.ndarray], owners: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        step = np.concatenate(steps)
        digest = np.repeat(np.array([d for d, _ in owners], np.int64).view(np.uint64), [n for _, n in owners])
        order = np.lexsort((digest, step))
        step, digest = step[order], digest[order]
        del order
        fresh = np.concatenate([[True], (step[1:] != step[:-1]) | (digest[1:] != digest[:-1])])  # copies of a set count once
        step, digest = step[fresh], digest[fresh]
        twin = step[1:] == step[:-1]
        shared = np.concatenate([[False], twin]) | np.concatenate([twin, [False]])
        yield from _step_batches(_by_lane(step[~shared], digest[~shared], _SINGLE, bounds))
        yield from _step_batches(_by_lane(np.unique(step[shared]), None, _SHARED, bounds))
        who, hits = np.unique(digest[shared], return_counts=True)
        yield from _step_batches(_by_lane(who, hits.astype(np.int64), _COUNTED, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, owners, held = [], [], 0
        for batch in batches:
            for _, data, offsets in slices(batch, text_col):
                for x in sets(data, offsets, width):
                    got = _steps(x, num, den)
                    if len(got):
                        steps.append(got)
                        owners.append((_digest(x)[0], len(got)))
                        held += len(got)
                if held > HELD_STEPS:
                    yield from combine(steps, owners)
                    steps, owners, held = [], [], 0
        if held:
            yield from combine(steps, owners)

    return run


def _lanes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes, bytes]]]]:
    """(lane, its rows) one after the other, of rows sorted by lane."""
    now, rows = None, []
    for batch in batches:
        for lane, kind, a, b in zip(*(c.to_pylist() for c in batch.columns[1:])):
            if lane != now and rows:
                yield now, rows
                rows = []
            now = lane
            rows.append((kind, a, b))
    if rows:
        yield now, rows


def _joined(rows: list[tuple[int, bytes, bytes]], kind: int, column: int, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows if r[0] == kind), dtype)


def _count_steps(lanes: int):
    """Where all rows of a lane's steps are: how many steps of each digest more than one set has; counts made before are passed on.

    The counts are rows by lanes of the digests, so what is sent does not grow
    with the partitions that a set's steps are spread over.
    """
    bounds = _lane_bounds(lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lane, rows in _lanes_of(batches):
            yield from _step_batches((lane, _COUNTED, a, b) for kind, a, b in rows if kind == _COUNTED)
            single, common = _joined(rows, _SINGLE, 1, np.uint64), _joined(rows, _SHARED, 1, np.uint64)
            digest = _joined(rows, _SINGLE, 2, np.uint64)
            rows.clear()
            order = np.lexsort((digest, single))
            step, digest = single[order], digest[order]
            if not len(step):
                continue
            fresh = np.concatenate([[True], (step[1:] != step[:-1]) | (digest[1:] != digest[:-1])])
            step, digest = step[fresh], digest[fresh]
            twin = step[1:] == step[:-1]
            met = np.concatenate([[False], twin]) | np.concatenate([twin, [False]]) | np.isin(step, common)
            who, hits = np.unique(digest[met], return_counts=True)
            yield from _step_batches(_by_lane(who, hits.astype(np.int64), _SINGLE, bounds))

    return run


def _sum_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per digest of a lane: the most counted in one task plus all that was counted after."""
    for _, rows in _lanes_of(batches):
        here, after = _joined(rows, _COUNTED, 1, np.int64), _joined(rows, _SINGLE, 1, np.int64)
        names, at = np.unique(np.concatenate([here, after]), return_inverse=True)
        most, total = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        np.maximum.at(most, at[: len(here)], _joined(rows, _COUNTED, 2, np.int64))
        np.add.at(total, at[len(here) :], _joined(rows, _SINGLE, 2, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(most + total)], names=["digest", "hits"])


def _rescan(id_col: str, text_col: str, width: int, wanted):
    """The sets of documents that the id filter lets through, with their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64())
            slot = (mix(ids.fill_null(0).to_numpy().astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7) & 1).astype(bool)))
            for rows, data, offsets in slices(batch, text_col):
                found = sets(data, offsets, width)
                digests = [_digest(x) for x in found]
                columns = [rows.column(rows.schema.get_field_index(id_col)).cast(pa.int64())] + [pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "d1", "d2", "tokens"])

    return run


def _id_filter(ids: DataFrame) -> bytes:
    """A bitmap of hashed ids of fixed size; it only spares work, the join after it decides."""

    def slots(batches):
        for b in batches:
            slot = (mix(b.column(0).to_numpy().astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            word, inverse = np.unique(slot >> 5, return_inverse=True)
            value = np.zeros(len(word), np.int64)
            np.bitwise_or.at(value, inverse, np.int64(1) << (slot & 31))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value)], names=["word", "value"])

    got = ids.mapInArrow(slots, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    words = np.zeros(FILTER_BITS // 32, "<u4")
    words[got["word"].to_numpy(np.int64)] = got["value"].to_numpy(np.int64).astype("<u4")
    return words.tobytes()


def _tree_links(dealt: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``(a, b)`` in each group ``(block, i, j)`` of sets ``(rep, tokens, label, asked)``, by a prefix tree a group.

    Groups follow one another in a partition, so a task holds one at a time, and
    the many blocks of two or three sets cost no more than their sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, shown = None, [], None
        a: list[int] = []
        b: list[int] = []

        def join() -> None:
            members = [np.frombuffer(x[1], np.uint64) for x in held]
            for x, y in links_within(members, num, den, [x[2] for x in held], [x[3] for x in held]):
                if held[x][0] != held[y][0]:
                    a.append(held[x][0])
                    b.append(held[y][0])

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a.clear()
            b.clear()
            return rows

        for batch in batches:
            for at in range(0, len(batch), 1000):
                for block, i, j, rep, tokens, label, asked in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns)):
                    if (block, i, j) != group:
                        join()
                        group, held, shown = (block, i, j), [], None
                    if (rep, asked) != shown:  # a repeated id may have brought a set twice
                        held.append((rep, tokens, label, asked))
                        shown = (rep, asked)
            if len(a) > 10_000:
                yield out()
        join()
        yield out()

    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = dealt.select("block", "i", "j", "rep", "tokens", "label", "asked").repartition(parts, "block", "i", "j").sortWithinPartitions("block", "i", "j", "asked", "rep")
    return ready.mapInArrow(run, "a long, b long")


def _chunk(chunks: str) -> F.Column:
    return F.pmod(F.xxhash64("rep"), F.col(chunks)).cast("int")


def _near_links(dealt: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)`` that span what may link in each group ``(block, class, up, i, j)`` of ``(rep, n, sketch, side)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def join() -> pa.RecordBatch:
            pairs = near_sets([x[1] for x in held], [x[2] for x in held], [x[3] for x in held], num, den) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([held[p[k]][0] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for *key, rep, n, cells, side in zip(*(c.to_pylist() for c in batch.columns)):
                if key != group:
                    yield join()
                    group, held = key, []
                if not held or held[-1][0] != rep:  # a repeated id may have brought a set twice
                    held.append((rep, n, cells, side))
        yield join()

    parts, key = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), ("block", "class", "up", "i", "j")
    return dealt.select(*key, "rep", "n", "sketch", "side").repartition(parts, *key).sortWithinPartitions(*key, "rep").mapInArrow(run, "a long, b long")


def _finer(kept: DataFrame, placed: Written, num: int, den: int) -> Written:
    """``placed(rep, n, block)`` with the blocks beyond ``TREE_SHINGLES`` cut into what sizes and sketches let link.

    Common passages make signatures meet, and in a large corpus they chain sets
    into blocks of many classes, whose pairs of chunks would cost the square in
    shingles. Sketches are a bit or two a shingle, and they let hardly more link
    than do. Linked sets are in one size class or two neighbours, so chunks of
    these meet; a set that may link with none is done.
    """
    large = Written(placed.df.groupBy("block").agg(F.sum("n").alias("w")).where(F.col("w") > TREE_SHINGLES).select("block"), "large")
    if large.df.isEmpty():
        large.drop()
        return placed

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1)
            classes = pa.array([_size_class(x, num, den)[0] for x in n.to_pylist()], pa.int32())
            drawn = pa.array([sketch(np.frombuffer(x.as_buffer(), np.uint64)) for x in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), n, classes, drawn], names=["rep", "n", "class", "sketch"])

    inside = placed.df.join(large.df, "block").select("rep", "block").distinct()
    drawn = kept.select("rep", "n", "tokens").mapInArrow(draw, "rep long, n long, class int, sketch binary")
    sketched = Written(drawn.join(inside.hint("merge"), "rep"), "sketches")
    held = sketched.df.groupBy("block", "class").agg(F.count("*").alias("sets"), F.sum("n").alias("w"))
    held = held.select("block", "class", "sets", F.ceil(F.greatest(F.col("sets") / CHUNK_SETS, F.col("w") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    beside = lambda by, name: held.select("block", (F.col("class") + by).alias("class"), F.col("chunks").alias(name))
    load = held.join(beside(-1, "above"), ["block", "class"], "left").join(beside(1, "below"), ["block", "class"], "left")
    load = Written(load.fillna(0, ["above", "below"]), "loads")
    met = join_counted(sketched.df, load.df, ["block", "class"], "sets", "rep").withColumn("own", _chunk("chunks"))
    # Chunk i of a class meets the chunks j of that class from i on (up 0) and all of the class above (up 1).
    upto = lambda most, place: f"transform(filter(sequence(0, {most}), x -> x < {most}), x -> {place})"
    place = "named_struct('class', {}, 'up', {}, 'i', {}, 'j', {}, 'side', {})".format
    same = upto("chunks", place("class", 0, "least(x, own)", "greatest(x, own)", "if(x < own, 1, 0)"))
    above, below = upto("above", place("class", 1, "own", "x", 0)), upto("below", place("class - 1", 1, "x", "own", 1))
    dealt = met.select("block", "rep", "n", "sketch", F.explode(F.expr(f"concat({same}, {above}, {below})")).alias("to")).select("block", "rep", "n", "sketch", "to.*")
    links = Written(_near_links(dealt, num, den), "near")
    for table in (sketched, load):
        table.drop()
    named = components(links.df)
    apart = placed.df.select("rep", "n").join(named.df, F.col("rep") == F.col("node")).select("rep", "n", F.col("component").alias("block"))
    finer = Written(placed.df.join(large.df, "block", "left_anti").select("rep", "n", "block").unionAll(apart), "placed")
    for table in (links, named, large, placed):
        table.drop()
    return finer


def _block_links(kept: DataFrame, block: DataFrame, num: int, den: int) -> DataFrame:
    """Classes ``(node, component)`` of sets ``(rep, n, tokens)`` that share a block.

    A block of up to ``TREE_SHINGLES`` is one tree. A larger one is cut by
    sketches (see ``_finer``), and what is larger still is dealt into chunks.
    First each chunk is joined by itself, then one set of each class so
    found is joined with the block's others. If that leaves more than one class,
    links across chunks may be open, but none inside a class; so the sets outside
    of the block's largest class, dealt into chunks, meet every chunk. A group of
    near copies is one class by then, and its work grows with its size, not with
    the square; only many classes that sketches cannot tell apart cost pairs of
    chunks.
    """
    sized = kept.select("rep", "n").join(block, F.col("rep") == F.col("node")).select("rep", "n", F.col("component").alias("block"))
    placed = _finer(kept, Written(sized, "placed"), num, den)  # narrow: sets are dealt by these rows, and their shingles follow once
    load = placed.df.groupBy("block").agg(F.ceil(F.sum("n") / TREE_SHINGLES).cast("int").alias("chunks"))
    own = placed.df.join(load, "block").withColumn("i", _chunk("chunks")).withColumns({"j": F.col("i"), "label": F.col("rep"), "asked": F.lit(True)})

    def linked(source: DataFrame, dealt: DataFrame) -> Written:
        return Written(_tree_links(source.select("rep", "tokens").join(dealt.hint("merge"), "rep"), num, den), "links")

    found = [linked(kept, own)]

    def classes() -> Written:
        links = found[0].df
        for more in found[1:]:
            links = links.unionAll(more.df)
        return components(links)

    large = Written(load.where("chunks > 1").select("block"), "large")
    wide = not large.df.isEmpty()
    split = Written(placed.df.join(large.df, "block"), "split") if wide else None
    source = Written(kept.join(split.df.select("rep").hint("merge"), "rep", "left_semi"), "tokens") if wide else None
    large.drop()
    placed.drop()
    named = classes()
    if wide:

        def labelled() -> DataFrame:
            return split.df.join(named.df.withColumnRenamed("component", "label"), F.col("rep") == F.col("node"), "left").select("rep", "n", "block", F.coalesce("label", "rep").alias("label"))

        one = labelled().groupBy("block", "label").agg(F.min_by("n", "rep").alias("n"), F.min("rep").alias("rep"))
        fit = one.groupBy("block").agg(F.ceil(F.sum("n") / TREE_SHINGLES).cast("int").alias("chunks"))
        found.append(linked(source.df, one.join(fit, "block").withColumn("i", _chunk("chunks")).withColumns({"j": F.col("i"), "asked": F.lit(True)})))
        named.drop()
        named = classes()
        weight = labelled().groupBy("block", "label").agg(F.sum("n").alias("w"))
        main = weight.groupBy("block").agg(F.max_by("label", F.struct("w", "label")).alias("main"), F.sum("w").alias("w"), F.max("w").alias("most"))
        half = TREE_SHINGLES / 2
        plan = main.where("w > most").select("block", "main", F.ceil(F.col("w") / half).cast("int").alias("all"), F.ceil((F.col("w") - F.col("most")) / half).cast("int").alias("few"))
        open_now = Written(labelled().join(plan, "block"), "open")
        asking = open_now.df.where("label <> main").withColumns({"i": _chunk("few"), "j": F.explode(F.sequence(F.lit(0), F.col("all") - 1)), "asked": F.lit(True)})
        others = open_now.df.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("few") - 1)), "j": _chunk("all"), "asked": F.lit(False)})
        found.append(linked(source.df, asking.unionByName(others)))
        named.drop()
        named = classes()
        for table in (open_now, split, source):
            table.drop()
    for links in found:
        links.drop()
    return named


def jaccard_classes(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id, n_same_set)`` per distinct id: classes of near copies.

    Two documents link when ``den * |A & B| >= num * |A | B|`` for their sets of
    ``width``-word shingles; a class is what links reach, named by its smallest id.
    ``n_same_set`` counts the other rows that hold the very same set.
    The result is exact up to collisions of 64-bit shingle hashes.

    1. Equal sets become one class each (combinable minimum per set digest), so a
       group of copies costs one row from here on.
    2. Linked sets have steps in common (see ``_steps``); sets that have too few
       in common with others are done. A step is counted where it meets another,
       in its task or after one shuffle, to which a task sends it once.
    3. The rest, few in a corpus, meet in blocks: the components of sharing a
       signature (see ``signatures``). Nothing is lost, and a common passage
       alone does not bring two documents together.
    4. Each block is joined on prefix trees (see ``_block_links``), a large one
       after exact sketches have cut it; no task holds more than about
       ``TREE_SHINGLES``.
    5. Links that span the classes are merged by ``components``.

    Null and empty texts, and texts of white space, have no shingle and link with
    nothing, not even each other. Null ids give no row; of repeated ids the result
    has one row, with the smallest ``n_shingles`` and component among its rows'.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    seen = Written(source.mapInArrow(_scan("id", "text", width), "id long, n long, d1 long, d2 long"), "shingled")
    # A set is known by a number of its own, as one id may have several texts.
    grouped = seen.df.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = Written(grouped.withColumn("rep", F.monotonically_increasing_id()), "sets")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = source.select("text").mapInArrow(_deal_steps("text", width, num, den, parts * LANES), _STEP_ROWS)
    counted = steps.repartitionById(parts, F.col("part")).sortWithinPartitions("lane").mapInArrow(_count_steps(parts * LANES), _STEP_ROWS)
    # A set's steps in one of its tasks are either counted there or sent; so the most counted in a task and all counted after bound them.
    hits = counted.repartitionById(parts, F.col("part")).sortWithinPartitions("lane").mapInArrow(_sum_hits, "digest long, hits long")
    # A partner may be as small as num/den of the set. Sets so small that all their steps may break stay.
    enough = F.floor(F.floor(F.col("n") * num / den) / 25) + 1
    free = F.col("n") - 1 - F.floor(2 * F.col("n") * (den - num) / den) < 1
    met = classes.df.join(hits, classes.df.d1 == hits.digest, "left").where((F.coalesce("hits", F.lit(0)) >= enough) | free)
    alive = Written(met.select("rep", "n", "d1", "d2", F.col("least").alias("id")), "alive")

    wanted = spark.sparkContext.broadcast(_id_filter(alive.df.select("id")))
    text = source.mapInArrow(_rescan("id", "text", width, wanted), "id long, d1 long, d2 long, tokens binary")
    kept = Written(text.join(alive.df.hint("merge"), ["id", "d1", "d2"]).where(F.octet_length("tokens") == 8 * F.col("n")).select("rep", "n", "tokens"), "tokens")
    alive.drop()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tokens = b.column(0).to_numpy(), b.column(1)
            for lo in range(0, len(ids), 256):
                got = [signatures(np.frombuffer(x, np.uint64), num, den) for x in tokens.slice(lo, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo : lo + 256], [len(g) for g in got])), pa.array(np.concatenate(got).astype(np.int64))], names=["rep", "sig"])

    signed = Written(kept.df.select("rep", "tokens").mapInArrow(sign, "rep long, sig long"), "signed")
    least = Written(signed.df.groupBy("sig").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.count("*").alias("holders")).where("a < z").select("sig", "a", "holders"), "least")
    stars = join_counted(signed.df, least.df, ["sig"], "holders", "rep").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    block = components(stars)
    signed.drop()
    least.drop()
    merged = _block_links(kept.df, block.df, num, den)
    kept.drop()
    block.drop()

    linked = merged.df.join(classes.df, F.col("node") == F.col("rep"))
    first = linked.groupBy("component").agg(F.min("least").alias("first"))
    names = linked.select("rep", "component").join(first, "component").select(F.col("rep").alias("node"), "first")
    owner = Written(classes.df.join(names, F.col("rep") == F.col("node"), "left").select("n", "d1", "d2", "copies", F.coalesce("first", "least").alias("component_id")), "owners")
    merged.drop()
    classes.drop()
    ids = seen.df.select("id", "n", "d1", "d2")
    full = join_counted(ids.where("n > 0"), owner.df, ["n", "d1", "d2"], "copies", "id").select("id", "n", "component_id", (F.col("copies") - 1).alias("n_same_set"))
    none = ids.where("n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_same_set"))
    every = full.unionAll(none)
    return every.groupBy("id").agg(F.min("n").alias("n_shingles"), F.min("component_id").alias("component_id"), F.max("n_same_set").alias("n_same_set")).withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies: of each class the rows of its smallest id stay, and rows with a null id."""
    classes = jaccard_classes(docs, width, num, den, id_col, text_col)
    gone = classes.where(F.col(id_col) != F.col("component_id")).select(id_col)
    return docs.join(gone.hint("merge"), id_col, "left_anti").select(*docs.columns)
