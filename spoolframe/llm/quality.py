"""Quality scores by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .shingles import _SPACE, mix, words

#: Most labelled rows that a model is fitted on, the first by a hash of their id.
SAMPLE_ROWS = 20_000
FEATURES = ["log_bytes", "upper", "symbols", "exclaim", "digits", "bars", "word_size", "stops", "spaces", "lines", "distinct", "top_word", "repeated_lines", "short_words", "high_bytes", "long_words", "sentence_ends"]


def _mask(chars: str | range) -> np.ndarray:
    m = np.zeros(256, bool)
    m[[*(chars.encode() if isinstance(chars, str) else chars)]] = True
    return m


_UPPER, _LOWER, _DIGIT, _HIGH = _mask(range(65, 91)), _mask(range(97, 123)), _mask(range(48, 58)), _mask(range(128, 256))
_CLASSES = [_UPPER, _LOWER | _HIGH, _mask("#$%&*<>{}[]=+~^@\\_`"), _mask("!?"), _DIGIT, _mask("|/"), _mask(".,;:"), _SPACE, _mask("\n"), _HIGH]


#: Bytes of text that features are worked out for at a time.
AT_ONCE = 1 << 19


def _running(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text, from its bytes and word hashes; all zero for an empty text."""
    count = len(offsets) - 1
    out = np.zeros((count, len(FEATURES)))
    if not len(data):
        return out
    # One running count at a time: each is as long as the text.
    n = np.maximum(np.diff(offsets), 1)
    upper, lower, symbols, marks, digits, bars, stops, spaces, lines, high = (np.diff(_running(m[data])[offsets]) for m in _CLASSES)
    hashes, before = words(data, offsets)
    w = np.diff(before)
    many = np.maximum(w, 1)
    inside = np.diff(offsets) - spaces
    starts = _word_starts(data, offsets)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    size = np.minimum(ends - starts, np.repeat(offsets[1:], w) - starts) if len(starts) else np.zeros(0)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[before])
    short, long = total(size <= 4), total(size > 14)
    distinct, top = np.zeros(count), np.zeros(count)
    for i, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist())):
        if b > a:
            _, c = np.unique(hashes[a:b], return_counts=True)
            distinct[i], top[i] = len(c), c.max()
    # Lines: words of a line summed with their place give its hash; a repeat is a line seen before in the text.
    repeated = np.zeros(count)
    if len(starts):
        line = _running(_CLASSES[8][data])[starts] + np.repeat(np.arange(count), w)
        head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        place = np.arange(len(starts)) - np.repeat(head, np.diff(np.append(head, len(starts))))
        value = mix(np.add.reduceat(mix(hashes + place.astype(np.uint64)), head))
        owner = np.searchsorted(before, head, side="right") - 1
        _, first = np.unique(mix(value ^ mix(owner.astype(np.uint64))), return_index=True)
        again = np.ones(len(head))
        again[first] = 0
        repeated = np.bincount(owner, again, count) / np.maximum(np.bincount(owner, minlength=count), 1)
    columns = [np.log1p(np.diff(offsets)), upper / np.maximum(upper + lower, 1), symbols / n, marks / n, digits / n, bars / n, inside / many, stops / many, spaces / n, lines / many, distinct / many / np.maximum(np.log2(many + 1), 1), top / many, repeated, short / many, high / n, long / many, stops / np.maximum(marks + stops + symbols + bars, 1)]
    for j, c in enumerate(columns):
        out[:, j] = c
    out[np.diff(offsets) == 0] = 0
    return out


def _word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    start[heads] = inside[heads]
    return np.flatnonzero(start)


@dataclass
class AdditiveModel:
    """Lookup tables over feature bins and over bins of feature pairs; a score adds one cell of each."""

    cuts: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            out += t[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _shallow(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree of ``depth`` on one binned feature, as its value in each bin."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > _gain(g.sum(), h.sum()) + 1e-9:
            return np.concatenate([_shallow(g[:cut], h[:cut], depth - 1), _shallow(g[cut:], h[cut:], depth - 1)])
    return np.full(len(g), _leaf(g.sum(), h.sum()))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree that cuts two binned features once each."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(G.shape) < 2:
        return 0.0, np.zeros_like(g)
    a, b = G[:-1, :-1], H[:-1, :-1]
    parts_g = [a, G[:-1, -1:] - a, G[-1:, :-1] - a, G[-1, -1] - G[:-1, -1:] - G[-1:, :-1] + a]
    parts_h = [b, H[:-1, -1:] - b, H[-1:, :-1] - b, H[-1, -1] - H[:-1, -1:] - H[-1:, :-1] + b]
    gain = sum(_gain(x, y) for x, y in zip(parts_g, parts_h))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = np.empty_like(g)
    q = [_leaf(x[i, j], y[i, j]) for x, y in zip(parts_g, parts_h)]
    value[: i + 1, : j + 1], value[: i + 1, j + 1 :], value[i + 1 :, : j + 1], value[i + 1 :, j + 1 :] = q
    return float(gain[i, j]), value


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pairs: int = 6, rate: float = 0.15) -> AdditiveModel:
    """Cyclic boosting: each round gives every feature in turn a shallow tree on its bins, later every chosen pair.

    Pairs are those whose best two-cut tree explains most of what the single
    features leave. With one label only, or no row, the model is a constant.
    """
    if not len(y):
        return AdditiveModel()
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = AdditiveModel(base=float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    model.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = model.bins(x)
    width = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(w) for w in width]
    f = np.full(len(y), model.base)
    for _ in range(rounds):
        for j in range(x.shape[1]):
            p = 1 / (1 + np.exp(-f))
            g, h = np.bincount(b[:, j], y - p, width[j]), np.bincount(b[:, j], p * (1 - p), width[j])
            step = rate * _shallow(g, h)
            model.tables[j] += step
            f += step[b[:, j]]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        cell = b[:, i] * width[j] + b[:, j]
        return tuple(np.bincount(cell, v, width[i] * width[j]).reshape(width[i], width[j]) for v in (y - p, p * (1 - p)))

    ranked = sorted(((_quadrants(*grids(i, j))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:pairs]]
    model.pair_tables = [np.zeros((width[i], width[j])) for i, j in model.pairs]
    for _ in range(rounds // 3):
        for k, (i, j) in enumerate(model.pairs):
            step = rate * _quadrants(*grids(i, j))[1]
            model.pair_tables[k] += step
            f += step[b[:, i], b[:, j]]
    return model


def held_out(id_col: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AdditiveModel:
    """Fits on at most ``sample_rows`` labelled documents that are not held out.

    The rows are the first by a hash of their id, chosen from ids and labels
    alone, so what is broadcast and gathered is bounded by ``sample_rows``.
    Labels other than 0 and 1, and null ids, are passed over; of repeated
    labels of an id the larger counts, and of its repeated texts one. Null text
    counts as empty. Without any labelled row the model scores 0.5 throughout.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text", AT_ONCE):
                x = features(data, offsets)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), rows], names=["id", "label", "x"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    met = source.join(F.broadcast(sample), "id").select("id", "label", "text")
    # sample_rows bounds the rows gathered, as ids repeated in docs are cut to one each before.
    got = met.mapInArrow(run, "id long, label double, x array<double>").groupBy("id").agg(F.min("label").alias("label"), F.min("x").alias("x")).toPandas().sort_values("id")
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES)))
    return fit(x, got["label"].to_numpy(float))


def quality_scores(docs: DataFrame, model: AdditiveModel, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` per row, or the columns ``keep`` with ``score__`` beside them.

    Null text counts as empty and is scored like it. Repeated rows and null ids
    are rows of their own (a null id is not held out). The model is a few
    kilobytes and goes with the task.
    """
    columns = [F.col(id_col).cast("long").alias(id_col), held_out(id_col).alias("held_out")] if keep is None else [F.col(c) for c in keep]
    source = docs.select(*columns, F.col(text_col).cast("string").alias("text__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text__", AT_ONCE):
                score = model.score(features(data, offsets))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score)], names=[*part.schema.names[:-1], "score__"])

    kept = source.drop("text__").schema
    scored = source.mapInArrow(run, kept.add("score__", "double"))
    if keep is not None:
        return scored
    return scored.select(id_col, "held_out", F.col("score__").alias("score"), (F.col("score__") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that the classifier, trained on ``labels``, scores below ``least``.

    Null text is scored as empty. Repeated rows and rows with a null id are each
    judged by their text; all columns of ``docs`` are kept, whatever their names.
    An empty table stays empty.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    numbered = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    own = {name: f"c{docs.columns.index(name)}" for name in (id_col, text_col)}
    good = quality_scores(numbered, model, keep=numbered.columns, id_col=own[id_col], text_col=own[text_col]).where(F.col("score__") >= least)
    return good.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
