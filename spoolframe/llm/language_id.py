"""Hierarchical language identification: family first, then one-versus-one SVMs within it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, join_counted, slices
from .quality import held_out

#: Most documents of one language that a model is fitted on.
PER_LANGUAGE = 500
#: Hashed cells for runs of one, two and three bytes.
CELLS = (256, 768, 1024)
# Language families by ISO 639 codes. A code that is in none is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ast ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indo-aryan": "as bn gu hi mr ne or pa sd si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "malayo-polynesian": "id jv mg mi ms su tl",
    "bantu": "rw sn st sw xh zu",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_HAS_LETTER = re.compile(r"[^\W\d_]")
# Letters in lower case as they are; all other ASCII bytes as a space.
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def family(language: str) -> str:
    return _FAMILY.get(re.split(r"[-_]", language.lower())[0], language)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: roots of the shares of byte runs by hashed cell, for each length of run; a text of none is zero."""
    count, width = len(offsets) - 1, sum(CELLS)
    out = np.zeros((count, width), np.float32)
    if not len(data):
        return out
    folded = _FOLD[data]
    owner = np.repeat(np.arange(count), np.diff(offsets))
    left = offsets[1:][owner] - np.arange(len(data))  # bytes from here to the end of the text
    code, at = folded.copy(), 0
    for n, cells in enumerate(CELLS, 1):
        if n > 1:
            code = code[:-1] * 257 + folded[n - 1 :] if len(code) > 1 else code[:0]
        inside = (left[: len(code)] >= n) & (folded[: len(code)] != 32 if n == 1 else True)
        cell = (code * 0x9E3779B1 >> 7) % cells if n > 1 else code % cells
        index = owner[: len(code)][inside] * cells + cell[inside]
        part = np.bincount(index, minlength=count * cells).reshape(count, cells)
        out[:, at : at + cells] = np.sqrt(part / np.maximum(part.sum(1, keepdims=True), 1))
        at += cells
    return out


def svm(x: np.ndarray, y: np.ndarray, c: float = 8.0, epochs: int = 12) -> np.ndarray:
    """A linear support vector machine with squared hinge loss by dual coordinate descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w, a = np.zeros(x.shape[1]), np.zeros(len(y))
    diagonal, norm = 1 / (2 * c), (x * x).sum(1)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1 + diagonal * a[i]
            new = max(a[i] - g / (norm[i] + diagonal), 0.0)
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


@dataclass
class LanguageModel:
    """Machines that tell families apart, and in each family machines that tell its languages apart."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[str, list[tuple[int, int]]] = field(default_factory=dict)  # "" holds those of families
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def _vote(self, group: str, size: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(winner, trust) of one-versus-one machines: most wins, then the larger sum of margins."""
        if size == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margins = np.hstack([x, np.ones((len(x), 1), x.dtype)]) @ self.weights[group].T
        wins, sums, worst = np.zeros((len(x), size)), np.zeros((len(x), size)), np.full((len(x), size), np.inf)
        for k, (i, j) in enumerate(self.pairs[group]):
            m = margins[:, k]
            wins[:, i] += m >= 0
            wins[:, j] += m < 0
            sums[:, i] += np.clip(m, -1, 1)
            sums[:, j] -= np.clip(m, -1, 1)
            worst[:, i], worst[:, j] = np.minimum(worst[:, i], m), np.minimum(worst[:, j], -m)
        best = np.argmax(wins + sums / (4 * size), axis=1)
        return best, 1 / (1 + np.exp(-3 * worst[np.arange(len(x)), best]))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return ["und"] * len(x), np.zeros(len(x))
        chosen, trust = self._vote("", len(self.families), x)
        names = np.empty(len(x), object)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(chosen == f)
            if len(rows):
                best, sure = self._vote(name, len(self.languages[name]), x[rows])
                names[rows] = np.array(self.languages[name], object)[best]
                trust[rows] *= sure
        return names.tolist(), np.clip(trust, 0, 1)


def fit(x: np.ndarray, languages: list[str]) -> LanguageModel:
    """Trains the machines of both levels. Without rows the model knows no language."""
    model, langs = LanguageModel(), np.array(languages, object)
    fam = np.array([family(v) for v in languages], object)
    model.families = sorted(set(fam.tolist()))
    groups = {"": (fam, model.families)}
    for name in model.families:
        model.languages[name] = sorted(set(langs[fam == name].tolist()))
        groups[name] = (langs, model.languages[name])
    for group, (tags, names) in groups.items():
        model.pairs[group] = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
        machines = []
        for i, j in model.pairs[group]:
            rows = (tags == names[i]) | (tags == names[j])
            machines.append(svm(x[rows], np.where(tags[rows] == names[i], 1.0, -1.0)))
        model.weights[group] = np.array(machines)
    return model


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fits on at most ``per_language`` documents of each language that are not held out.

    They are the first of their language by a hash of their id. The ids are
    chosen from the narrow columns: a threshold on the hash, set by the
    language's count, leaves about twice the number wanted, and a rank cuts it;
    so the ids that are broadcast and the rows that are gathered are bounded by
    the number of languages times ``per_language``. Rows learn their language's
    count by ``join_counted``, so no language's rows meet in one task. Rows with a
    null id, language or text teach nothing; of an id repeated with several texts
    in a language one text counts; an empty table gives a model that knows no
    language.
    """
    narrow = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("long")).alias("h"))
    count = Written(narrow.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    share = F.lit(2.0 * per_language + 50) / F.col("n")
    low = join_counted(narrow, count.df, ["lang"], "n", "id").where((F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))) < share)
    ranked = low.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "id"))), 1, per_language).alias("rows"))
    sample = ranked.select("lang", F.explode("rows").alias("r")).select("lang", F.col("r.id").alias("id")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "lang", "x"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    found = source.join(F.broadcast(sample), ["id", "lang"]).select("id", "lang", "text").mapInArrow(run, "id long, lang string, x binary")
    got = found.groupBy("id", "lang").agg(F.min("x").alias("x")).toPandas().sort_values(["lang", "id"])
    count.drop()
    x = np.stack([np.frombuffer(v, np.float32) for v in got["x"]]) if len(got) else np.zeros((0, sum(CELLS)), np.float32)
    return fit(x, got["lang"].tolist())


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, lang_pred, score)`` per row, from the whole text alone.

    A null or empty text, or one without any letter, is ``und`` with score 0.
    Repeated rows and null ids are rows of their own (a null id is not held
    out); other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                names, trust = model.predict(features(data, offsets))
                lettered = np.array([bool(t and _HAS_LETTER.search(t)) for t in part.column(2).to_pylist()], bool)
                names = [n if ok else "und" for n, ok in zip(names, lettered)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(np.where(lettered, trust, 0.0))], names=["id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
