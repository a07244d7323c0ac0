"""Loudness of sample rows, and rules over scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.media import FLOOR_DB, decibels

# What counts as audible, and the length of a window in seconds.
PEAK_DB, RMS_DB, WINDOW_S = -60.0, -70.0, 0.4


def mean_volume(samples: DataFrame, key: str = "file_id", sample: str = "sample") -> DataFrame:
    """``(key, state, mean_db, n)``: none, silence or measured, which are three different answers."""
    power = F.avg(F.col(sample) * F.col(sample))
    got = samples.groupBy(key).agg(F.count(sample).alias("n"), power.alias("p"))
    state = F.when(F.col("n") == 0, "none").when(F.col("p") == 0, "silence").otherwise("measured")
    return got.select(key, state.alias("state"), F.when(state == "measured", F.greatest(10 * F.log10("p"), F.lit(FLOOR_DB))).alias("mean_db"), "n")


def audibility(samples: DataFrame, key: str = "file_id", index: str = "frame", sample: str = "sample", rate: int = 44100, channels: int = 1, peak_db: float = PEAK_DB, rms_db: float = RMS_DB) -> DataFrame:
    """``(key, audible, loudest_db, windows)``: whether any window is loud in peak and in power, both strictly.

    Windows count samples, not time; the last may be short. Grouping is by (key,
    window), combined before the shuffle, so one long file spreads over all tasks.
    """
    size = max(1, int(rate * WINDOW_S)) * channels
    windows = samples.groupBy(key, F.floor(F.col(index) / size).alias("w")).agg(F.max(F.abs(F.col(sample))).alias("peak"), F.sqrt(F.avg(F.col(sample) * F.col(sample))).alias("rms"))
    loud = (decibels(F.col("peak")) > peak_db) & (decibels(F.col("rms")) > rms_db)
    return windows.groupBy(key).agg(F.coalesce(F.bool_or(loud), F.lit(False)).alias("audible"), decibels(F.max("peak")).alias("loudest_db"), F.count("*").alias("windows"))


def first_adequate(scores: DataFrame, key: str, index: str, score: str, least: float = 0.05) -> DataFrame:
    """The first index whose score reaches ``least``, else the first of the best: ``(key, index)``."""
    best = F.max(F.struct(F.col(score), (-F.col(index)).alias("i")))
    return scores.groupBy(key).agg(F.coalesce(F.min(F.when(F.col(score) >= least, F.col(index))), -best["i"]).alias(index))


def spacing_factor(starts: DataFrame, key: str, start: str, duration: str) -> DataFrame:
    """Mean spacing over mean positive duration; null with fewer than three starts or two durations."""
    n, d = F.count(start), F.avg(F.when(F.col(duration) > 0, F.col(duration)))
    many = F.count(F.when(F.col(duration) > 0, 1))
    return starts.groupBy(key).agg(F.when((n >= 3) & (many >= 2), (F.max(start) - F.min(start)) / (n - 1) / d).alias("factor"))


def bisect_quality(scores: DataFrame, key: str, quality: str, passed: str, low: float = 0.0, high: float = 1.0, tries: int = 6, span: float = 0.01) -> DataFrame:
    """The least quality that passes, by bisection over a table of scores: ``(key, quality)``, null if the highest fails.

    A try reads the row whose quality is nearest at or below it. All tries run
    in one expression over a key's sorted score array, whose length is the number
    of qualities on offer.
    """
    offers = scores.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(quality).alias("q"), F.col(passed).alias("ok")))).alias("s"))
    at = lambda q: F.coalesce(F.try_element_at(F.filter("s", lambda x: x["q"] <= q), F.lit(-1))["ok"], F.lit(False))
    start = F.struct(F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"))

    def step(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        done = s["hi"] - s["lo"] <= span
        ok = at(mid)
        return F.struct(F.when(done | ok, s["lo"]).otherwise(mid).alias("lo"), F.when(~done & ok, mid).otherwise(s["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(2), F.lit(tries)), start, step, lambda s: s["hi"])
    return offers.select(key, F.when(at(F.lit(float(high))), found).alias("quality"))
