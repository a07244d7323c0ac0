"""Progress as streams: throttled delivery, newest state, and a watched inbox."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Least seconds and least move of the fraction between two deliveries.
INTERVAL_S, MOVE = 0.1, 0.01
OUTPUT = "job string, ts timestamp, stage string, fraction double, unit long, units long"
_STATE = "at double, fraction double, stage string, delivered boolean"


def delivers(state: tuple | None, at: float, stage: str, fraction: float | None, unit: int, units: int, interval: float = INTERVAL_S, move: float = MOVE) -> bool:
    """Whether a report is passed on: a new stage, a finished unit, or enough time and enough move."""
    if state is None or stage != state[2]:
        return True
    if units > 0 and unit >= units:
        return True
    moved = fraction is None or state[1] is None or abs(fraction - state[1]) >= move
    return at - state[0] >= interval and moved


def throttle(reports: DataFrame, interval: float = INTERVAL_S, move: float = MOVE, output_mode: str = "append", idle_minutes: int = 60) -> DataFrame:
    """Reports ``(job, ts, stage, fraction, unit, units)`` of a stream, thinned per job.

    State is the last delivery of each job: four values. It goes with the job's
    last unit, and once reports are ``idle_minutes`` further on, so it does not
    grow with the jobs that were; reports that late are passed over. Within a micro-batch reports are taken in order of
    time; a fraction is clamped to 0..1.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = None
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            at, fraction, stage, _ = state.get
            last = (at, None if fraction is None or fraction != fraction else fraction, stage)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        kept, over = [], False
        for row in rows.itertuples(index=False):
            over = row.units > 0 and row.unit >= row.units
            at = row.ts.timestamp()
            fraction = None if row.fraction is None or row.fraction != row.fraction else min(1.0, max(0.0, row.fraction))
            if delivers(last, at, row.stage, fraction, row.unit, row.units, interval, move):
                last = (at, fraction, row.stage)
                kept.append((key[0], row.ts, row.stage, fraction, row.unit, row.units))
        if over and state.exists:
            state.remove()
        elif last is not None and not over:
            state.update((last[0], last[1], last[2], True))
            state.setTimeoutTimestamp(max(int(last[0] * 1000), state.getCurrentWatermarkMs()) + idle_minutes * 60_000)
        if kept:
            yield pd.DataFrame(kept, columns=["job", "ts", "stage", "fraction", "unit", "units"])

    watched = reports.select("job", "ts", "stage", "fraction", "unit", "units").withWatermark("ts", f"{idle_minutes} minutes")
    return watched.groupBy("job").applyInPandasWithState(run, OUTPUT, _STATE, output_mode, GroupStateTimeout.EventTimeTimeout)


def newest(reports: DataFrame, key: str = "job", order: str = "ts") -> DataFrame:
    """The newest report per key; older ones are stale. Works on tables, and on streams in update mode."""
    rest = [c for c in reports.columns if c != key]
    return reports.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def inbox(spark: SparkSession, folder: str, clean: bool = False, remember: str = "7 days") -> DataFrame:
    """A stream of URLs dropped as text files into a folder: ``(url, directive, path)``.

    Words with a scheme are URLs; a word ``key:value`` after ``x-directive`` stands
    for all of its line's. Files are removed after reading if ``clean``. A URL
    dropped again within ``remember`` of its first file's time is passed over;
    what is remembered is bounded by that.
    """
    lines = spark.readStream.format("text").option("cleanSource", "delete" if clean else "off").load(folder)
    directive = F.nullif(F.regexp_extract("value", r"x-directive\s+(\S+)", 1), F.lit(""))
    words = lines.select(F.explode(F.split(F.trim("value"), r"\s+")).alias("url"), directive.alias("directive"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("dropped_at"))
    return words.where(F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\s]+")).withWatermark("dropped_at", remember).dropDuplicatesWithinWatermark(["url"]).drop("dropped_at")
