"""Chapters and cues: interval algebra on DataFrames, with windows and equi-joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cues closer than this are one where text and styles agree.
JOIN_GAP = 0.0005


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def normalise_chapters(chapters: DataFrame, key: str = "file_id", total: str | None = None) -> DataFrame:
    """Chapters without overlap: ``start``, ``duration`` in order of (start, pos).

    Starts that are negative or not finite go; a chapter ends where the next
    starts at the latest; the last is closed by the total duration if it runs
    over or has none; what has no length goes. One window per file, so a shuffle
    by file.
    """
    w = Window.partitionBy(key).orderBy("start", "pos")
    kept = chapters.where(_finite(F.col("start")) & (F.col("start") >= 0)).withColumn("next__", F.lead("start").over(w))
    end = F.col("start") + F.col("duration")
    cut = F.when(F.col("next__").isNotNull() & (end > F.col("next__")), F.greatest(F.lit(0.0), F.col("next__") - F.col("start")))
    if total:
        closes = F.col("next__").isNull() & (F.col(total) > 0) & ((end > F.col(total)) | (F.col("duration") <= 0))
        cut = F.when(closes, F.greatest(F.lit(0.0), F.col(total) - F.col("start"))).otherwise(cut)
    return kept.withColumn("duration", F.coalesce(cut, F.col("duration"))).drop("next__").where("duration > 0")


def coalesce_adjacent(rows: DataFrame, key: str, start: str, end: str, same: list[str], gap: float = JOIN_GAP, order: str | None = None) -> DataFrame:
    """Merges neighbours whose ``same`` columns agree and whose gap is below ``gap``: gaps and islands."""
    w = Window.partitionBy(key).orderBy(start, *([order] if order else []))
    fresh = F.lit(False)
    for c in same:
        fresh = fresh | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    before = F.lag(end).over(w)
    marked = rows.withColumn("fresh__", (before.isNull() | fresh | (F.abs(F.col(start) - before) >= gap)).cast("int"))
    island = marked.withColumn("island__", F.sum("fresh__").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "island__", *same).agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")).drop("island__")


def runs(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Runs of equal values in order: ``(key, run, value, n, first, last)``."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("fresh__", F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1)))
    first = F.row_number().over(w) == 1
    marked = marked.withColumn("fresh__", F.when(first, 1).otherwise(F.col("fresh__")))
    numbered = marked.withColumn("run", F.sum("fresh__").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run", value).agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def flatten_cues(cues: DataFrame, key: str = "doc_id", slot: float = 60.0) -> DataFrame:
    """Overlapping cues as segments that do not overlap: ``(key, start, end, text)``.

    Each moment shows the texts of all cues over it, joined by line breaks in
    (start, pos) order; neighbours with one text are merged. A cue is spread over
    the slots of time that it touches, so it meets the segments of its own slots
    only: the interval join is an equi-join on (key, slot), whose work follows
    the cues that really overlap, and a long file is no hot key. ``slot`` is in
    seconds and should be some typical cues long.
    """
    good = cues.where(_finite(F.col("start")) & _finite(F.col("end")) & (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.length("text") > 0))
    good = good.select(key, "pos", F.col("start").cast("double"), F.col("end").cast("double"), "text")
    edges = good.select(key, F.explode(F.array("start", "end")).alias("from")).distinct()
    segments = edges.withColumn("to", F.lead("from").over(Window.partitionBy(key).orderBy("from"))).where("to IS NOT NULL")
    spread = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / slot), F.floor(F.col(b) / slot)))
    left = segments.withColumn("slot", F.floor(F.col("from") / slot))
    right = good.withColumn("slot", spread("start", "end")).withColumnsRenamed({"start": "s__", "end": "e__"})
    met = left.join(right, [key, "slot"]).where("s__ <= `from` AND e__ >= `to`")
    shown = met.groupBy(key, "from", "to").agg(F.array_sort(F.collect_list(F.struct("s__", "pos", "text"))).alias("all"))
    shown = shown.select(key, F.col("from").alias("start"), F.col("to").alias("end"), F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("text"))
    return coalesce_adjacent(shown, key, "start", "end", ["text"], gap=1e-12).select(key, "start", "end", "text")


def tile_cues(cues: DataFrame, key: str, total_ms: str) -> DataFrame:
    """Flat cues as samples that tile a film: ``(key, start_ms, length_ms, text)``, text null in gaps.

    Times are rounded to milliseconds and cut at the film's end; a cue starts at
    the running end of those before at the earliest, and one with no time left is
    dropped.
    """
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    w = Window.partitionBy(key).orderBy("start", "end")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    base = cues.select(key, total_ms, "start", "end", "text", ms("start").alias("a"), F.least(ms("end"), F.col(total_ms)).alias("b"))
    cursor = F.coalesce(F.max("b").over(past), F.lit(0).cast("long"))
    placed = base.withColumn("a", F.greatest("a", cursor)).where("b > a")
    before = F.coalesce(F.max("b").over(past), F.lit(0).cast("long"))
    with_gap = placed.withColumn("gap", before)
    filler = with_gap.where("a > gap").select(key, F.col("gap").alias("start_ms"), (F.col("a") - F.col("gap")).alias("length_ms"), F.lit(None).cast("string").alias("text"))
    told = placed.select(key, F.col("a").alias("start_ms"), (F.col("b") - F.col("a")).alias("length_ms"), "text")
    last = placed.groupBy(key).agg(F.max("b").alias("b"), F.max(total_ms).alias("t")).where("t > b").select(key, F.col("b").alias("start_ms"), (F.col("t") - F.col("b")).alias("length_ms"), F.lit(None).cast("string").alias("text"))
    return told.unionByName(filler).unionByName(last)


def earlier_head(rows: DataFrame, key: str, order: list[str], is_head: Column, head: str, name: str = "head") -> DataFrame:
    """Each row with the last head at or before it: an as-of join as one window, without a join."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.when(is_head, F.col(head)), ignorenulls=True).over(w))
