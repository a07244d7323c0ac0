"""Roll-ups: censuses, omissions, verdicts, outcomes and estimates, all as combinable aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def census(tags: DataFrame, code: str, size: Column) -> DataFrame:
    """``(code, n, bytes)``; order by n falling, then code, is the report's."""
    return tags.groupBy(code).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def omissions(noted: DataFrame, counted: DataFrame, kind: Column, details: dict[str, str] | None = None) -> DataFrame:
    """``(what, reason, n, bytes, detail)``: noted omissions by what and reason, and census rows of kinds that are left out.

    ``noted`` has what, reason, bytes, detail, pos; the first detail counts.
    ``counted`` is a census with what, n, bytes; ``kind`` gives the reason of a
    row or null.
    """
    first = F.min_by("detail", F.when(F.col("detail").isNotNull(), F.col("pos")))
    own = noted.groupBy("what", "reason").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), first.alias("detail"))
    told = F.lit(None).cast("string")
    for reason, text in (details or {}).items():
        told = F.when(F.col("reason") == reason, F.lit(text)).otherwise(told)
    rest = counted.withColumn("reason", kind).where("reason IS NOT NULL").select("what", "reason", "n", "bytes", told.alias("detail"))
    return own.unionByName(rest)


def verdict(tags: DataFrame, key: str, asset: Column, media: Column, drawn: Column, unknown: Column) -> DataFrame:
    """``(key, verdict)``: the first rule that any row of a file meets."""
    return tags.groupBy(key).agg(
        F.when(F.bool_or(asset), "media recovered")
        .when(F.bool_or(media), "media found but unrecoverable")
        .when(F.bool_or(drawn), "vector or script only")
        .when(F.bool_or(unknown), "unrecognised content")
        .otherwise("empty")
        .alias("verdict")
    )


def outcomes(items: DataFrame, index: str, value: Column, failed: Column, cancelled: Column, error: Column) -> DataFrame:
    """One outcome per item in input order: ``(index, status, value, error)``; a bad item never stops a run."""
    status = F.when(cancelled, "cancelled").when(failed, "failed").otherwise("succeeded")
    return items.select(index, status.alias("status"), F.when(status == "succeeded", value).alias("value"), F.when(status == "failed", error).alias("error"))


def report(results: DataFrame, size: str | None = None) -> DataFrame:
    """One row: counts per status, whether all succeeded, and bytes of what was written."""
    count = lambda s: F.count_if(F.col("status") == s)
    extra = [F.coalesce(F.sum(F.when(F.col("status") == "succeeded", F.col(size))), F.lit(0)).alias("bytes")] if size else []
    return results.agg(count("succeeded").alias("succeeded"), count("failed").alias("failed"), count("cancelled").alias("cancelled"), F.coalesce(F.bool_and(F.col("status") == "succeeded"), F.lit(True)).alias("all_succeeded"), *extra)


def estimated_bitrate(tracks: DataFrame, key: str, rate: str, size: str, duration: str) -> DataFrame:
    """The sum of positive track rates, else size over duration."""
    return tracks.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col(rate) > 0, F.col(rate))).cast("double"), F.max(size) * 8.0 / F.nullif(F.max(duration), F.lit(0))).alias("bitrate"))


def complete_sum(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A sum that is null if any part is null."""
    return rows.groupBy(key).agg(F.when(F.count(value) == F.count("*"), F.sum(value)).alias(value))


def weights(parts: DataFrame, key: str, size: str) -> DataFrame:
    """Each part's share of its key's size; equal shares where any size is unknown."""
    w = Window.partitionBy(key)
    known = (F.count(size).over(w) == F.count("*").over(w)) & (F.sum(size).over(w) > 0)
    return parts.withColumn("weight", F.when(known, F.col(size) / F.sum(size).over(w)).otherwise(1 / F.count("*").over(w)))


def overall_progress(parts: DataFrame, key: str, order: str, weight: str, done: str, total: str, pieces_done: str, pieces: str) -> DataFrame:
    """The fraction of a whole: parts by weight, each by bytes, else by pieces, else not known."""
    own = F.coalesce(F.col(done) / F.nullif(F.col(total), F.lit(0)), F.col(pieces_done) / F.nullif(F.col(pieces), F.lit(0)))
    return parts.groupBy(key).agg(F.when(F.count(own) == F.count("*"), F.sum(F.col(weight) * F.least(own, F.lit(1.0)))).alias("fraction"))
