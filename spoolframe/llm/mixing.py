"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, join_counted

#: A Poisson mean above this is the sum of equal smaller ones, as its smallest chance would vanish.
LARGEST_MEAN = 500.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, joined by '|'."""
    text = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_sums(mean: Column) -> Column:
    """The cumulated chances of 0, 1, 2, ... of a Poisson count, as far as doubles tell them from 1."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("chance"), F.array(F.exp(-mean)).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        chance = state["chance"] * mean / k.cast("double")
        return F.struct(chance.alias("chance"), F.array_append(state["sums"], F.element_at(state["sums"], -1) + chance).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["sums"])


def poisson(sums: Column, u: Column) -> Column:
    """The count whose Poisson interval holds ``u``: how many cumulated chances are at or below it."""
    return F.size(F.filter(sums, lambda c: c <= u)).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, source_col: str = "source") -> DataFrame:
    """``(source, rows, mean)``: documents of a source and expected copies of each, one row per source.

    A source's share of ``total`` rows (all rows by default) is its weight among
    the sources that are there; without weights all get the same share.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        weight = F.lit(1.0)
    elif weights:
        weight = F.coalesce(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("source").cast("string")], F.lit(0.0)).cast("double")
    else:
        weight = F.lit(0.0)
    weighed = counts.withColumn("weight", weight)
    sums = weighed.agg(F.sum("weight").alias("weights"), F.sum("rows").alias("all"))
    target = F.lit(float(total)) if total is not None else F.col("all").cast("double")
    both = weighed.join(F.broadcast(sums))  # one row
    return both.select("source", "rows", F.when(F.col("weights") > 0, F.col("weight") / F.col("weights") * target / F.col("rows")).otherwise(0.0).alias("mean"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = 0, partitions: int | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` replicated to target weights and shuffled globally.

    Each document appears as often as a Poisson count says, whose mean is its
    source's target repetition rate (see ``rates``) and whose chance comes from a
    hash of seed and id; so the same input gives the same mixture at any
    partitioning. Rows learn their source's rate where they are read, or for the
    smaller of many sources by ``join_counted``, so no source's rows meet in one
    task; then they are shuffled once, by the order of the mixture. Added columns: ``copy``
    (0-based), ``copies`` and ``order_key``, the hash by which rows are dealt to
    partitions and sorted in each. Documents with a count of zero are not in the
    mixture.

    A null source is a source of its own (given weights leave it out). Null ids
    share one chance, and repeated ids have the same count and keys each. Empty
    texts count like others. Columns of ``docs`` are kept; those named as the
    added ones are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    # A table of one row per source: how many parts its mean is the sum of, and a part's cumulated chances.
    parts = F.greatest(F.ceil(F.col("mean") / LARGEST_MEAN), F.lit(1)).cast("int")
    means = rates(docs, weights, total, source_col).where("mean > 0").withColumn("parts", parts)
    means = Written(means.withColumn("sums", poisson_sums(F.col("mean") / F.col("parts"))).select("source", "rows", "parts", "sums"), "rates")
    plain = [c for c in docs.columns if c not in ("copy", "copies", "order_key")]
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    whole = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(plain)))
    # The first chance is a column of its own, worked out once per row, not at every step of the count.
    rows = docs.select(F.col(source_col).alias("source"), key.alias("key"), whole.alias("whole"), uniform(F.lit(seed), key, F.lit(0)).alias("u"))
    met = join_counted(rows, means.df, ["source"], "rows", "key").where("sums IS NOT NULL")
    rest = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda i: poisson(F.col("sums"), uniform(F.lit(seed), F.col("key"), i))), F.lit(0).cast("long"), lambda a, b: a + b)
    first = poisson(F.col("sums"), F.col("u"))
    counted = met.withColumn("copies", F.when(F.col("parts") == 1, first).otherwise(first + rest)).where("copies > 0")
    each = counted.select("key", "whole", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "key", F.col("copy").cast("string"), F.lit("order")))
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = each.select("whole", "copy", "copies", order.alias("order_key")).repartition(count, "order_key").sortWithinPartitions("order_key")
    return dealt.select(*(F.col(f"whole.c{i}").alias(c) for i, c in enumerate(plain)), "copy", "copies", "order_key")
