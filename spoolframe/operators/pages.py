"""Pages as ordered rows: merge, insert, remove, reorder, renumber and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key


def number(pages: DataFrame, key: list[str], order: list[Column | str], name: str = "pos") -> DataFrame:
    """Pages with 0-based positions in each document."""
    return pages.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def merge(parts: DataFrame, document: str, source_order: str, index: str) -> DataFrame:
    """The pages of several sources one after the other."""
    return number(parts, [document], [source_order, index])


def insert(pages: DataFrame, added: DataFrame, document: str, at: int) -> DataFrame:
    """``added`` before position ``at`` of each document; both have ``pos``."""
    sized = added.groupBy(document).agg(F.count("*").cast("int").alias("more__"))
    moved = pages.join(sized, document, "left").withColumn("pos", F.when(F.col("pos") >= at, F.col("pos") + F.coalesce("more__", F.lit(0))).otherwise(F.col("pos"))).drop("more__")
    return moved.unionByName(added.withColumn("pos", F.col("pos") + at))


def remove(pages: DataFrame, gone: DataFrame, document: str) -> DataFrame:
    """Pages without those at (document, pos) in ``gone``, numbered anew. A document that loses all is not in the result."""
    kept = pages.join(gone.select(document, "pos").distinct(), [document, "pos"], "left_anti")
    return number(kept.withColumnRenamed("pos", "old_pos"), [document], ["old_pos"])


def emptied(pages: DataFrame, gone: DataFrame, document: str) -> DataFrame:
    """Documents that a removal would leave without pages; callers refuse these."""
    return pages.select(document).distinct().join(remove(pages, gone, document).select(document).distinct(), document, "left_anti")


def reorder(pages: DataFrame, order: DataFrame, document: str) -> DataFrame:
    """Pages in the order that (document, pos, new_pos) gives; see ``bad_orders``."""
    return pages.join(order, [document, "pos"]).withColumnRenamed("pos", "old_pos").withColumnRenamed("new_pos", "pos")


def bad_orders(pages: DataFrame, order: DataFrame, document: str) -> DataFrame:
    """Documents whose order does not name each page exactly once."""
    have = pages.groupBy(document).agg(F.count("*").alias("n"))
    said = order.groupBy(document).agg(F.count("*").alias("k"), F.count_distinct("pos").alias("d"), F.count_distinct("new_pos").alias("e"), F.min("new_pos").alias("lo"), F.max("new_pos").alias("hi"))
    fine = (F.col("k") == F.col("n")) & (F.col("d") == F.col("n")) & (F.col("e") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)
    return have.join(said, document, "left").where(~F.coalesce(fine, F.lit(False))).select(document)


def assemble(references: DataFrame, pages: DataFrame) -> DataFrame:
    """References (document, pos, source, index) with their pages; one that names no page keeps a null ``found``."""
    found = pages.withColumn("found", F.lit(True))
    return references.join(found, ["source", "index"], "left")


def page_names(pages: DataFrame, document: str, ext: Column) -> DataFrame:
    """1-based names padded to the digits of the count, three at least."""
    w = Window.partitionBy(document)
    width = F.greatest(F.lit(3), F.length((F.max("pos").over(w) + 1).cast("string")))
    return pages.withColumn("name", F.concat(F.lpad((F.col("pos") + 1).cast("string"), width, F.lit("0")), F.lit("."), ext))


def unique_names(rows: DataFrame, name: str, order: list[str], folded: bool = False, out: str = "unique_name") -> DataFrame:
    """name, name-2, name-3 for repeats, in order; ``folded`` compares in lower case.

    A number that would meet a name given as such (x-2 beside two of x) is
    written with two hyphens, as no given name may be taken.
    """
    base = F.lower(F.col(name)) if folded else F.col(name)
    keyed = rows.withColumn("base__", base)
    ranked = keyed.withColumn("n__", F.row_number().over(Window.partitionBy("base__").orderBy(*order)))
    given = ranked.select(F.col("base__").alias("given__")).distinct()
    wanted = ranked.withColumn("want__", F.concat("base__", F.lit("-"), F.col("n__").cast("string")))
    met = wanted.join(given, F.col("want__") == F.col("given__"), "left")
    mark = F.when(F.col("given__").isNotNull(), "--").otherwise("-")
    return met.withColumn(out, F.when(F.col("n__") == 1, F.col(name)).otherwise(F.concat(F.col(name), mark, F.col("n__").cast("string")))).drop("base__", "n__", "want__", "given__")


def frame_order(rows: DataFrame, name: str) -> DataFrame:
    """Frames of a folder in natural order (img2 before img10)."""
    return rows.withColumn("frame_key", natural_key(F.col(name)))


def archive_order(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Archive members in plain byte order of their names, which differs from frames by design."""
    return number(rows, [key], [name])


def limited(rows: DataFrame, key: str, order: list[str], most: int = 500) -> DataFrame:
    """The first ``most`` rows of each key and whether there were more."""
    w = Window.partitionBy(key)
    ranked = rows.withColumn("n__", F.row_number().over(w.orderBy(*order)))
    return ranked.withColumn("truncated", F.max("n__").over(w) > most).where(F.col("n__") <= most).drop("n__")
