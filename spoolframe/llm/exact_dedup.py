"""Exact dedup by distributed MSD radix partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, join_counted

#: Bytes that the first digit takes, and by how much each next digit is wider.
FIRST_DIGIT, WIDER = 32, 32
#: Bits by which rows that are alone in their first digit are told; at most an eighth of a million words are broadcast.
FILTER_BITS = 1 << 23


def normalised(text: Column) -> Column:
    """Each run of 0x20, 0x09-0x0D as one space; null as empty.

    The pattern skips runs that are one space already, most of all runs.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _bytes(text: Column) -> Column:
    return F.encode(normalised(text), "UTF-8")


def _settled(rows: DataFrame, text: str, closed: Column, first_digit: int, wider: int) -> list[DataFrame]:
    """Levels of ``rows(id, carried)`` as ``(id, carried, n, label)``: each row once, when its group is settled.

    ``n`` is the size of the row's group of equal texts and ``label`` its
    smallest id. ``text`` names the text in ``carried``, and ``closed`` is what
    is left of ``carried`` once the row's group is settled.
    """
    content = _bytes(F.col(text))
    first = rows.select("id", "carried", content.alias("raw"))
    first = first.select("id", "carried", F.octet_length("raw").cast("long").alias("size"), F.substring("raw", 1, first_digit).alias("digit"))
    counts = Written(first.groupBy("size", "digit").agg(F.count("*").alias("n"), F.min("id").alias("label")).where("n > 1"), "digits")
    # A bit for each hash of a group's first digit: rows whose bit is not set are alone, and what is closed of them goes on.
    slot = F.pmod(F.xxhash64("size", "digit"), F.lit(FILTER_BITS))
    words = counts.df.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("bits"))
    marked = first.withColumn("slot", slot).withColumn("place", F.floor(F.col("slot") / 64)).join(F.broadcast(words), F.col("place") == F.col("word"), "left")
    alone = F.coalesce(F.expr("shiftright(bits, cast(slot % 64 AS int)) & 1"), F.lit(0)) == 0
    sent = marked.select("id", F.when(alone, closed).otherwise(F.col("carried")).alias("carried"), "size", "digit")
    met = join_counted(sent, counts.df, ["size", "digit"], "n", "id", rows.count())

    def settle(met: DataFrame, seen: int, group: str) -> Written:
        known = met.withColumns({"n": F.coalesce("n", F.lit(1)), "label": F.coalesce("label", "id")}).withColumn("open", (F.col("n") > 1) & (F.col("size") > seen))
        return Written(known.select("id", F.when(F.col("open"), F.col("carried")).otherwise(closed).alias("carried"), "size", "n", "label", "open", F.when(F.col("open"), F.col(group)).alias("group"), "row"), "radix")

    # Ids may be repeated or null, so a group is known by its first digit and then by the smallest number of its rows.
    level = settle(met.withColumn("row", F.monotonically_increasing_id()), first_digit, "digit")
    counts.drop()
    done, seen, digit = [level], first_digit, first_digit * wider
    while not (still := done[-1].df.where("open")).isEmpty():
        cut = still.select("id", "carried", "size", "group", "row", F.substring(content, seen + 1, digit).alias("digit"))
        counts = Written(cut.groupBy("group", "size", "digit").agg(F.count("*").alias("n"), F.min("id").alias("label"), F.min("row").alias("next")), "digits")
        seen += digit
        done.append(settle(join_counted(cut, counts.df, ["group", "size", "digit"], "n", "row", still.count()), seen, "next"))
        counts.drop()
        digit *= wider
    return [d.df.where("NOT open").select("id", "carried", "n", "label") for d in done]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT, wider: int = WIDER) -> DataFrame:
    """``(id, keep_id, group_size, text_sha256)``, one row per input row.

    Texts are equal when their normalised bytes are. The first digit is the byte
    length with the first ``first_digit`` bytes; each level splits every group
    that is still open by the next bytes, in digits ``wider`` times as wide as
    the last, until groups are singletons or their texts have ended. Groups
    are told apart by bytes and row numbers, not digests: equality is decided on
    the bytes alone (the SHA-256 column is only reported). Counting a digit
    combines before the shuffle, so a group that holds a third of all rows sends
    one row per task. Rows learn their group's count by ``join_counted``, which
    brings the rows of no group to one task. A filter of fixed size tells most
    rows that are alone in their first digit, so their texts are not sent; where
    it is full, more are sent and nothing else changes. Only the texts of open
    groups go on to the next level.

    Null text counts as empty; empty texts are equal. Rows with the same id are
    rows of their own: ``group_size`` counts rows and ``keep_id`` is the smallest
    id, a null id counting as larger than any. Other columns are ignored. An
    empty table gives an empty result.
    """
    t = normalised(F.col(text_col).cast("string"))
    out = None
    carried = F.struct(t.alias("text"), F.sha2(t, 256).alias("sha"))
    closed = F.struct(F.lit(None).cast("string").alias("text"), F.col("carried.sha").alias("sha"))
    for part in _settled(docs.select(F.col(id_col).cast("long").alias("id"), carried.alias("carried")), "carried.text", closed, first_digit, wider):
        out = part if out is None else out.unionAll(part)
    return out.select(F.col("id").alias(id_col), F.col("label").alias("keep_id"), F.col("n").alias("group_size"), F.col("carried.sha").alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the smallest id.

    Where that id itself is repeated with the same text, one of its rows stays.
    A null id is larger than any other. Rows go through the levels of
    ``exact_groups`` whole, so their texts are shuffled once. Null and empty
    texts are equal; an empty table stays empty.
    """
    whole = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole.alias("carried"))
    text = f"carried.c{docs.columns.index(text_col)}"
    names = [F.col(f"carried.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    out = None
    for part in _settled(rows, text, F.col("carried"), FIRST_DIGIT, WIDER):
        kept = part.where(F.col("id").eqNullSafe(F.col("label")))
        once = kept.where("n = 1").select("carried")
        # Of a larger group a repeated id, or null ids alone, may have left several rows.
        several = kept.where("n > 1").select("id", _bytes(F.col(text)).alias("same"), "carried").dropDuplicates(["id", "same"]).select("carried")
        both = once.unionAll(several)
        out = both if out is None else out.unionAll(both)
    return out.select(*names)
