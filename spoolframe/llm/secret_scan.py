"""Secret scans with corpus-wide ownership, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import prefix_sums
from .common import Written

#: Base kinds in their order: (kind, pattern, group that holds the value, fewest characters of it).
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: A quick test that a text has any match that can pass.
_ANY = {"access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: Runs that fail by their length do not shift later matches of these kinds, so they need not be found.
_SHORT = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Candidates without a keyword: runs of 32 or more characters, of both cases and with digits.
BARE = r"[A-Za-z0-9+/_-]{32,}"
#: A candidate is live-looking if no more owners and repositories than these hold its value.
MOST_OWNERS, MOST_REPOSITORIES = 1, 3


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, fewest: int) -> Column:
    """Matches of a pattern as structs, with code-point positions.

    Splitting at the matches gives the gaps between them, so a match starts after
    the gaps and matches before it; their running totals cost little more than
    the number of matches.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(whole, F.length)
    ends = prefix_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), sizes, lambda g, s: g + s))
    rows = F.arrays_zip(ends.alias("stop"), sizes.alias("size"), value.alias("value"))
    found = F.transform(
        rows,
        lambda x: F.struct((x["stop"] - x["size"]).alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop"), F.lit(kind).alias("kind"), x["value"].alias("value")),
    )
    return F.filter(found, lambda x: F.length(x["value"]) >= fewest)


_TYPE = "array<struct<start:int,rank:int,stop:int,kind:string,value:string>>"


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind in its order."""
    parts = []
    for rank, (kind, pattern, group, fewest) in enumerate(BASE):
        quick = text.rlike(_ANY.get(kind, pattern))
        spans = _spans(text, kind, rank, _SHORT.get(kind, pattern), group, fewest)
        parts.append(F.when(quick, spans.cast(_TYPE)).otherwise(F.array().cast(_TYPE)))
    return F.array_sort(F.concat(*parts))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """``(id, base, live)`` per row: base spans, and the spans of owner-specific candidates.

    ``base`` and ``live`` are arrays of (start, rank, stop, kind, value); positions
    count code points, the end is exclusive. Candidates are the values of base
    spans and bare runs of 32 or more characters of both cases and with digits.
    Each value's distinct owners and repositories are counted over the corpus. A
    value that more than ``most_owners`` owners or ``most_repositories``
    repositories hold is a copied example; any other is live-looking and gets a
    ``live`` span over its value. Where no repository column is named each row is
    a repository of its own.

    Counting is by value hash (SHA-256) and combines before each shuffle, so a
    value in a third of all rows sends one row per task and owner. Only rows with
    candidates, without their texts, take part; no text is shuffled. Row numbers
    tie the parts together, so repeated rows and null ids are rows of their own.
    Null text counts as empty, a null owner as an owner of its own. Other columns
    are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mixed = lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]")
    bare = F.when(text.rlike(BARE), F.filter(_spans(text, "live", 3, BARE, 0, 32).cast(_TYPE), mixed)).otherwise(F.array().cast(_TYPE))
    repository = F.col(repository_col).cast("string") if repository_col else F.lit(None).cast("string")
    owner = F.col(owner_col).cast("string") if owner_col in docs.columns else F.lit(None).cast("string")
    scanned = docs.select(F.col(id_col).cast("long").alias("id"), owner.alias("owner"), repository.alias("repository"), base_spans(text).alias("base"), bare.alias("bare"))
    scanned = scanned.withColumn("row", F.monotonically_increasing_id())
    rows = Written(scanned, "secrets").df

    valued = F.transform("base", lambda x: F.struct((F.when(x["kind"] == "assign", x["stop"] - F.length(x["value"])).otherwise(x["start"])).alias("start"), F.lit(3).alias("rank"), x["stop"].alias("stop"), F.lit("live").alias("kind"), x["value"].alias("value")))
    candidates = rows.where("size(base) > 0 OR size(bare) > 0").select("row", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.col("row").cast("string")).alias("repository"), F.explode(F.concat(valued.cast(_TYPE), "bare")).alias("span"))
    candidates = candidates.withColumn("hash", F.sha2("span.value", 256))
    kept_by = candidates.groupBy("hash", "owner", "repository").agg(F.count("*").alias("uses")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    held = kept_by.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    held = held.where((F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)).select("hash")
    live = candidates.join(held, "hash").groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("live"))
    joined = rows.join(live.withColumnRenamed("row", "live_row"), F.col("row") == F.col("live_row"), "left")
    return joined.select(F.col("id").alias(id_col), "base", F.coalesce("live", F.array().cast(_TYPE)).alias("live"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Counts and span lists per row: ``n_assign, n_access, n_hex, base_sha256, spans``.

    Null and empty texts have no span: zero counts, empty ``spans``. Repeated rows
    and null ids are rows of their own; spans that start together stand in the
    order of their kinds. An empty table gives an empty result.
    """
    found = secret_scan(docs, id_col, text_col, owner_col)
    counts = [_count(kind).alias(f"n_{kind}") for kind, *_ in BASE]
    return found.select(id_col, *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "live"))).alias("spans"))
