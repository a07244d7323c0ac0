"""Queries over the shared tables: roll-ups, pages, matching and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching, pages, summary
from .selection import table


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("code"), F.octet_length("props").alias("size"))


def tag_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.census(_tags(spark, sf_dir), "code", F.col("size"))


def omission_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as noted omissions, views and clicks as kinds that are left out."""
    t = _tags(spark, sf_dir)
    noted = t.where("code = 'error'").select(F.lit("error").alias("what"), F.when(F.col("event_id") % 2 == 0, "malformed").otherwise("too large").alias("reason"), F.col("size").cast("long").alias("bytes"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("detail"), F.col("event_id").alias("pos"))
    counted = summary.census(t, "code", F.col("size")).withColumnRenamed("code", "what")
    kind = F.when(F.col("what") == "view", "vector artwork").when(F.col("what") == "click", "script")
    return summary.omissions(noted, counted, kind, {"script": "code is not run"})


def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's days as files, their events as tags."""
    c = F.col("code")
    e = table(spark, sf_dir, "events").select(F.concat_ws(" ", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("file"), "event_id", F.col("event_type").alias("code"))
    return summary.verdict(e, "file", (c == "purchase") & (F.col("event_id") % 2 == 0), c == "purchase", c == "view", c == "error")


def bulk_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outcome per document: short texts fail, some are cancelled, others give their length."""
    d = table(spark, sf_dir, "documents")
    n = F.octet_length("text")
    return summary.outcomes(d.select("doc_id", "text"), "doc_id", n, n < 500, F.col("doc_id") % 50 == 0, F.concat(F.lit("too short: "), n.cast("string")))


def bulk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.report(bulk_outcomes(spark, sf_dir), "value")


def bitrate_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: track rates where known, else size over duration."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "A", F.floor("l_extendedprice")).alias("rate"), F.lit(1000000).cast("long").alias("size"), F.col("l_quantity").alias("seconds"))
    got = summary.estimated_bitrate(li, "l_orderkey", "rate", "size", "seconds")
    return got.select("l_orderkey", F.round("bitrate", 3).alias("bitrate"))


def complete_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_discount") < 0.09, F.floor("l_extendedprice")).alias("bytes"))
    return summary.complete_sum(li, "l_orderkey", "bytes")


def progress_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", F.when(F.col("l_discount") < 0.09, F.col("l_quantity")).alias("size"))
    return summary.weights(li, "l_orderkey", "size").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", F.round("weight", 9).alias("weight"))


def progress_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as parts of an order's download: bytes done where a size is known, else pieces."""
    w = progress_weights(spark, sf_dir)
    parts = w.withColumns({"done": F.col("l_extendedprice") / 2, "total": F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice")), "pieces_done": F.col("l_linenumber").cast("double"), "pieces": F.lit(8.0)})
    got = summary.overall_progress(parts, "l_orderkey", "l_linenumber", "weight", "done", "total", "pieces_done", "pieces")
    return got.select("l_orderkey", F.round(F.col("fraction") + 1e-9, 6).alias("fraction"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    return pages.number(c, ["conv_id"], ["turn", "role", "size"])


def page_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose every third page goes."""
    p = _pages(spark, sf_dir)
    return pages.remove(p, p.where("pos % 3 = 1"), "conv_id").select("conv_id", "old_pos", "pos", "size")


def page_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in reverse; documents with a page named twice would be refused."""
    p = _pages(spark, sf_dir)
    last = p.groupBy("conv_id").agg(F.max("pos").alias("last"))
    order = p.join(last, "conv_id").select("conv_id", "pos", (F.col("last") - F.col("pos")).alias("new_pos"))
    return pages.reorder(p, order, "conv_id").select("conv_id", "old_pos", "pos", "role")


def page_bad_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose order is no permutation: even ones name page 0 twice."""
    p = _pages(spark, sf_dir)
    order = p.select("conv_id", F.when((F.col("conv_id") % 2 == 0) & (F.col("pos") == 1), 0).otherwise(F.col("pos")).alias("pos"), F.col("pos").alias("new_pos"))
    return pages.bad_orders(p, order, "conv_id")


def page_merge_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations merged ten at a time, with page names."""
    p = _pages(spark, sf_dir).select(F.floor(F.col("conv_id") / 10).alias("book"), "conv_id", F.col("pos").alias("index"), "role")
    merged = pages.merge(p, "book", "conv_id", "index")
    return pages.page_names(merged, "book", F.lit("jpg")).select("book", "conv_id", "index", "pos", "name")


def page_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The system's pages of a conversation set in again at position 1."""
    p = _pages(spark, sf_dir).select("conv_id", "pos", "role")
    again = pages.number(p.where("pos >= 2").drop("pos"), ["conv_id"], ["role"]).select("conv_id", "pos", F.concat(F.lit("again "), "role").alias("role"))
    return pages.insert(p, again, "conv_id", 1)


def unique_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers' segments made unique without regard to case."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).when(F.col("c_custkey") == 7, F.concat("c_mktsegment", F.lit("-3"))).otherwise(F.col("c_mktsegment")).alias("name"))
    return pages.unique_names(c, "name", ["c_custkey"], folded=True).select("c_custkey", "unique_name")


def release_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names within longer made-up release names of suppliers' nations' customers."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    long = c.select(F.col("c_custkey").alias("long_key"), F.concat(F.lit("x."), "c_name", F.lit(".1080p")).alias("release"))
    return matching.release_matches(c, long, "c_name", "release").select("c_custkey", "long_key")


def best_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best two events of every type and user's language group, as subtitle candidates."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("lang"), "event_type", "event_id", "value")
    order = matching.subtitle_order((F.col("event_id") % 4 == 0).cast("int"), (F.col("event_id") % 7 == 0).cast("int"), F.floor("value"), F.col("event_id"))
    return matching.best_per(e, ["lang", "event_type"], order, 2).select("lang", "event_type", "event_id")


def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists per nation, customers and suppliers, in turns."""
    c = pages.number(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id")), ["nation"], ["id"])
    s = pages.number(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id")), ["nation"], ["id"])
    return matching.interleave(c, s, ["nation"], "pos").select("nation", "turn", "side", "id")


def readback_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as written and read again: the first field that differs."""
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey") % 5
    fields = {
        "status": (F.col("o_orderstatus"), F.when(n == 0, "?").otherwise(F.col("o_orderstatus"))),
        "comment": (matching.blank_to_null(F.lit(" ")), F.lit(None).cast("string")),
        "priority": (F.col("o_orderpriority"), F.when(n == 1, None).otherwise(F.col("o_orderpriority"))),
        "price": (F.floor("o_totalprice"), F.floor(F.col("o_totalprice") + F.when(n == 2, 1).otherwise(0))),
    }
    return matching.first_difference(o, fields).select("o_orderkey", "difference")


def policy_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata maps of parts under every policy."""
    p = table(spark, sf_dir, "part")
    m = F.create_map(F.lit("gps.Latitude"), F.col("p_size").cast("string"), F.lit("tiff.Make"), F.col("p_brand"), F.lit("tiff.Orientation"), F.lit("1"), F.lit("iptc.City"), F.col("p_type"), F.lit("exif.Software"), F.lit("s"))
    keys = lambda c: F.array_join(F.array_sort(F.map_keys(c)), ",")
    return p.select(
        "p_partkey", keys(matching.apply_policy(m, "keep", structural=["tiff.Orientation"])).alias("kept"), keys(matching.apply_policy(m, "strip", forced=["tiff.Orientation"])).alias("stripped"),
        keys(matching.apply_policy(m, "classes", ["gps", "software"])).alias("classed"), keys(matching.apply_policy(m, "allow", ["tiff.*"])).alias("allowed"), matching.apply_policy(m, "allow", ["tiff.Make"])["tiff.Make"].alias("make"),
    )


def language_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted recognition languages resolved to offered ones."""
    n = table(spark, sf_dir, "nation")
    wanted = F.array(F.when(F.col("n_nationkey") % 3 == 0, "EN-us").otherwise("en-AU"), F.when(F.col("n_nationkey") % 2 == 0, "de").otherwise("xx"))
    offered = F.array(F.lit("fr-FR"), F.lit("en-US"), F.lit("en-GB"), F.lit("de-DE"))
    return n.select("n_nationkey", F.array_join(matching.resolve_languages(wanted, offered), ",").alias("languages"))


def queue_new_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of pages that are not queued yet; those with a 7 are."""
    p = table(spark, sf_dir, "pages")
    lines = p.select(F.concat_ws(" ", "url", F.lit("not-a-url"), "url").alias("text"))
    return matching.new_urls(lines, p.where(F.col("url").contains("7")).select("url"))


FUNCTIONS = (tag_census, omission_rollup, verdict, bulk_outcomes, bulk_report, bitrate_estimate, complete_sizes, progress_weights, progress_overall, page_remove, page_reorder, page_bad_orders, page_merge_names, page_insert, unique_destinations, release_matches, best_subtitles, interleaved, readback_difference, policy_projection, language_choice, queue_new_urls)
QUERIES = {f.__name__: f for f in FUNCTIONS}

_PAGES_SQL = "p AS (SELECT conv_id, turn, role, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text)) - 1 AS pos FROM conversations)"
_OUTCOME_SQL = """o AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'cancelled' WHEN strlen(text) < 500 THEN 'failed' ELSE 'succeeded' END AS status, strlen(text) AS n FROM documents)"""

ORACLES = {
    "tag_census": "SELECT event_type AS code, count(*) AS n, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY event_type",
    "omission_rollup": """
WITH e AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'malformed' ELSE 'too large' END AS reason FROM events WHERE event_type = 'error')
SELECT 'error' AS what, reason, count(*) AS n, CAST(sum(strlen(props)) AS BIGINT) AS bytes, 'event ' || min(event_id) FILTER (event_id % 3 = 0) AS detail FROM e GROUP BY reason
UNION ALL SELECT event_type, CASE event_type WHEN 'view' THEN 'vector artwork' ELSE 'script' END, count(*), CAST(sum(strlen(props)) AS BIGINT), CASE event_type WHEN 'click' THEN 'code is not run' END FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type""",
    "verdict": """
SELECT user_id || ' ' || strftime(ts, '%Y-%m-%d') AS file, CASE WHEN bool_or(event_type = 'purchase' AND event_id % 2 = 0) THEN 'media recovered' WHEN bool_or(event_type = 'purchase') THEN 'media found but unrecoverable' WHEN bool_or(event_type = 'view') THEN 'vector or script only'
  WHEN bool_or(event_type = 'error') THEN 'unrecognised content' ELSE 'empty' END AS verdict FROM events GROUP BY ALL""",
    "bulk_outcomes": f"WITH {_OUTCOME_SQL} SELECT doc_id, status, CASE status WHEN 'succeeded' THEN n END AS value, CASE status WHEN 'failed' THEN 'too short: ' || n END AS error FROM o",
    "bulk_report": f"WITH {_OUTCOME_SQL} SELECT count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled, bool_and(status = 'succeeded') AS all_succeeded, CAST(sum(n) FILTER (status = 'succeeded') AS BIGINT) AS bytes FROM o",
    "bitrate_estimate": "SELECT l_orderkey, round(coalesce(sum(floor(l_extendedprice)) FILTER (l_returnflag = 'A'), 8000000.0 / max(l_quantity)), 3) AS bitrate FROM lineitem GROUP BY l_orderkey",
    "complete_sizes": "SELECT l_orderkey, CASE WHEN count(*) FILTER (l_discount < 0.09) = count(*) THEN CAST(sum(floor(l_extendedprice)) AS BIGINT) END AS bytes FROM lineitem GROUP BY l_orderkey",
    "progress_weights": """
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, round(CASE WHEN count(*) FILTER (l_discount < 0.09) OVER w = count(*) OVER w THEN l_quantity / sum(l_quantity) OVER w ELSE 1.0 / count(*) OVER w END, 9) AS weight FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""",
    "progress_overall": """
WITH w AS (SELECT *, CASE WHEN count(*) FILTER (l_discount < 0.09) OVER w = count(*) OVER w THEN l_quantity / sum(l_quantity) OVER w ELSE 1.0 / count(*) OVER w END AS weight FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, round(sum(weight * CASE WHEN l_linenumber % 3 <> 0 THEN 0.5 ELSE l_linenumber / 8.0 END) + 1e-9, 6) AS fraction FROM w GROUP BY l_orderkey""",
    "page_remove": f"WITH {_PAGES_SQL} SELECT conv_id, pos AS old_pos, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS pos, size FROM p WHERE pos % 3 <> 1",
    "page_reorder": f"WITH {_PAGES_SQL} SELECT conv_id, pos AS old_pos, max(pos) OVER (PARTITION BY conv_id) - pos AS pos, role FROM p",
    "page_bad_orders": "SELECT conv_id FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id HAVING count(*) > 1",
    "page_merge_names": f"""
WITH {_PAGES_SQL}, m AS (SELECT conv_id // 10 AS book, conv_id, pos AS index, row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id, pos) - 1 AS pos, count(*) OVER (PARTITION BY conv_id // 10) AS n FROM p)
SELECT book, conv_id, index, pos, lpad(CAST(pos + 1 AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') || '.jpg' AS name FROM m""",
    "page_insert": f"""
WITH {_PAGES_SQL}, n AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY role) - 1 AS pos FROM p WHERE pos >= 2), k AS (SELECT conv_id, count(*) AS k FROM n GROUP BY conv_id)
SELECT conv_id, CASE WHEN pos >= 1 THEN pos + coalesce(k, 0) ELSE pos END AS pos, role FROM p LEFT JOIN k USING (conv_id) UNION ALL SELECT conv_id, pos + 1, 'again ' || role FROM n""",
    "unique_destinations": """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) WHEN c_custkey = 7 THEN c_mktsegment || '-3' ELSE c_mktsegment END AS name FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY c_custkey) AS n FROM c)
SELECT c_custkey, CASE WHEN n = 1 THEN name WHEN lower(name) || '-' || n IN (SELECT lower(name) FROM c) THEN name || '--' || n ELSE name || '-' || n END AS unique_name FROM r""",
    "release_matches": """
WITH a AS (SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS k FROM customer), b AS (SELECT c_custkey AS long_key, regexp_replace(lower('x.' || c_name || '.1080p'), '[^a-z0-9]', '', 'g') AS k FROM customer)
SELECT c_custkey, long_key FROM a, b WHERE length(a.k) >= 8 AND length(b.k) >= 8 AND (contains(b.k, a.k) AND length(a.k) >= length(b.k) / 2.0 OR contains(a.k, b.k) AND length(b.k) >= length(a.k) / 2.0)""",
    "best_subtitles": """
WITH r AS (SELECT user_id % 10 AS lang, event_type, event_id, row_number() OVER (PARTITION BY user_id % 10, event_type ORDER BY event_id % 4 = 0, event_id % 7 = 0 DESC, floor(value) DESC, event_id) AS n FROM events)
SELECT lang, event_type, event_id FROM r WHERE n <= 2""",
    "interleaved": """
WITH b AS (SELECT c_nationkey AS nation, c_custkey AS id, 0 AS side, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos FROM customer
  UNION ALL SELECT s_nationkey, s_suppkey, 1, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) FROM supplier)
SELECT nation, row_number() OVER (PARTITION BY nation ORDER BY pos, side) - 1 AS turn, side, id FROM b""",
    "readback_difference": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'status' WHEN 1 THEN 'priority' WHEN 2 THEN 'price' END AS difference FROM orders",
    "policy_projection": """
SELECT p_partkey, 'exif.Software,gps.Latitude,iptc.City,tiff.Make' AS kept, 'tiff.Orientation' AS stripped, 'tiff.Make,tiff.Orientation' AS classed, 'tiff.Make,tiff.Orientation' AS allowed, p_brand AS make FROM part""",
    "language_choice": "SELECT n_nationkey, 'en-US' || CASE WHEN n_nationkey % 2 = 0 THEN ',de-DE' ELSE '' END AS languages FROM nation",
    "queue_new_urls": "SELECT DISTINCT url FROM pages WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/ ]+') AND NOT contains(url, '7')",
}
