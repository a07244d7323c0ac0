"""Queries over the shared tables: renditions, signals and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import formats, signals, timeline


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose narrow rows are dealt to all tasks by their key, before each is made into a file, a picture or checks.

    A packed table of a million rows is a few megabytes, which Spark reads in one
    or two tasks; the work on a row is not in proportion to its bytes there.
    """
    return table(spark, sf_dir, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def micros(column: str) -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def _lineitem_renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as renditions of their order: R has both tracks, N video only, A audio only."""
    li = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    return li.select(
        F.col("l_orderkey").alias("listing_id"), F.col("l_linenumber").alias("pos"), F.col("l_linenumber").cast("string").alias("format_id"),
        F.when(F.col("l_linestatus") == "O", "mp4").otherwise("webm").alias("ext"), F.when(F.col("l_tax") > 0.07, "m3u8").otherwise("https").alias("protocol"),
        F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"),
        F.when(flag == "A", None).otherwise((F.col("l_quantity") * 40).cast("long")).alias("width"), F.when(flag == "A", None).otherwise((F.col("l_quantity") * 20).cast("long")).alias("height"),
        F.lit(None).cast("double").alias("fps"),
        F.when(flag == "A", "none").when(F.col("l_suppkey") % 5 == 0, "vp9").when(F.col("l_suppkey") % 5 == 1, None).otherwise("avc1.640028").alias("vcodec"),
        F.when(flag == "N", "none").when(F.col("l_suppkey") % 7 == 0, "opus").otherwise("mp4a.40.2").alias("acodec"),
        F.col("l_extendedprice").alias("tbr"), F.lit(None).cast("double").alias("vbr"), F.lit(None).cast("double").alias("abr"), F.lit(None).cast("double").alias("asr"), F.lit(None).cast("long").alias("audio_channels"),
        F.when(F.col("l_discount") > 0.08, None).otherwise((F.col("l_extendedprice") * 100).cast("long")).alias("filesize"), F.lit(None).cast("long").alias("filesize_approx"),
        F.lit(None).cast("string").alias("language"), (F.col("l_partkey") % 11 == 0).alias("has_drm"),
    )


_RENDITIONS_SQL = """
r AS (SELECT l_orderkey AS listing_id, l_linenumber AS pos, CAST(l_linenumber AS VARCHAR) AS format_id,
  CASE WHEN l_linestatus = 'O' THEN 2 ELSE 0 END + 0 AS ext_rank, l_tax <= 0.07 AS http,
  CASE WHEN l_returnflag <> 'A' THEN CAST(trunc(l_quantity * 40) AS BIGINT) END AS width, CASE WHEN l_returnflag <> 'A' THEN CAST(trunc(l_quantity * 20) AS BIGINT) END AS height,
  CASE WHEN l_returnflag = 'A' THEN 'none' WHEN l_suppkey % 5 = 0 THEN 'vp9' WHEN l_suppkey % 5 = 1 THEN NULL ELSE 'avc1' END AS vcodec,
  CASE WHEN l_returnflag = 'N' THEN 'none' WHEN l_suppkey % 7 = 0 THEN 'opus' ELSE 'mp4a' END AS acodec,
  l_extendedprice AS tbr, CASE WHEN l_discount <= 0.08 THEN CAST(trunc(l_extendedprice * 100) AS BIGINT) END AS bytes, l_partkey % 11 = 0 AS drm
  FROM lineitem),
k AS (SELECT *, coalesce(vcodec, '') <> 'none' AS hv, coalesce(acodec, '') <> 'none' AS ha, NOT drm AND (height IS NULL OR height <= {cap}) AS ok FROM r),
v AS (SELECT *, row_number() OVER (PARTITION BY listing_id, g ORDER BY coalesce(height, 0) DESC, coalesce(width * height, 0) DESC, ext_rank DESC, tbr DESC, http DESC, pos) AS n FROM (
  SELECT *, 'pre' AS g FROM k WHERE ok AND hv AND ha
  UNION ALL SELECT *, 'v1' FROM k WHERE ok AND hv AND NOT ha AND vcodec = 'avc1' AND http
  UNION ALL SELECT *, 'v2' FROM k WHERE ok AND hv AND NOT ha AND (vcodec IS NULL OR vcodec = 'avc1')
  UNION ALL SELECT *, 'vany' FROM k WHERE ok AND hv AND NOT ha) t),
a AS (SELECT *, row_number() OVER (PARTITION BY listing_id, g ORDER BY ext_rank DESC, tbr DESC, http DESC, pos) AS n FROM (
  SELECT *, 'a1' AS g FROM k WHERE ok AND ha AND NOT hv AND acodec = 'mp4a' AND http
  UNION ALL SELECT *, 'a2' FROM k WHERE ok AND ha AND NOT hv AND acodec = 'mp4a'
  UNION ALL SELECT *, 'aany' FROM k WHERE ok AND ha AND NOT hv) t),
l AS (SELECT listing_id, bool_or(ok) AS any_ok, bool_and(drm) AS all_drm, bool_or(hv) AS listed_v, min(height) AS least FROM k GROUP BY listing_id),
j AS (SELECT l.*, p.format_id AS p_id, p.height AS p_h, p.bytes AS p_b, p.pos IS NOT NULL AS has_p,
  coalesce(v1.format_id, v2.format_id) AS v_id, CASE WHEN v1.pos IS NOT NULL THEN v1.height ELSE v2.height END AS v_h, CASE WHEN v1.pos IS NOT NULL THEN v1.bytes ELSE v2.bytes END AS v_b,
  coalesce(a1.format_id, a2.format_id) AS a_id, CASE WHEN a1.pos IS NOT NULL THEN a1.bytes ELSE a2.bytes END AS a_b,
  v1.pos IS NOT NULL AND a1.pos IS NOT NULL AS vetted, vany.pos IS NOT NULL AS any_v, v2.pos IS NOT NULL AS mux_v, aany.format_id AS aa_id, aany.bytes AS aa_b, a2.pos IS NOT NULL AS mux_a
  FROM l LEFT JOIN v p ON p.listing_id = l.listing_id AND p.g = 'pre' AND p.n = 1
  LEFT JOIN v v1 ON v1.listing_id = l.listing_id AND v1.g = 'v1' AND v1.n = 1 LEFT JOIN v v2 ON v2.listing_id = l.listing_id AND v2.g = 'v2' AND v2.n = 1
  LEFT JOIN v vany ON vany.listing_id = l.listing_id AND vany.g = 'vany' AND vany.n = 1
  LEFT JOIN a a1 ON a1.listing_id = l.listing_id AND a1.g = 'a1' AND a1.n = 1 LEFT JOIN a a2 ON a2.listing_id = l.listing_id AND a2.g = 'a2' AND a2.n = 1
  LEFT JOIN a aany ON aany.listing_id = l.listing_id AND aany.g = 'aany' AND aany.n = 1),
d AS (SELECT *, v_id IS NOT NULL AND a_id IS NOT NULL AND NOT (has_p AND (NOT vetted OR coalesce(p_h, 0) >= coalesce(v_h, 0))) AS pair,
  CASE WHEN has_p THEN p_id WHEN NOT listed_v THEN aa_id END AS s_id, CASE WHEN has_p THEN p_h END AS s_h, CASE WHEN has_p THEN p_b WHEN NOT listed_v THEN aa_b END AS s_b FROM j)
SELECT listing_id, CASE WHEN pair THEN 'pair' WHEN s_id IS NOT NULL THEN 'single' ELSE 'none' END AS kind,
  CASE WHEN pair THEN v_id ELSE s_id END AS video_id, CASE WHEN pair THEN a_id END AS audio_id, CASE WHEN pair THEN v_h ELSE s_h END AS height,
  CASE WHEN pair THEN v_b + a_b ELSE s_b END AS bytes,
  CASE WHEN NOT pair AND s_id IS NULL THEN CASE WHEN NOT any_ok THEN CASE WHEN all_drm THEN 'all protected' {over} ELSE 'nothing satisfies the policy' END
    WHEN any_v AND NOT mux_v THEN 'no muxable video codec' WHEN aa_id IS NOT NULL AND NOT mux_a THEN 'no muxable audio codec' WHEN any_v THEN 'no audio to pair with' ELSE 'no video' END END AS reason
FROM d"""


def format_pair_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pair or single rendition of every order."""
    return formats.select_formats(_lineitem_renditions(spark, sf_dir))


def format_capped_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with heights capped at 480."""
    return formats.select_formats(_lineitem_renditions(spark, sf_dir), formats.Policy(max_height=480))


def format_audio_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best audio of every order."""
    return formats.select_formats(_lineitem_renditions(spark, sf_dir), formats.Policy(intent="audio")).select("listing_id", "kind", "video_id")


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as samples: each user is a file, events in order are its frames."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("file_id"), (F.row_number().over(w) - 1).alias("frame"), F.when(F.col("user_id") % 4 == 0, 0.0).otherwise(F.col("value") / 100000).alias("sample"))


def audibility_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = signals.audibility(_signal(spark, sf_dir), rate=10)
    return got.select("file_id", "audible", F.round("loudest_db", 6).alias("loudest_db"), "windows")


def mean_volume_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.mean_volume(_signal(spark, sf_dir)).select("file_id", "state", F.round("mean_db", 6).alias("mean_db"), "n")


def first_adequate_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the first event whose score is enough, else the best."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 500).alias("score"))
    return signals.first_adequate(e, "user_id", "event_id", "score", least=0.5)


def sample_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", micros("ts").cast("double").alias("start"), "value")
    return signals.spacing_factor(e, "user_id", "start", "value").select("user_id", F.format_string("%.6e", "factor").alias("factor"))


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = micros("ts") / 1000000.0
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), start.alias("start"), (start + F.floor("value") * 600).alias("end"), F.col("event_type").alias("text"))


def chapter_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chapters of their user, whose length is the event's value in hours."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("pos"), micros("ts").alias("start"), (F.floor("value") * 3600000000 - 7200000000).alias("duration"), F.lit(1900000000000000).cast("long").alias("total"))
    return timeline.normalise_chapters(e, total="total").select("file_id", "pos", "start", F.col("duration").cast("long").alias("duration"))


def cue_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cues of their user, whose texts overlap for hours."""
    return timeline.flatten_cues(_cues(spark, sf_dir), slot=86400.0).select("doc_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


def cue_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cues on a film of 100 hours per user, from the first event on."""
    c = _cues(spark, sf_dir)
    zero = F.min("start").over(Window.partitionBy("doc_id"))
    c = c.select("doc_id", F.lit(360000000).cast("long").alias("total"), (F.col("start") - zero).alias("start"), (F.col("end") - zero).alias("end"), F.concat_ws(":", "text", "pos").alias("text"))
    return timeline.tile_cues(c, "doc_id", "total")


def coalesce_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = timeline.runs(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])
    return got.select("user_id", "run", "event_type", "n", micros("first").alias("first"), micros("last").alias("last"))


def stream_head_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the latest earlier signup or purchase of its user: heads and blocks of a stream."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    got = timeline.earlier_head(e, "user_id", ["ts", "event_id"], F.col("event_type").isin("signup", "purchase"), "event_id", "head_id")
    return got.where("event_type NOT IN ('signup', 'purchase')").select("event_id", "head_id")


def quality_bisection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand the least retail-price share at which parts pass a size test."""
    p = table(spark, sf_dir, "part").select("p_brand", F.round(F.col("p_retailprice") / 2500, 2).alias("q"), "p_size")
    s = p.groupBy("p_brand", "q").agg((F.max("p_size") >= 25).alias("ok"))
    return signals.bisect_quality(s, "p_brand", "q", "ok")


QUERIES = {f.__name__: f for f in (format_pair_select, format_capped_select, format_audio_select, audibility_by_user, mean_volume_by_user, first_adequate_frame, sample_spacing, chapter_normalise, cue_flatten, cue_tiling, coalesce_runs, stream_head_blocks, quality_bisection)}

_SIGNAL_SQL = "s AS (SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, CASE WHEN user_id % 4 = 0 THEN 0.0 ELSE value / 100000 END AS sample FROM events)"
_CUES_SQL = "c AS (SELECT user_id AS doc_id, event_id AS pos, epoch_us(ts) / 1000000.0 AS s, epoch_us(ts) / 1000000.0 + floor(value) * 600 AS e, event_type AS text FROM events)"

ORACLES = {
    "format_pair_select": "WITH " + _RENDITIONS_SQL.format(cap="1000000000", over=""),
    "format_capped_select": "WITH " + _RENDITIONS_SQL.format(cap="480", over="WHEN least > 480 THEN 'height over 480, least ' || least"),
    "format_audio_select": """
WITH k AS (SELECT l_orderkey AS listing_id, l_linenumber AS pos, l_returnflag = 'A' AS pure, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS ext_rank, l_extendedprice AS tbr, l_tax <= 0.07 AS http,
  l_partkey % 11 <> 0 AND l_returnflag <> 'N' AS fine FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY pure DESC, ext_rank DESC, tbr DESC, http DESC, pos) AS n FROM k WHERE fine)
SELECT o.listing_id, CASE WHEN n.pos IS NULL THEN 'none' ELSE 'single' END AS kind, CAST(n.pos AS VARCHAR) AS video_id FROM (SELECT DISTINCT listing_id FROM k) o LEFT JOIN n ON n.listing_id = o.listing_id AND n.n = 1""",
    "audibility_by_user": f"""
WITH {_SIGNAL_SQL}, w AS (SELECT file_id, floor(frame / 4.0) AS w, max(abs(sample)) AS peak, sqrt(avg(sample * sample)) AS rms FROM s GROUP BY ALL)
SELECT file_id, bool_or(CASE WHEN peak > 0 THEN 20 * log10(peak) ELSE -91 END > -60 AND CASE WHEN rms > 0 THEN 20 * log10(rms) ELSE -91 END > -70) AS audible,
  round(CASE WHEN max(peak) > 0 THEN 20 * log10(max(peak)) ELSE -91 END, 6) AS loudest_db, count(*) AS windows FROM w GROUP BY file_id""",
    "mean_volume_by_user": f"""
WITH {_SIGNAL_SQL}, p AS (SELECT file_id, count(sample) AS n, avg(sample * sample) AS p FROM s GROUP BY file_id)
SELECT file_id, CASE WHEN n = 0 THEN 'none' WHEN p = 0 THEN 'silence' ELSE 'measured' END AS state, CASE WHEN n > 0 AND p > 0 THEN round(greatest(10 * log10(CASE WHEN p > 0 THEN p END), -91), 6) END AS mean_db, n FROM p""",
    "first_adequate_frame": """
WITH b AS (SELECT user_id, max(value) AS best FROM events GROUP BY user_id)
SELECT e.user_id, coalesce(min(event_id) FILTER (value / 500 >= 0.5), min(event_id) FILTER (value = best)) AS event_id FROM events e JOIN b USING (user_id) GROUP BY e.user_id""",
    "sample_spacing": """
SELECT user_id, CASE WHEN count(*) >= 3 AND count(*) FILTER (value > 0) >= 2 THEN printf('%.6e', (max(epoch_us(ts)) - min(epoch_us(ts)))::DOUBLE / (count(*) - 1) / avg(value) FILTER (value > 0)) END AS factor FROM events GROUP BY user_id""",
    "chapter_normalise": """
WITH c AS (SELECT user_id AS file_id, event_id AS pos, epoch_us(ts) AS start, CAST(floor(value) AS BIGINT) * 3600000000 - 7200000000 AS d FROM events),
n AS (SELECT *, lead(start) OVER (PARTITION BY file_id ORDER BY start, pos) AS nx FROM c WHERE start >= 0),
x AS (SELECT file_id, pos, start, CASE WHEN nx IS NULL AND (start + d > 1900000000000000 OR d <= 0) THEN greatest(0, 1900000000000000 - start) WHEN start + d > nx THEN greatest(0, nx - start) ELSE d END AS duration FROM n)
SELECT * FROM x WHERE duration > 0""",
    "cue_flatten": f"""
WITH {_CUES_SQL}, g AS (SELECT * FROM c WHERE e > s), b AS (SELECT doc_id, s AS f FROM g UNION SELECT doc_id, e FROM g),
k AS (SELECT doc_id, f, lead(f) OVER (PARTITION BY doc_id ORDER BY f) AS t FROM b),
m AS (SELECT k.doc_id, f, t, string_agg(text, chr(10) ORDER BY s, pos) AS text FROM k JOIN g ON g.doc_id = k.doc_id AND s <= f AND e >= t WHERE t IS NOT NULL GROUP BY ALL),
i AS (SELECT *, CASE WHEN lag(t) OVER w = f AND lag(text) OVER w = text THEN 0 ELSE 1 END AS fresh FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY f)),
j AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY f) AS island FROM i)
SELECT doc_id, round(min(f), 3) AS start, round(max(t), 3) AS "end", text FROM j GROUP BY doc_id, island, text""",
    "cue_tiling": f"""
WITH {_CUES_SQL}, z AS (SELECT doc_id, s - min(s) OVER (PARTITION BY doc_id) AS s, e - min(s) OVER (PARTITION BY doc_id) AS e, text || ':' || pos AS text FROM c),
m AS (SELECT doc_id, s, e, text, CAST(round(s * 1000) AS BIGINT) AS a, least(CAST(round(e * 1000) AS BIGINT), 360000000) AS b FROM z),
p AS (SELECT *, greatest(a, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS a2 FROM m),
q AS (SELECT *, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM p WHERE b > a2)
SELECT doc_id, a2 AS start_ms, b - a2 AS length_ms, text FROM q UNION ALL SELECT doc_id, gap, a2 - gap, NULL FROM q WHERE a2 > gap
UNION ALL SELECT doc_id, max(b), 360000000 - max(b), NULL FROM q GROUP BY doc_id HAVING max(b) < 360000000""",
    "coalesce_runs": """
WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM r GROUP BY user_id, run, event_type""",
    "stream_head_blocks": """
WITH h AS (SELECT event_id, event_type, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS head_id FROM events)
SELECT event_id, head_id FROM h WHERE event_type NOT IN ('signup', 'purchase')""",
    "quality_bisection": """
WITH RECURSIVE s AS (SELECT p_brand, round(p_retailprice / 2500, 2) AS q, max(p_size) >= 25 AS ok FROM part GROUP BY ALL),
t(p_brand, k, lo, hi) AS (
  SELECT DISTINCT p_brand, 1, 0.0::DOUBLE, 1.0::DOUBLE FROM s
  UNION ALL
  SELECT p_brand, k + 1, CASE WHEN hi - lo <= 0.01 OR ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN hi - lo > 0.01 AND ok THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT t.*, coalesce((SELECT ok FROM s WHERE s.p_brand = t.p_brand AND s.q <= (lo + hi) / 2 ORDER BY q DESC LIMIT 1), false) AS ok FROM t WHERE k < 6))
SELECT p_brand, CASE WHEN coalesce((SELECT ok FROM s WHERE s.p_brand = t.p_brand AND s.q <= 1.0 ORDER BY q DESC LIMIT 1), false) THEN hi END AS quality FROM t WHERE k = 6""",
}
