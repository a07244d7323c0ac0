"""Queries over the shared tables: metadata items and records, tags and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flash
from ..operators import metadata
from .selection import table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as metadata items of their order."""
    li = table(spark, sf_dir, "lineitem")
    key = F.element_at(F.array(*map(F.lit, ["title", "creator", "artwork", "comment"])), (F.col("l_suppkey") % 4 + 1).cast("int"))
    pos = F.struct("l_linenumber", "l_partkey", "l_extendedprice")
    return li.select(F.col("l_orderkey").alias("file"), pos.alias("pos"), (F.col("l_linestatus") == "O").alias("iso"), key.alias("key"), F.col("l_partkey").cast("string").alias("value"))


def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metadata.merge_items(_items(spark, sf_dir))
    return got.select("file", "key", "value", F.array_join("values", ",").alias("values"))


def item_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as audio and video items whose keys hold telling words."""
    p = table(spark, sf_dir, "part")
    keys = ["itunes.GPSlat", "id3.APIC", "com.apple.iTunes.tool", "id3.TDRC", "qt.model", "common.title", "com.apple.quicktime.location.ISO6709", "udta.encoder"]
    key = F.element_at(F.array(*map(F.lit, keys)), (F.col("p_partkey") % 8 + 1).cast("int"))
    common = F.when(F.col("p_partkey") % 3 == 0, "artwork").when(F.col("p_partkey") % 3 == 1, "albumName")
    return p.select("p_partkey", metadata.audio_class(common, key).alias("audio"), metadata.video_class(key).alias("video"), metadata.media_kind((F.col("p_size") % 16).cast("int")).alias("kind"))


def id3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ID3 frames, old names beside new ones."""
    li = table(spark, sf_dir, "lineitem")
    frame = F.element_at(F.array(*map(F.lit, ["TIT2", "TT2", "TRCK", "TYER", "TCMP"])), (F.col("l_suppkey") % 5 + 1).cast("int"))
    text = F.when(frame == "TRCK", F.concat(F.col("l_linenumber").cast("string"), F.lit("/9"))).when(frame == "TYER", F.date_format("l_shipdate", "yyyy")).when(frame == "TCMP", (F.col("l_partkey") % 2).cast("string")).otherwise(F.col("l_partkey").cast("string"))
    frames = li.select(F.col("l_orderkey").alias("file"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("pos"), frame.alias("frame"), text.alias("text"))
    return metadata.id3_record(frames).select("file", "title", "track", "tracks", "compilation", F.year("date").alias("year"))


def subtitle_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of orders after new ones replace those of their language."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("language"), F.col("l_partkey").alias("track"), "l_linestatus")
    old, new = (li.where(F.col("l_linestatus") == s).drop("l_linestatus") for s in ("F", "O"))
    return metadata.track_changes(old, new, "replace")


def tag_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line quantities as tag codes, counted by kind."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 2 - 2).cast("int").alias("code"))
    return li.groupBy(flash.tag_kind(F.col("code")).alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("code").alias("codes"))


def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties beside telling phrases, as extractor errors."""
    e = table(spark, sf_dir, "events")
    phrases = ["Unsupported URL: x", "This video is DRM protected", "Sign in to confirm you're not a bot", "Private video", "not available from your location", "Premieres in 3 days", "Video unavailable", "Requested format is not available", "timed out", ""]
    n = F.col("event_id") % len(phrases)
    kind = F.when(n == 8, "URLError").when((n == 9) & (F.col("event_id") % 3 == 0), "ModuleNotFoundError").otherwise("DownloadError")
    return e.select("event_id", flash.error_class(kind, F.element_at(F.array(*map(F.lit, phrases)), (n + 1).cast("int"))).alias("class"))


FUNCTIONS = (metadata_merge, item_classes, id3_records, subtitle_tracks, tag_kinds, error_classes)
QUERIES = {f.__name__: f for f in FUNCTIONS}

_KINDS = {name: codes for name, codes in (("structural", flash.STRUCTURAL_TAGS), ("vector", flash.VECTOR_TAGS), ("script", flash.SCRIPT_TAGS), ("media", flash.MEDIA_TAGS))}
_KIND_SQL = " ".join(f"WHEN code IN ({', '.join(map(str, codes))}) THEN '{name}'" for name, codes in _KINDS.items())

ORACLES = {
    "metadata_merge": """
WITH i AS (SELECT l_orderkey AS file, (l_linenumber, l_partkey, l_extendedprice) AS pos, l_linestatus = 'O' AS iso, ['title', 'creator', 'artwork', 'comment'][l_suppkey % 4 + 1] AS key, CAST(l_partkey AS VARCHAR) AS value FROM lineitem)
SELECT file, key, coalesce(arg_max(value, pos) FILTER (NOT iso), arg_min(value, pos) FILTER (iso)) AS value, coalesce(string_agg(value, ',' ORDER BY pos, value) FILTER (NOT iso AND key IN ('creator', 'artwork')), '') AS values FROM i GROUP BY file, key""",
    "item_classes": """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'thumbnails' ELSE ['gps', 'thumbnails', 'software', 'timestamps', 'deviceIdentity', NULL, 'gps', 'software'][p_partkey % 8 + 1] END AS audio,
  ['gps', NULL, NULL, NULL, 'deviceIdentity', NULL, 'gps', 'software'][p_partkey % 8 + 1] AS video,
  CASE p_size % 16 WHEN 1 THEN 'Music' WHEN 2 THEN 'Audiobook' WHEN 6 THEN 'Music Video' WHEN 9 THEN 'Movie' WHEN 10 THEN 'TV Show' WHEN 11 THEN 'Booklet' WHEN 14 THEN 'Ringtone' END AS kind FROM part""",
    "id3_records": """
WITH f AS (SELECT l_orderkey AS file, (l_linenumber, l_partkey, l_extendedprice) AS pos, l_suppkey % 5 AS k, l_linenumber AS ln, l_partkey AS p, l_shipdate AS d FROM lineitem)
SELECT file, CAST(arg_max(p, pos) FILTER (k < 2) AS VARCHAR) AS title, arg_max(ln, pos) FILTER (k = 2) AS track, CASE WHEN count(*) FILTER (k = 2) > 0 THEN 9 END AS tracks, arg_max(p % 2 <> 0, pos) FILTER (k = 4) AS compilation, arg_min(year(d), pos) FILTER (k = 3) AS year FROM f GROUP BY file""",
    "subtitle_tracks": """
WITH l AS (SELECT l_orderkey AS file, l_returnflag AS language, l_partkey AS track, l_linestatus AS s FROM lineitem)
SELECT file, language, track FROM l WHERE s = 'O' UNION ALL SELECT file, language, track FROM l WHERE s = 'F' AND (file, language) NOT IN (SELECT (file, language) FROM l WHERE s = 'O')""",
    "tag_kinds": f"WITH c AS (SELECT CAST(l_quantity * 2 - 2 AS INTEGER) AS code FROM lineitem) SELECT CASE {_KIND_SQL} ELSE 'unrecognised' END AS kind, count(*) AS n, count(DISTINCT code) AS codes FROM c GROUP BY 1",
    "error_classes": """
SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'unsupported site' WHEN 1 THEN 'protected' WHEN 2 THEN 'bot check' WHEN 3 THEN 'authentication' WHEN 4 THEN 'geo restricted' WHEN 5 THEN 'live' WHEN 6 THEN 'unavailable' WHEN 7 THEN 'no usable format' WHEN 8 THEN 'network'
  ELSE CASE WHEN event_id % 3 = 0 THEN 'not installed' ELSE 'other' END END AS class FROM events""",
}
