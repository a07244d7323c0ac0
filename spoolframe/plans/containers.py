"""Queries that make container bytes of the shared tables and read them back, and plans and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import versions as V
from ..operators import kernels, packages, planned
from ..sources import files, sinks
from ..streaming import progress
from .selection import dealt, table


def _be(number: Column, size: int) -> Column:
    """A number as big-endian bytes."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2 * size, "0"))


def _bytes(text: str) -> Column:
    return F.unhex(F.lit(text.encode("latin-1").hex()))


def zip_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as books of fifty: written as archives and listed again."""
    p = table(spark, sf_dir, "pages")
    pages = p.select(F.floor(F.col("page_id") / 50).alias("book"), "page_id", F.concat(F.lit("p/"), F.lpad(F.col("page_id").cast("string"), 8, "0"), F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("content"))
    listed = files.parse(files.book(pages, "book", "page_id", "name", "content"), "zip_entries", ["book"])
    return listed.select("book", "pos", "name", "method", "size", "is_dir")


def subtitle_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events written as SubRip and parsed again."""
    e = table(spark, sf_dir, "events")
    start = F.col("event_id") / 10.0
    cues = e.select("user_id", F.col("event_id").alias("pos"), start.alias("start"), (start + 1.25).alias("end"), F.concat(F.lit("<i>"), "event_type", F.lit("</i> "), F.col("event_id").cast("string")).alias("text"))
    text = sinks.subrip(cues, "user_id").select("user_id", F.encode("text", "UTF-8").alias("content"))
    got = files.parse(text, "subtitle_cues", ["user_id"])
    return got.select("user_id", "pos", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text", F.size("runs").alias("runs"))


def iso_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as the media data of small ISO files."""
    d = table(spark, sf_dir, "documents")
    body = F.encode("text", "UTF-8")
    content = F.concat(_be(F.lit(12), 4), _bytes("ftypisom"), _be(F.lit(16), 4), _bytes("moov"), _be(F.lit(8), 4), _bytes("udta"), _be(F.octet_length(body) + 8, 4), _bytes("mdat"), body)
    return files.parse(d.select("doc_id", content.alias("content")), "iso_boxes", ["doc_id"]).select("doc_id", "pos", "type", "offset", "size", "depth", "path", "whole")


def editable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of those files can be edited in place."""
    return planned.editable_in_place(iso_boxes(spark, sf_dir), "doc_id")


def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as picture headers; every seventh is no picture."""
    p = dealt(spark, sf_dir, "part", "p_partkey")
    good = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), _be(F.col("p_size"), 4), _be(F.floor("p_retailprice"), 4), F.unhex(F.lit("0806000000")))
    content = F.when(F.col("p_partkey") % 7 == 0, _bytes("none")).otherwise(good)
    return files.parse(p.select("p_partkey", content.alias("content")), "image_info", ["p_partkey"]).select("p_partkey", "format", "width", "height", "frames", "error")


def wave_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as samples of waves at 8000 Hz."""
    d = table(spark, sf_dir, "documents")
    body = F.encode("text", "UTF-8")
    little = lambda n, size: F.unhex(F.concat(*(F.substring(F.lpad(F.hex(n.cast("long")), 2 * size, "0"), 2 * i - 1, 2) for i in range(size, 0, -1))))
    content = F.concat(_bytes("RIFF"), little(F.octet_length(body) + 36, 4), _bytes("WAVEfmt "), F.unhex(F.lit("10000000010001" + "00401F0000803E000002001000")), _bytes("data"), little(F.octet_length(body), 4), body)
    return files.parse(d.select("doc_id", content.alias("content")), "wav_info", ["doc_id"]).select("doc_id", "codec", "channels", "rate", F.round(F.col("seconds") + 1e-9, 6).alias("seconds"))


def package_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as package metadata with a continuation line."""
    p = dealt(spark, sf_dir, "part", "p_partkey")
    text = F.concat(F.lit("Name: "), "p_name", F.lit("\nSummary: "), "p_type", F.lit("\n  "), "p_brand", F.lit("\n\nbody: none\n"))
    return files.parse(p.select("p_partkey", F.encode(text, "UTF-8").alias("content")), "package_metadata", ["p_partkey"]).select("p_partkey", "pos", "field", "value")


def requirements_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requirement lines."""
    p = table(spark, sf_dir, "part")
    r = V.requirement(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("[x, y] >= "), F.col("p_size").cast("string"), F.lit(", <99; os_name == 'posix'")))
    return p.select("p_partkey", r["name"].alias("name"), F.array_join(r["extras"], ",").alias("extras"), F.array_join(r["clauses"], ",").alias("clauses"), r["marker"].alias("marker"))


def release_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as releases of a package: the newest that fits."""
    p = table(spark, sf_dir, "part")
    releases = p.select(F.col("p_brand").alias("project"), F.concat((F.col("p_size") % 7).cast("string"), F.lit("."), F.col("p_partkey").cast("string")).alias("version"), F.when(F.col("p_partkey") % 3 == 0, ">=4").alias("requires_python"), F.lit(True).alias("is_pure"))
    return packages.candidates(releases, F.array(F.lit("<5"), F.lit("!=4.*")), "3.11")


def still_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pictures planned for an encode."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 31).cast("int").alias("width"), F.floor("p_retailprice").cast("int").alias("height"))
    return planned.still_plan(p, "avif", 500, ["avif"]).select("p_partkey", "to_width", "to_height", "backend", "reason")


def newest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user and type."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", "event_type").alias("job"), F.struct("ts", "event_id").alias("at"), "event_id")
    return progress.newest(e, "job", "at").select("job", "event_id")


def guarded_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's function that fails for some rows; the others have values."""

    def inverse(v: int) -> float:
        if v % 10 == 0:
            raise ValueError("no inverse")
        return v * 2.0

    p = dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", "p_size")
    return kernels.guarded(p, inverse, F.col("p_size"), "double").select("p_partkey", "status", "value", "error")


def similarity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as pictures 16 wide, each beside itself with its first row dark.

    A row is 64 bytes; only the last is padded. An empty text is one row of padding, a null text has null scores.
    """
    d = dealt(spark, sf_dir, "documents", "doc_id")
    body = F.encode("text", "UTF-8")
    height = F.greatest(F.ceil(F.octet_length(body) / 64), F.lit(1)).cast("int")
    rows = d.select("doc_id", body.alias("body"), F.when(F.col("text").isNotNull(), height).alias("h"))
    rows = rows.select("doc_id", F.substring(F.concat("body", F.unhex(F.lit("7F" * 64))), F.lit(1), F.col("h") * 64).alias("a"), F.coalesce("h", F.lit(0)).alias("h"))
    rows = rows.withColumns({"b": F.concat(F.unhex(F.lit("00" * 64)), F.substring("a", 65, 2147483647)), "w": F.lit(16)})
    s = kernels.similarity("a", "b", "w", "h")
    return rows.select("doc_id", s.alias("s"), kernels.detail("a").alias("d")).select("doc_id", F.round("s.overall", 3).alias("overall"), F.round("s.worst", 3).alias("worst"), F.round("d", 4).alias("detail"))


FUNCTIONS = (zip_entries, subtitle_parse, iso_boxes, editable_files, image_headers, wave_headers, package_fields, requirements_read, release_picks, still_plans, newest_progress, guarded_function, similarity_scores)
QUERIES = {f.__name__: f for f in FUNCTIONS}

ORACLES = {
    "zip_entries": """
SELECT page_id // 50 AS book, row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) - 1 AS pos, 'p/' || lpad(CAST(page_id AS VARCHAR), 8, '0') || '.html' AS name, 0 AS method, strlen(html) AS size, false AS is_dir FROM pages""",
    "subtitle_parse": """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, round(event_id / 10.0, 3) AS start, round(event_id / 10.0 + 1.25, 3) AS "end", event_type || ' ' || event_id AS text, 1 AS runs FROM events""",
    "iso_boxes": """
WITH d AS (SELECT doc_id, strlen(text) AS n FROM documents)
SELECT doc_id, 0 AS pos, 'ftyp' AS type, 0 AS "offset", 12 AS size, 0 AS depth, '/ftyp' AS path, true AS whole FROM d UNION ALL SELECT doc_id, 1, 'moov', 12, 16, 0, '/moov', true FROM d
UNION ALL SELECT doc_id, 2, 'udta', 20, 8, 1, '/moov/udta', true FROM d UNION ALL SELECT doc_id, 3, 'mdat', 28, n + 8, 0, '/mdat', true FROM d""",
    "editable_files": "SELECT doc_id, true AS editable FROM documents",
    "image_headers": """
SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN 'png' END AS format, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS width, CASE WHEN p_partkey % 7 <> 0 THEN CAST(floor(p_retailprice) AS INTEGER) END AS height,
  CASE WHEN p_partkey % 7 <> 0 THEN 1 END AS frames, CASE WHEN p_partkey % 7 = 0 THEN 'no known picture' END AS error FROM part""",
    "wave_headers": "SELECT doc_id, 'pcm' AS codec, 1 AS channels, 8000 AS rate, round(strlen(text) / 16000.0 + 1e-9, 6) AS seconds FROM documents",
    "package_fields": "SELECT p_partkey, 0 AS pos, 'name' AS field, p_name AS value FROM part UNION ALL SELECT p_partkey, 1, 'summary', p_type || chr(10) || p_brand FROM part",
    "requirements_read": "SELECT p_partkey, regexp_replace(lower(replace(p_name, ' ', '_')), '[-_.]+', '-', 'g') AS name, 'x,y' AS extras, '>= ' || p_size || ',<99' AS clauses, 'os_name == ''posix''' AS marker FROM part",
    "release_picks": """
WITH r AS (SELECT p_brand AS project, p_size % 7 AS a, p_partkey AS b FROM part WHERE p_size % 7 < 4 AND p_partkey % 3 <> 0), n AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY a DESC, b DESC) AS n FROM r)
SELECT project, a || '.' || b AS version FROM n WHERE n = 1""",
    "still_plans": """
WITH p AS (SELECT p_partkey, p_size * 31 AS w, CAST(floor(p_retailprice) AS INTEGER) AS h FROM part), r AS (SELECT *, 500.0::DOUBLE / greatest(w, h) AS f FROM p),
s AS (SELECT p_partkey, CASE WHEN f < 1 THEN greatest(1, CAST(round(w * f) AS INTEGER)) ELSE w END AS w, CASE WHEN f < 1 THEN greatest(1, CAST(round(h * f) AS INTEGER)) ELSE h END AS h FROM r)
SELECT p_partkey, CASE WHEN w > 1 THEN w - w % 2 ELSE w END AS to_width, CASE WHEN h > 1 THEN h - h % 2 ELSE h END AS to_height, 'system' AS backend, NULL::VARCHAR AS reason FROM s""",
    "newest_progress": "SELECT user_id || '/' || event_type AS job, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL",
    "guarded_function": "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN p_size % 10 <> 0 THEN p_size * 2.0 END AS value, CASE WHEN p_size % 10 = 0 THEN 'ValueError: no inverse' END AS error FROM part",
}
