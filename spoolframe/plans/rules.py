"""Queries over the shared tables: names, versions, rates, sizes and other rules of one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import lenient as L
from ..functions import media as M
from ..functions import text as T
from ..functions import versions as V
from .selection import dealt, table


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release names made of part names: dotted, with season marks, years in brackets, or plain."""
    p = table(spark, sf_dir, "part")
    base, n = F.replace("p_name", F.lit(" "), F.lit(".")), F.col("p_partkey") % 5
    size = F.col("p_size").cast("string")
    year = (1950 + F.col("p_partkey") % 70).cast("string")
    name = (
        F.when(n == 0, F.concat(base, F.lit("."), year, F.lit(".2160p.UHD.BluRay.x265-GRP")))
        .when(n == 1, F.concat(base, F.lit(".S"), F.lpad(size, 2, "0"), F.lit("E07.720p.WEB-DL")))
        .when(n == 2, F.concat(F.col("p_name"), F.lit(" ("), year, F.lit(") [1080p]")))
        .when(n == 3, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_Season 3 Episode "), size))
        .otherwise(F.concat(F.lit("[Group] "), F.col("p_name"), F.lit(" - HDTV")))
    )
    return p.select("p_partkey", name.alias("name"))


def title_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = T.with_title(_names(spark, sf_dir), "name", "t")
    return got.select("p_partkey", "t.title", "t.year", "t.season", "t.episode", "t.kind")


def resize_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pictures: their size and price as sides, under every kind of target."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 31 + 5).cast("int").alias("w"), F.floor("p_retailprice").cast("int").alias("h"))
    w, h = F.col("w"), F.col("h")
    made = {"fit": G.resize("fit", w, h, F.lit(640), F.lit(480)), "side": G.resize("longest_side", w, h, F.lit(500)), "scale": G.resize("scale", w, h, F.lit(0.37)), "pixels": G.resize("max_pixels", w, h, F.lit(200000)), "render": G.render_size(w, h, F.lit(1000))}
    return p.select("p_partkey", *(made[k][side].alias(f"{k}_{side[0]}") for k in made for side in ("width", "height")), G.even_floor(w).alias("even_w"))


def lossy_skip_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as audio files: target rate, channels and whether encoding them again is worth it."""
    li = table(spark, sf_dir, "lineitem")
    rate = F.when(F.col("l_discount") > 0.08, None).otherwise(F.floor("l_extendedprice") * 4)
    quality = F.col("l_tax") * 10
    target = M.aac_bitrate(quality, F.lit(2))
    reason = M.lossy_skip(F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", rate, target)
    chans = M.channels("at_most", (F.col("l_linenumber") + 1).cast("int"), F.col("l_suppkey") % 2 == 0, most=4)
    return li.select("l_orderkey", "l_linenumber", reason.alias("reason"), target.alias("target"), M.mp3_level(quality).alias("mp3_level"), M.mp3_rate((F.col("l_quantity") * 1000).cast("int")).alias("mp3_rate"), chans.alias("channels"))


def video_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as films: bitrate, frame rate text, timing factor, passing similarity and play time."""
    p = table(spark, sf_dir, "part")
    size, price = F.col("p_size"), F.col("p_retailprice")
    fps = F.when(size % 3 == 0, F.lit(30000) / 1001).when(size % 3 == 1, size.cast("double")).otherwise(F.floor(price / 10) / 10)
    return p.select(
        "p_partkey", M.video_bitrate(size * 16, size * 9, F.lit(24.0), F.lit(0.5)).cast("long").alias("bitrate"), M.frame_rate(fps).alias("rate"), F.round(M.timing_factor(price, price * (1 + size % 4)), 6).alias("factor"),
        M.looks_lossless(F.lit(1.0) - size / 2000, F.lit(1.0) - size / 1000).alias("passes"), F.round(M.play_time(F.transform(F.sequence(F.lit(1), (size % 5 + 1).cast("int")), lambda i: i / 200)), 6).alias("seconds"),
        M.probe_seconds(price / 7).alias("probe"), F.round(M.clamp(price / 1000, 0.0, 1.5), 6).alias("clamped"),
    )


def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions made of line and quantity, ranked in each order."""
    li = table(spark, sf_dir, "lineitem")
    tail = F.when(F.col("l_returnflag") == "A", "rc1").when(F.col("l_returnflag") == "R", ".post2").when(F.col("l_linestatus") == "F", ".dev3").otherwise("")
    v = F.concat(F.floor(F.col("l_quantity") / 10).cast("string"), F.lit("."), (F.col("l_suppkey") % 12).cast("string"), tail)
    rows = li.select("l_orderkey", "l_linenumber", v.alias("v"))
    w = Window.partitionBy("l_orderkey").orderBy(V.sort_key(F.col("v")))
    return rows.select("l_orderkey", "l_linenumber", "v", F.dense_rank().over(w).alias("place"))


def version_satisfies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as releases against clauses of every operator."""
    p = dealt(spark, sf_dir, "part", "p_partkey")
    v = F.concat((F.col("p_size") % 4).cast("string"), F.lit("."), (F.col("p_partkey") % 15).cast("string"), F.lit(".0"))
    clauses = {"ge": ">=1.10", "lt": "<3", "eq": "==2.4", "ne": "!=1.0", "wild": "==2.*", "near": "~=1.4", "exact": "===2.4.0"}
    got = p.select("p_partkey", v.alias("v"))
    return got.select("p_partkey", *(V.satisfies(F.col("v"), F.lit(c)).alias(k) for k, c in clauses.items()), V.satisfies_all(F.col("v"), F.array(F.lit(">=1"), F.lit("!=2.*"))).alias("every"))


def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values made of event ids, of four JSON types, as whole number, number, text and truth; props is not read."""
    e = table(spark, sf_dir, "events")
    # A document with known awkward types beside each event's own key.
    text = F.concat(F.lit('{"a":'), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('"'))).when(F.col("event_id") % 4 == 1, F.concat(F.col("event_id").cast("string"), F.lit(".5"))).when(F.col("event_id") % 4 == 2, F.lit("true")).otherwise(F.col("event_id").cast("string")), F.lit("}"))
    v = e.select("event_id", F.try_parse_json(text).alias("v"))
    return v.select("event_id", L.lenient_long(F.col("v"), "$.a").alias("as_long"), L.lenient_double(F.col("v"), "$.a").alias("as_double"), L.lenient_string(F.col("v"), "$.a").alias("as_string"), L.lenient_boolean(F.col("v"), "$.a").alias("as_boolean"))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files: content fingerprint and job id."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), "lang")
    got = d.select("doc_id", T.fingerprint(F.col("content"), F.col("doc_id") * 1000, edge=1024, window=256).alias("fingerprint"), "lang")
    return got.select("doc_id", "fingerprint", T.job_id(F.col("fingerprint"), T.canonical_json(["lang", "doc_id"]), F.lit("1")).alias("job_id"))


def subtitle_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices as times: written, read back, and read from a timing line."""
    o = dealt(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", F.round(F.col("o_totalprice") / 10, 3).alias("s"))
    got = o.select("o_orderkey", T.stamped(F.col("s")).alias("written"), "s")
    line = T.timing(F.concat(F.col("written"), F.lit(" --> "), T.stamped(F.col("s") + 2, "."), F.lit(" align:start")))
    return got.select("o_orderkey", "written", F.round(T.stamp(F.col("written")), 3).alias("seconds"), F.round(line["end"], 3).alias("until"))


def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and segment names as package names, tags, paths and URLs."""
    c = table(spark, sf_dir, "customer")
    n = F.col("c_custkey") % 6
    path = F.when(n == 0, F.concat(F.lit("a/../"), F.col("c_name"))).when(n == 1, F.concat(F.lit("/"), F.col("c_name"))).when(n == 2, F.concat(F.lit("C:"), F.col("c_name"))).when(n == 3, F.concat(F.lit("__MACOSX/._"), F.col("c_custkey").cast("string"), F.lit(".jpg"))).when(n == 4, F.concat(F.lit("p/"), F.col("c_custkey").cast("string"), F.lit(".JPG"))).otherwise(F.lit("ComicInfo.xml"))
    tag = F.when(n == 0, "fre-ca").when(n == 1, "zh_hans").when(n == 2, "x").when(n == 3, "und").when(n == 4, "EN-us").otherwise("ger")
    return c.select("c_custkey", T.canonical_package(F.concat("c_mktsegment", F.lit("_.-"), "c_name")).alias("package"), M.unsafe_path(path).alias("unsafe"), M.is_page(path, F.lit(False)).alias("page"), M.last_component(path).alias("base"), T.language_tag(tag).alias("tag"), T.natural_key(F.col("c_name")).alias("natural"), M.http_class((F.lit(200) + n * 101).cast("int")).alias("http"))


def dates_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in several shapes, read back."""
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey") % 4
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(n == 0, day).when(n == 1, F.concat(day, F.lit(" 10:20:30"))).when(n == 2, F.date_format("o_orderdate", "yyyy")).otherwise("soon")
    return o.select("o_orderkey", F.date_format(T.parse_date(text), "yyyy-MM-dd HH:mm:ss").alias("read"))


def probe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files and lines as tracks in the probe tool's JSON, whose numbers are strings."""
    from ..sources.sinks import probe_json

    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "audio").when(F.col("l_returnflag") == "N", "video").otherwise("timecode")
    code = F.when(F.col("l_returnflag") == "A", "mp4a").when(F.col("l_returnflag") == "N", "hvc1").otherwise("tmcd")
    tracks = li.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("index"), kind.alias("kind"), code.alias("code"), (F.col("l_quantity") / 3).alias("duration"), F.floor("l_extendedprice").alias("bitrate"))
    return probe_json(tracks, "file")


def magic_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading bytes of many kinds, by part."""
    p = table(spark, sf_dir, "part")
    magics = ["255044462D312E37", "0000001866747970", "494433040000", "FFFB9064", "FFD8FFE000104A46", "89504E470D0A1A0A", "49492A0008000000", "504B0304", "504B0506", "52617221", "43575306", "00"]
    m = F.unhex(F.element_at(F.array(*map(F.lit, magics)), (F.col("p_partkey") % len(magics) + 1).cast("int")))
    return p.select("p_partkey", M.sniff_store(m).alias("store"), M.sniff_document(m).alias("document"), M.sniff_artwork(m).alias("artwork"), M.sniff_flash(m)["compression"].alias("flash"))


FUNCTIONS = (title_parse, resize_resolve, lossy_skip_plan, video_plan, version_order, version_satisfies, lenient_json, fingerprint, subtitle_times, name_rules, dates_read, probe_report, magic_sniff)
QUERIES = {f.__name__: f for f in FUNCTIONS}


def _in_tags(word: str) -> str:
    return f"trim(lower({word}), '[](){{}}-') IN ({', '.join(repr(t) for t in T.RELEASE_TAGS)})"


ORACLES = {
    "title_parse": f"""
WITH n AS (SELECT p_partkey, p_partkey % 5 AS k, p_name, CAST(p_size AS VARCHAR) AS sz, CAST(1950 + p_partkey % 70 AS VARCHAR) AS y FROM part),
r AS (SELECT p_partkey, CASE k WHEN 0 THEN replace(p_name, ' ', '.') || '.' || y || '.2160p.UHD.BluRay.x265-GRP' WHEN 1 THEN replace(p_name, ' ', '.') || '.S' || lpad(sz, 2, '0') || 'E07.720p.WEB-DL'
  WHEN 2 THEN p_name || ' (' || y || ') [1080p]' WHEN 3 THEN replace(p_name, ' ', '_') || '_Season 3 Episode ' || sz ELSE '[Group] ' || p_name || ' - HDTV' END AS name FROM n),
c AS (SELECT p_partkey, NOT contains(replace(name, '_', ' '), ' ') AS dots, replace(CASE WHEN contains(replace(name, '_', ' '), ' ') THEN replace(name, '_', ' ') ELSE replace(replace(name, '_', ' '), '.', ' ') END, '  ', ' ') AS s FROM r),
e AS (SELECT *, regexp_extract(s, '[Ss][0-9]{{1,2}}[ ._-]?[Ee][0-9]{{1,3}}') AS e1, regexp_extract(s, '[Ss]eason[ ._-]?[0-9]{{1,2}}[ ._-]+[Ee]pisode[ ._-]?[0-9]{{1,3}}') AS e3,
  regexp_extract(s, '[^0-9]((19|20)[0-9][0-9])([^0-9]|$)', 1) AS y FROM c),
p AS (SELECT *, CASE WHEN e1 <> '' THEN position(e1 IN s) WHEN e3 <> '' THEN position(e3 IN s) END AS ep, CASE WHEN y <> '' THEN position(y IN s) END AS yp, string_split(s, ' ') AS w FROM e),
t AS (SELECT *, list_position(list_transform(w, lambda x: {_in_tags("x")}), true) AS ti FROM p),
u AS (SELECT *, CASE WHEN ti > 0 THEN 1 + coalesce(list_sum(list_transform(w[1:ti - 1], lambda x: length(x) + 1)), 0) END AS tp, CASE WHEN ep IS NULL OR yp < ep THEN yp END AS yq FROM t),
h AS (SELECT *, CASE WHEN coalesce(ep, yq, tp) IS NULL THEN s ELSE substr(s, 1, CAST(least(ep, yq, tp) AS BIGINT) - 1) END AS head FROM u),
b AS (SELECT *, regexp_replace(replace(regexp_replace(head, '[\\[{{(][^\\]}})]*[\\]}})]', ' ', 'g'), '-', ' '), '  +', ' ', 'g') AS body FROM h)
SELECT p_partkey, CASE WHEN dots THEN trim(body, ' .-_:([{{)]}}') ELSE trim(body, ' -_:([{{)]}}') END AS title, CASE WHEN yq IS NOT NULL THEN CAST(y AS INTEGER) END AS year,
  CASE WHEN e1 <> '' THEN CAST(regexp_extract(e1, '[Ss]([0-9]+)', 1) AS INTEGER) WHEN e3 <> '' THEN CAST(regexp_extract(e3, '([0-9]+)', 1) AS INTEGER) END AS season,
  CASE WHEN e1 <> '' THEN CAST(regexp_extract(e1, '[Ee]([0-9]+)$', 1) AS INTEGER) WHEN e3 <> '' THEN CAST(regexp_extract(e3, '([0-9]+)$', 1) AS INTEGER) END AS episode,
  CASE WHEN ep IS NOT NULL THEN 'episode' ELSE 'unknown' END AS kind FROM b""",
    "resize_resolve": """
WITH p AS (SELECT p_partkey, CAST(p_size * 31 + 5 AS INTEGER) AS w, CAST(floor(p_retailprice) AS INTEGER) AS h FROM part),
r AS (SELECT *, least(640.0::DOUBLE / w, 480.0::DOUBLE / h) AS f, 500.0::DOUBLE / greatest(w, h) AS s, CASE WHEN w * h > 200000 THEN sqrt(200000.0::DOUBLE / (w::DOUBLE * h)) END AS x FROM p)
SELECT p_partkey, CASE WHEN f < 1 THEN greatest(1, CAST(round(w * f) AS INTEGER)) ELSE w END AS fit_w, CASE WHEN f < 1 THEN greatest(1, CAST(round(h * f) AS INTEGER)) ELSE h END AS fit_h,
  CASE WHEN s < 1 THEN greatest(1, CAST(round(w * s) AS INTEGER)) ELSE w END AS side_w, CASE WHEN s < 1 THEN greatest(1, CAST(round(h * s) AS INTEGER)) ELSE h END AS side_h,
  CAST(round(w * 0.37::DOUBLE) AS INTEGER) AS scale_w, CAST(round(h * 0.37::DOUBLE) AS INTEGER) AS scale_h,
  CASE WHEN x < 1 THEN greatest(1, CAST(floor(w * x) AS INTEGER)) ELSE w END AS pixels_w, CASE WHEN x < 1 THEN greatest(1, CAST(floor(h * x) AS INTEGER)) ELSE h END AS pixels_h,
  CAST(round(w * (1000.0::DOUBLE / greatest(w, h))) AS INTEGER) AS render_w, CAST(round(h * (1000.0::DOUBLE / greatest(w, h))) AS INTEGER) AS render_h, w - w % 2 AS even_w FROM r""",
    "lossy_skip_plan": """
WITH l AS (SELECT *, CASE WHEN l_discount <= 0.08 THEN CAST(floor(l_extendedprice) AS BIGINT) * 4 END AS rate, least(greatest(l_tax * 10, 0.0), 1.0) AS q, l_linenumber + 1 AS c0 FROM lineitem),
t AS (SELECT *, CAST(round((24000 + q * 72000) / 1000) AS BIGINT) * 1000 * 2 AS target, CASE WHEN c0 > 2 AND l_suppkey % 2 <> 0 THEN 2 ELSE c0 END AS kept FROM l)
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linestatus = 'F' THEN 'lossless copy of a lossy source' WHEN rate IS NULL THEN 'source bitrate unknown' WHEN target <= rate * 0.75 THEN NULL ELSE 'saves too little' END AS reason,
  target, CAST(trunc((1 - l_tax * 10) * 9) AS INTEGER) AS mp3_level, coalesce(list_min(list_filter([8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000], lambda r: r >= CAST(trunc(l_quantity * 1000) AS INTEGER))), 44100) AS mp3_rate,
  CASE WHEN kept <= 4 THEN kept ELSE 2 END AS channels FROM t""",
    "video_plan": """
WITH p AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN 30000.0::DOUBLE / 1001 WHEN p_size % 3 = 1 THEN p_size::DOUBLE ELSE floor(p_retailprice / 10) / 10 END AS fps, 1 + p_size % 4 AS m FROM part),
q AS (SELECT *, round(fps * 1001 / 1000) AS n FROM p)
SELECT p_partkey, greatest(64000, CAST(floor((p_size * 16)::DOUBLE * (p_size * 9) * 24.0::DOUBLE * 0.12::DOUBLE * 0.625::DOUBLE) AS BIGINT)) AS bitrate,
  CASE WHEN abs(fps - round(fps)) < 0.0005 THEN CAST(round(fps) AS BIGINT) || '/1' WHEN abs(fps - n * 1000 / 1001) < 0.0005 THEN CAST(n * 1000 AS BIGINT) || '/1001' ELSE CAST(round(fps * 1000) AS BIGINT) || '/1000' END AS rate,
  CASE WHEN m = 2 THEN 0.5 ELSE 1.0 END AS factor, 1.0 - p_size / 2000.0 >= 0.99 AND 1.0 - p_size / 1000.0 >= 0.97 AS passes,
  CASE WHEN p_size % 5 + 1 > 1 THEN round(list_sum(list_transform(range(1, p_size % 5 + 2), lambda i: CASE WHEN i / 200.0 <= 0.011 THEN 0.1 ELSE i / 200.0 END)), 6) END AS seconds,
  printf('%.6f', p_retailprice / 7) AS probe, round(least(greatest(p_retailprice / 1000, 0.0), 1.5), 6) AS clamped FROM q""",
    "version_order": """
WITH v AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 10) AS INTEGER) AS a, l_suppkey % 12 AS b, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 3 WHEN l_linestatus = 'F' THEN 0 ELSE 2 END AS s,
  CASE WHEN l_returnflag = 'A' THEN 'rc1' WHEN l_returnflag = 'R' THEN '.post2' WHEN l_linestatus = 'F' THEN '.dev3' ELSE '' END AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, a || '.' || b || t AS v, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY a, b, s) AS place FROM v""",
    "version_satisfies": """
WITH v AS (SELECT p_partkey, p_size % 4 AS a, p_partkey % 15 AS b FROM part)
SELECT p_partkey, a > 1 OR a = 1 AND b >= 10 AS ge, a < 3 AS lt, a = 2 AND b = 4 AS eq, NOT (a = 1 AND b = 0) AS ne, a = 2 AS wild, a = 1 AND b >= 4 AS near, a = 2 AND b = 4 AS exact, a >= 1 AND a <> 2 AS every FROM v""",
    "lenient_json": """
SELECT event_id, CASE event_id % 4 WHEN 2 THEN NULL ELSE event_id END AS as_long, CASE event_id % 4 WHEN 2 THEN NULL WHEN 1 THEN event_id + 0.5 ELSE event_id END::DOUBLE AS as_double,
  CASE WHEN event_id % 4 IN (0, 3) THEN CAST(event_id AS VARCHAR) END AS as_string, event_id % 4 = 2 AS as_boolean FROM events""",
    "fingerprint": """
WITH d AS (SELECT doc_id, lang, encode(text) AS b, octet_length(encode(text)) AS n, encode('size=' || octet_length(encode(text)) || ';mtime=' || doc_id * 1000) AS h FROM documents),
c AS (SELECT *, [1024 + (n - 2048) * i // 5 for i in [1, 2, 3, 4]] AS ce FROM d),
f AS (SELECT doc_id, lang, 'v1:' || sha256(CASE WHEN n <= 2048 THEN h || b ELSE h || b[1:1024]
  || b[ce[1] - least(ce[1], 128) + 1:ce[1] - least(ce[1], 128) + 256] || b[ce[2] - least(ce[2], 128) + 1:ce[2] - least(ce[2], 128) + 256] || b[ce[3] - least(ce[3], 128) + 1:ce[3] - least(ce[3], 128) + 256] || b[ce[4] - least(ce[4], 128) + 1:ce[4] - least(ce[4], 128) + 256]
  || b[n - 1023:n] END) AS fingerprint FROM c),
j AS (SELECT *, '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' AS js FROM f)
SELECT doc_id, fingerprint, sha256(length(fingerprint) || ':' || fingerprint || length(js) || ':' || js || '1:1') AS job_id FROM j""",
    "subtitle_times": """
WITH o AS (SELECT o_orderkey, CAST(round(round(o_totalprice / 10, 3) * 1000) AS BIGINT) AS ms FROM orders)
SELECT o_orderkey, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS written, round(ms / 1000.0, 3) AS seconds, round((ms + 2000) / 1000.0, 3) AS until FROM o""",
    "name_rules": """
WITH c AS (SELECT *, c_custkey % 6 AS n FROM customer)
SELECT c_custkey, regexp_replace(lower(c_mktsegment || '_.-' || c_name), '[-_.]+', '-', 'g') AS package, n < 3 AS unsafe, n = 4 AS page,
  CASE n WHEN 2 THEN 'C:' || c_name WHEN 3 THEN '._' || c_custkey || '.jpg' WHEN 4 THEN c_custkey || '.JPG' WHEN 5 THEN 'ComicInfo.xml' ELSE c_name END AS base,
  CASE n WHEN 0 THEN 'fra-CA' WHEN 1 THEN 'zh-Hans' WHEN 2 THEN NULL WHEN 3 THEN 'und' WHEN 4 THEN 'en-US' ELSE 'deu' END AS tag,
  array_to_string(list_transform(regexp_extract_all(lower(c_name), '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(CASE WHEN ltrim(r, '0') = '' THEN '0' ELSE ltrim(r, '0') END, 12, '0') ELSE r END), '') AS natural,
  CASE n WHEN 0 THEN NULL WHEN 1 THEN 'refused' WHEN 2 THEN 'refused' ELSE 'server' END AS http FROM c""",
    "dates_read": """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 10:20:30') WHEN 2 THEN strftime(o_orderdate, '%Y-01-01 00:00:00') END AS read FROM orders""",
    "probe_report": """
WITH t AS (SELECT l_orderkey AS file, string_agg('{"index":' || l_linenumber || ',"codec_type":"' || CASE l_returnflag WHEN 'A' THEN 'audio' WHEN 'N' THEN 'video' ELSE 'data' END || '","codec_name":"' || CASE l_returnflag WHEN 'A' THEN 'aac' WHEN 'N' THEN 'hevc' ELSE 'timecode' END
  || '","duration":"' || printf('%.6f', l_quantity / 3) || '","bit_rate":"' || CAST(floor(l_extendedprice) AS BIGINT) || '"}', ',' ORDER BY l_linenumber, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, printf('%.6f', l_quantity / 3), CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)) AS s, count(*) AS n, max(l_quantity / 3) AS d FROM lineitem GROUP BY l_orderkey)
SELECT file, '{"streams":[' || s || '],"format":{"nb_streams":' || n || ',"duration":"' || printf('%.6f', d) || '"}}' AS json FROM t""",
    "magic_sniff": """
SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'pdf' WHEN 1 THEN 'itunes_atoms' WHEN 2 THEN 'id3' WHEN 3 THEN 'id3' WHEN 4 THEN 'image_properties' WHEN 5 THEN 'image_properties' WHEN 6 THEN 'image_properties' END AS store,
  CASE p_partkey % 12 WHEN 0 THEN 'pdf' WHEN 7 THEN 'zip' WHEN 8 THEN 'zip' WHEN 9 THEN 'rar' ELSE 'other' END AS document, CASE p_partkey % 12 WHEN 4 THEN 'jpeg' WHEN 5 THEN 'png' END AS artwork, CASE p_partkey % 12 WHEN 10 THEN 'zlib' END AS flash FROM part""",
}
