"""Queries that make media files of the shared tables and read their tracks, cues, chapters, items and payloads back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metadata
from ..sources import files
from .containers import _be, _bytes
from .selection import dealt, table


@dataclass(frozen=True)
class _Made:
    """Bytes and how many they are: a length asked of nested bytes would have them made once more at every level."""

    content: Column
    size: Column


def _joined(*parts: Column | _Made) -> _Made:
    made = [p if isinstance(p, _Made) else _Made(p, F.octet_length(p)) for p in parts]
    return _Made(F.concat(_bytes(""), *(p.content for p in made)), sum((p.size for p in made), F.lit(0)))


def _box(tag: str, *parts: Column | _Made) -> _Made:
    body = _joined(*parts)
    size = body.size + 8
    return _Made(F.concat(_be(size, 4), _bytes(tag), body.content), size)


def _hex(digits: str) -> Column:
    return F.unhex(F.lit(digits))


def _num(n: int, size: int) -> Column:
    return _hex(f"{n:0{2 * size}X}")


def _sample(text: Column) -> Column:
    raw = F.encode(text, "UTF-8")
    return F.concat(_be(F.octet_length(raw), 2), raw)


def _text(value: Column) -> _Made:
    return _box("data", _num(1, 4), _num(0, 4), F.encode(value, "UTF-8"))


def _movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as films: a subtitle track with the name for one second and the type for two, three chapters, and items."""
    p = dealt(spark, sf_dir, "part", "p_partkey")
    one, two = _sample(F.col("p_name")), _sample(F.col("p_type"))
    media = F.concat(one, two)
    sizes = F.concat(_be(F.octet_length(one), 4), _be(F.octet_length(two), 4))
    entry = _box("tx3g", _hex("00" * 6), _num(1, 2), _hex("00" * 30))
    tables = _box(
        "stbl", _box("stsd", _num(0, 4), _num(1, 4), entry), _box("stts", _num(0, 4), _num(2, 4), _num(1, 4), _num(1000, 4), _num(1, 4), _num(2000, 4)), _box("stsc", _num(0, 4), _num(1, 4), _num(1, 4), _num(2, 4), _num(1, 4)),
        _box("stsz", _num(0, 4), _num(0, 4), _num(2, 4), sizes), _box("stco", _num(0, 4), _num(1, 4), _num(20, 4)),
    )
    language = F.when(F.col("p_size") % 2 == 0, _num(0x15C7, 2)).otherwise(_num(0x10B5, 2))  # eng, deu
    mdia = _box("mdia", _box("mdhd", _hex("00" * 12), _num(1000, 4), _num(3000, 4), language, _num(0, 2)), _box("hdlr", _hex("00" * 8), _bytes("sbtl"), _hex("00" * 13)), _box("minf", tables))
    tkhd = _box("tkhd", _num(3, 4), _hex("00" * 8), _be(F.col("p_size"), 4), _hex("00" * 68))
    title = lambda start, c: F.concat(_num(start * 10_000_000, 8), _be(F.octet_length(F.encode(c, "UTF-8")), 1), F.encode(c, "UTF-8"))
    chapters = _box("chpl", _hex("0100000000000000"), _num(3, 1), title(0, F.lit("start")), title(1, F.col("p_brand")), title(2, F.lit("end")))
    items = _box("ilst", _box("\xa9nam", _text(F.col("p_name"))), _box("trkn", _box("data", _num(0, 8), _num(0, 2), _be(F.col("p_size"), 2), _num(50, 2), _num(0, 2))), _box("tvsn", _box("data", _num(21, 4), _num(0, 4), _be(F.col("p_size"), 1))))
    user = _box("udta", chapters, _box("meta", _num(0, 4), items))
    content = _joined(_num(12, 4), _bytes("ftypisom"), _box("mdat", media), _box("moov", _box("mvhd", _hex("00" * 12), _num(1000, 4), _num(3000, 4), _hex("00" * 80)), _box("trak", tkhd, mdia), user))
    return p.select("p_partkey", content.content.alias("content"), "p_name", "p_size")


def movie_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = files.parse(_movies(spark, sf_dir), "movie_tracks", ["p_partkey"])
    return got.select("p_partkey", "index", "track_id", "kind", "code", "enabled", "seconds", "language", "samples", "bytes")


def movie_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse(_movies(spark, sf_dir), "movie_lengths", ["p_partkey"]).select("p_partkey", "seconds")


def movie_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse(_movies(spark, sf_dir), "movie_samples", ["p_partkey"]).select("p_partkey", "pos", "start", "seconds", "offset", "size")


def movie_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse(_movies(spark, sf_dir), "movie_cues", ["p_partkey"]).select("p_partkey", "language", "pos", "start", "end", "text")


def movie_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse(_movies(spark, sf_dir), "movie_chapters", ["p_partkey"]).select("p_partkey", "pos", "start", "seconds", "title")


def movie_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse(_movies(spark, sf_dir), "movie_items", ["p_partkey"]).select("p_partkey", "pos", "key", "name", "text", "number")


def movie_retagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New items written into the files: the old ones are gone, chapters and cues are as they were."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    wanted = F.array(pair("\xa9nam", F.upper("p_name")), pair("----:com.example:note", F.col("p_size").cast("string")))
    made = files.tagged(_movies(spark, sf_dir).withColumn("items", wanted), "content", "items").select("p_partkey", F.col("tagged.content").alias("content"))
    got = files.parse_each(made, ["movie_items", "movie_cues", "movie_chapters"], ["p_partkey"])
    what = F.when(F.col("parser") == "movie_items", "item").when(F.col("parser") == "movie_cues", "cue").otherwise("chapter")
    text = F.when(F.col("parser") == "movie_items", F.concat_ws("=", "key", "text")).when(F.col("parser") == "movie_cues", F.col("text")).otherwise(F.col("title"))
    return got.select("p_partkey", what.alias("what"), "pos", text.alias("text"))


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of parts as ID3 tags: a title, a track of fifty, a comment, a field of its own and a picture."""
    p = dealt(spark, sf_dir, "part", "p_partkey")

    def frame(name: str, *parts: Column) -> _Made:
        body = _joined(*parts)
        return _Made(F.concat(_bytes(name), _be(body.size, 4), _num(0, 2), body.content), body.size + 10)

    utf8 = lambda c: F.encode(c, "UTF-8")
    body = _joined(
        frame("TIT2", _num(3, 1), utf8(F.col("p_name"))), frame("TRCK", _num(3, 1), utf8(F.concat(F.col("p_size").cast("string"), F.lit("/50")))), frame("COMM", _num(3, 1), _bytes("eng"), _num(0, 1), utf8(F.col("p_type"))),
        frame("TXXX", _num(3, 1), _bytes("brand"), _num(0, 1), utf8(F.col("p_brand"))), frame("APIC", _num(3, 1), _bytes("image/png"), _num(0, 1), _num(3, 1), _num(0, 1), _hex("89504E470D0A1A0A"), _be(F.col("p_size"), 4)),
    )
    n = body.size
    size = F.concat(*(_be(F.shiftright(n, s).bitwiseAND(F.lit(127)), 1) for s in (21, 14, 7, 0)))
    content = F.concat(_bytes("ID3"), _hex("030000"), size, body.content)
    return files.parse(p.select("p_partkey", content.alias("content")), "id3_frames", ["p_partkey"])


def id3_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, fields of their own and pictures of those tags."""
    got = metadata.id3_extras(_tags(spark, sf_dir), "p_partkey")
    art = F.element_at("artwork", 1)
    return got.select("p_partkey", "comment", F.to_json("custom").alias("custom"), F.size("artwork").alias("pictures"), art["role"].alias("role"), art["bytes"].alias("bytes"))


def id3_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _tags(spark, sf_dir)
    return got.select("p_partkey", "pos", "frame", "description", "text", F.octet_length("picture").alias("picture_bytes"), "role")


def _flash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as Flash files: a payload in a sprite, sound in blocks, and a tag of an odd code."""
    p = dealt(spark, sf_dir, "part", "p_partkey")
    swap = lambda c, n: F.concat(*(_be(F.shiftright(c.cast("long"), 8 * i).bitwiseAND(F.lit(255)), 1) for i in range(n)))

    def tag(code: int, *parts: Column | _Made) -> _Made:
        body = _joined(*parts)
        return _Made(F.concat(swap(F.lit(code * 64 + 63), 2), swap(body.size, 4), body.content), body.size + 6)

    name = F.encode("p_name", "UTF-8")
    sprite = _joined(swap(F.col("p_size"), 2), swap(F.lit(1), 2), tag(87, swap(F.lit(9), 2), _num(0, 4), name), tag(0, _bytes("")))
    head, block = tag(18, _hex("002A0000")), lambda text: tag(19, _hex("00000000"), F.encode(text, "UTF-8"))
    body = _joined(_hex("00"), swap(F.lit(24 * 256), 2), swap(F.col("p_size"), 2), tag(9, _hex("FFFFFF")), tag(39, sprite), head, block(F.col("p_brand")), tag(60, _hex("0100020003000400000400")), block(F.col("p_type")), tag(0, _bytes("")))
    content = F.concat(_bytes("FWS"), _num(8, 1), swap(body.size + 8, 4), body.content)
    return p.select("p_partkey", content.alias("content"))


def flash_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse(_flash(spark, sf_dir), "swf_header", ["p_partkey"]).select("p_partkey", "compression", "version", "fps", "frames")


def flash_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse(_flash(spark, sf_dir), "swf_tags", ["p_partkey"]).select("p_partkey", "pos", "code", "length", "depth")


def flash_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = files.parse(_flash(spark, sf_dir), "swf_assets", ["p_partkey"])
    return got.select("p_partkey", "pos", "name", "kind", "code", F.decode("content", "UTF-8").alias("content"), "reason")


def flash_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's extracted names and bytes, and what was left, as one JSON object."""
    assets = files.parse(_flash(spark, sf_dir), "swf_assets", ["p_partkey"])
    entry = F.struct("pos", "name", "kind", "size", "reason")
    listed = assets.groupBy("p_partkey").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    kept = F.transform(F.filter("e", lambda x: x["reason"].isNull()), lambda x: F.struct(x["name"].alias("file"), x["kind"].alias("kind"), x["size"].alias("bytes")))
    left = F.transform(F.filter("e", lambda x: x["reason"].isNotNull()), lambda x: F.struct(x["size"].alias("bytes"), x["reason"].alias("reason")))
    return listed.select("p_partkey", F.to_json(F.struct(kept.alias("assets"), left.alias("left"))).alias("manifest"))


def pdf_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as PDF files of one to five pages, whose title is written in brackets or in hex."""
    p = dealt(spark, sf_dir, "part", "p_partkey")
    n = F.col("p_size") % 5 + 1
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("("), "p_name", F.lit(")"))).otherwise(F.concat(F.lit("<"), F.hex(F.encode("p_name", "UTF-8")), F.lit(">")))
    text = F.concat(
        F.lit("%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Count "), n.cast("string"), F.lit(" /Kids [] >> endobj\n3 0 obj << /Title "), title, F.lit(" /Author (a\\(b\\)\\101) /Producer <FEFF00E9> >> endobj\n"),
        F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat((i + 3).cast("string"), F.lit(" 0 obj << /Type /Page /Parent 2 0 R >> endobj\n"))), ""), F.lit("trailer << /Root 1 0 R /Info 3 0 R >>\n%%EOF\n"),
    )
    got = files.parse(p.select("p_partkey", F.encode(text, "UTF-8").alias("content")), "pdf_info", ["p_partkey"])
    return got.select("p_partkey", "version", "pages", "encrypted", "title", "author", "producer", "keywords")


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' JPEG headers as pages of books of twenty."""
    c = table(spark, sf_dir, "customer")
    picture = F.concat(_hex("FFD8FFC0000B08"), _be(F.col("c_nationkey") + 1, 2), _be(F.col("c_custkey") % 300 + 1, 2), _hex("0101110000FFD9"))
    return c.select(F.floor(F.col("c_custkey") / 20).alias("book"), "c_custkey", picture.alias("content"))


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures as pages of PDF files, which are read again."""
    made = files.pdf_books(_pictures(spark, sf_dir), "book", "c_custkey", "content")
    return files.parse(made, "pdf_info", ["book"]).select("book", "version", "pages", "encrypted")


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books as archives with a picture a page and a note that is none."""
    p = _pictures(spark, sf_dir)
    name = F.concat(F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.when(F.col("c_custkey") % 7 == 0, F.lit(".txt")).otherwise(F.lit(".JPG")))
    made = files.book(p.withColumn("name", name), "book", "c_custkey", "name", "content")
    return files.parse(made, "book_info", ["book"]).select("book", "kind", "pages", "excluded")


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of archives of pages, with their content."""
    p = table(spark, sf_dir, "pages")
    pages = p.select(F.floor(F.col("page_id") / 50).alias("book"), "page_id", F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("content"))
    got = files.parse(files.book(pages, "book", "page_id", "name", "content"), "zip_members", ["book"])
    return got.select("book", "pos", "name", F.sha2("content", 256).alias("sha256"), "problem")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    pixel = F.concat(_be(F.col("c_nationkey"), 1), _be(F.col("c_custkey") % 256, 1), _hex("40FF"))
    return c.select(F.floor(F.col("c_custkey") / 10).alias("film"), "c_custkey", F.concat(*[pixel] * 6).alias("rgba"), F.lit(3).alias("w"), F.lit(2).alias("h"), ((F.col("c_custkey") % 10 + 1) / 10).alias("delay"))


def _animation(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    made = files.animations(_frames(spark, sf_dir), "film", "c_custkey", "rgba", "w", "h", "delay", kind, 3)
    got = files.parse(made, "image_info", ["film"])
    return got.select("film", "format", "width", "height", "frames", "loops", F.round(F.aggregate("delays", F.lit(0.0), lambda a, d: a + d), 3).alias("seconds"))


def animated_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as frames of animations, ten each, written as PNG and read again."""
    return _animation(spark, sf_dir, "apng")


def animated_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _animation(spark, sf_dir, "gif")


def made_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as samples, written as waves of several layouts and read again."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("pcm"), (F.lit(8000) * (F.col("doc_id") % 3 + 1)).cast("int").alias("rate"), (F.col("doc_id") % 2 + 1).cast("int").alias("channels"), F.lit(8).alias("bits"))
    made = files.waves(d, "pcm", "rate", "channels", "bits")
    return files.parse(made, "wav_info", ["doc_id"], "wave").select("doc_id", "codec", "rate", "channels", "bits", F.round(F.col("seconds") + 1e-9, 6).alias("seconds"))


def styled_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cues with style runs, written as SubRip and as WebVTT; both are read again alike."""
    from ..sources import sinks

    e = table(spark, sf_dir, "events")
    n = F.length("event_type")
    run = lambda lo, hi, style: F.struct(F.lit(lo).alias("lo"), hi.cast("int").alias("hi"), F.lit(style).alias("style"))
    cues = e.select("user_id", F.col("event_id").alias("pos"), (F.col("event_id") / 10.0).alias("start"), (F.col("event_id") / 10.0 + 1).alias("end"), F.concat("event_type", F.lit(" <&> x")).alias("text"), F.when(F.col("event_id") % 2 == 0, F.array(run(0, n, 3))).otherwise(F.array().cast("array<struct<lo:int,hi:int,style:int>>")).alias("runs"))
    parts = []
    for kind, sink in (("srt", sinks.subrip), ("vtt", sinks.webvtt)):
        text = sink(cues, "user_id").select("user_id", F.encode("text", "UTF-8").alias("content"))
        got = files.parse(text, "subtitle_cues", ["user_id"])
        runs = F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["lo"], r["hi"], r["style"])), ",")
        parts.append(got.select("user_id", F.lit(kind).alias("kind"), "pos", "text", runs.alias("runs")))
    return parts[0].unionByName(parts[1])


FUNCTIONS = (
    movie_tracks, movie_lengths, movie_samples, movie_cues, movie_chapters, movie_items, movie_retagged, id3_tags, id3_extras, flash_headers, flash_tags, flash_assets, flash_manifest,
    pdf_facts, pdf_pages, book_pages, archive_members, animated_png, animated_gif, made_waves, styled_subtitles,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}

_ANIMATION = """
SELECT c_custkey // 10 AS film, '{}' AS format, 3 AS width, 2 AS height, count(*) AS frames, 3 AS loops, round(sum((c_custkey % 10 + 1) / 10.0), 3)::DOUBLE AS seconds FROM customer GROUP BY 1"""
_BOOKS = "SELECT c_custkey // 20 AS book, count(*) AS pages FROM customer GROUP BY 1"
ORACLES = {
    "movie_tracks": """
SELECT p_partkey, 0 AS "index", p_size AS track_id, 'subtitle' AS kind, 'tx3g' AS code, true AS enabled, 3.0::DOUBLE AS seconds, CASE WHEN p_size % 2 = 0 THEN 'eng' ELSE 'deu' END AS language, 2 AS samples, strlen(p_name) + strlen(p_type) + 4 AS bytes FROM part""",
    "movie_lengths": "SELECT p_partkey, 3.0::DOUBLE AS seconds FROM part",
    "movie_samples": """
SELECT p_partkey, 0 AS pos, 0.0::DOUBLE AS start, 1.0::DOUBLE AS seconds, 20 AS "offset", strlen(p_name) + 2 AS size FROM part UNION ALL SELECT p_partkey, 1, 1.0, 2.0, 22 + strlen(p_name), strlen(p_type) + 2 FROM part""",
    "movie_cues": """
WITH p AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'eng' ELSE 'deu' END AS language FROM part)
SELECT p_partkey, language, 0 AS pos, 0.0::DOUBLE AS start, 1.0::DOUBLE AS "end", p_name AS text FROM p UNION ALL SELECT p_partkey, language, 1, 1.0, 3.0, p_type FROM p""",
    "movie_chapters": """
SELECT p_partkey, unnest([0, 1, 2]) AS pos, unnest([0.0, 1.0, 2.0])::DOUBLE AS start, 1.0::DOUBLE AS seconds, unnest(['start', p_brand, 'end']) AS title FROM part""",
    "movie_items": """
SELECT p_partkey, 0 AS pos, '\xa9nam' AS key, 'title' AS name, p_name AS text, NULL::BIGINT AS number FROM part UNION ALL SELECT p_partkey, 1, 'trkn', 'track', p_size || '/50', p_size FROM part UNION ALL SELECT p_partkey, 2, 'tvsn', 'season', NULL, p_size FROM part""",
    "movie_retagged": """
SELECT p_partkey, 'item' AS what, unnest([0, 1]) AS pos, unnest(['\xa9nam=' || upper(p_name), '----:com.example:note=' || p_size]) AS text FROM part
UNION ALL SELECT p_partkey, 'cue', unnest([0, 1]), unnest([p_name, p_type]) FROM part UNION ALL SELECT p_partkey, 'chapter', unnest([0, 1, 2]), unnest(['start', p_brand, 'end']) FROM part""",
    "id3_tags": """
SELECT p_partkey, unnest([0, 1, 2, 3, 4]) AS pos, unnest(['TIT2', 'TRCK', 'COMM', 'TXXX', 'APIC']) AS frame, unnest([NULL, NULL, '', 'brand', '']) AS description, unnest([p_name, p_size || '/50', p_type, p_brand, NULL]) AS text,
  unnest([NULL, NULL, NULL, NULL, 12]) AS picture_bytes, unnest([NULL, NULL, NULL, NULL, 'cover']) AS role FROM part""",
    "id3_extras": """SELECT p_partkey, p_type AS comment, '{"TXXX:brand":"' || p_brand || '"}' AS custom, 1 AS pictures, 'cover' AS role, 12 AS bytes FROM part""",
    "flash_headers": "SELECT p_partkey, 'none' AS compression, 8 AS version, 24.0::DOUBLE AS fps, p_size AS frames FROM part",
    "flash_tags": """
SELECT p_partkey, unnest(range(0, 9)) AS pos, unnest([9, 39, 87, 0, 18, 19, 60, 19, 0]) AS code, unnest([3, 4 + 6 + 6 + strlen(p_name) + 6, 6 + strlen(p_name), 0, 4, 4 + strlen(p_brand), 11, 4 + strlen(p_type), 0]) AS length, unnest([0, 0, 1, 1, 0, 0, 0, 0, 0]) AS depth FROM part""",
    "flash_assets": """
SELECT p_partkey, unnest([0, 1, 2]) AS pos, unnest(['binary-00009.bin', NULL, 'soundtrack-main.mp3']) AS name, unnest(['binary', NULL, 'soundtrack']) AS kind, unnest([87, 60, 19]) AS code, unnest([p_name, NULL, p_brand || p_type]) AS content, unnest([NULL, 'codec', NULL]) AS reason FROM part""",
    "flash_manifest": """
SELECT p_partkey, '{"assets":[{"file":"binary-00009.bin","kind":"binary","bytes":' || strlen(p_name) || '},{"file":"soundtrack-main.mp3","kind":"soundtrack","bytes":' || (strlen(p_brand) + strlen(p_type)) || '}],"left":[{"bytes":11,"reason":"codec"}]}' AS manifest FROM part""",
    "pdf_facts": "SELECT p_partkey, '1.4' AS version, p_size % 5 + 1 AS pages, false AS encrypted, p_name AS title, 'a(b)A' AS author, chr(233) AS producer, NULL::VARCHAR AS keywords FROM part",
    "pdf_pages": f"SELECT book, '1.7' AS version, pages, false AS encrypted FROM ({_BOOKS})",
    "book_pages": "SELECT c_custkey // 20 AS book, 'cbz' AS kind, count(*) FILTER (c_custkey % 7 <> 0) AS pages, count(*) FILTER (c_custkey % 7 = 0) AS excluded FROM customer GROUP BY 1",
    "archive_members": "SELECT page_id // 50 AS book, row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) - 1 AS pos, page_id || '.html' AS name, sha256(html) AS sha256, NULL::VARCHAR AS problem FROM pages",
    "animated_png": _ANIMATION.format("png"),
    "animated_gif": _ANIMATION.format("gif"),
    "made_waves": """
SELECT doc_id, 'pcm' AS codec, 8000 * (doc_id % 3 + 1) AS rate, doc_id % 2 + 1 AS channels, 8 AS bits, round(strlen(text) / (8000.0::DOUBLE * (doc_id % 3 + 1) * (doc_id % 2 + 1)) + 1e-9, 6) AS seconds FROM documents""",
    "styled_subtitles": """
WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_type || ' <&> x' AS text, CASE WHEN event_id % 2 = 0 THEN '0-' || length(event_type) || '-3' ELSE '' END AS runs FROM events)
SELECT user_id, unnest(['srt', 'vtt']) AS kind, pos, text, runs FROM c""",
}
