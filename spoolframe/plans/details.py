"""Queries over the shared tables for the smaller rules: sizes and times, rates, names, listings, libraries, wheels and markers, pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flash, geometry, media
from ..functions import text as T
from ..functions import versions as V
from ..operators import formats, kernels, library, matching, metadata, packages, pages, planned
from ..sources import files
from .selection import dealt, table


def _pick(values: list[str | None], n: Column) -> Column:
    """One of some constants by a number."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (n % len(values) + 1).cast("int"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def frame_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as clips: times of frames, windows to try, places on a canvas, and quarter turns."""
    p = _parts(spark, sf_dir)
    size, price = F.col("p_size"), F.col("p_retailprice")
    every = geometry.frame_times("every", size.cast("double"), F.lit(4.0))
    mid = geometry.frame_times("count", price, size % 4)
    windows = geometry.sample_ranges(size.cast("double"), 2, 5.0)
    place = geometry.canvas_fit(size, F.lit(20), F.lit(100), F.lit(50))
    turn = geometry.swaps_axes(*(F.when(size % 2 == 0, a).otherwise(b) for a, b in ((0.0, 1.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 1.0))))
    return p.select("p_partkey", F.size(every).alias("frames"), F.round(F.coalesce(F.try_element_at(every, F.lit(-1)), F.lit(-1.0)), 6).alias("last"), F.round(F.aggregate(mid, F.lit(0.0), lambda a, x: a + x), 3).alias("mids"), F.size(windows).alias("windows"), F.round(F.element_at(windows, -1)["start"], 6).alias("starts"), place["x"].alias("x"), place["y"].alias("y"), place["width"].alias("w"), place["height"].alias("h"), turn.alias("turned"))


def rate_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tracks: rates and bitrates within what an encoder takes, targets of a table, and lanes."""
    li = table(spark, sf_dir, "lineitem")
    rate = (F.col("l_quantity") * 1000).cast("int")
    ranges = F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in ((8000, 12000), (16000, 16000), (32000, 48000))))
    offers = F.array(*map(F.lit, [11025, 22050, 44100]))
    return li.select("l_orderkey", "l_linenumber", media.rate_at_or_below(rate, ranges).alias("below"), media.nearest_bitrate(rate, ranges).alias("nearest"), media.target_rate(rate, F.lit(40000), offers).alias("target"), media.lanes(F.lit(4), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber").cast("int"))).alias("lanes"), media.four_characters(F.lit(0x61766331) + F.col("l_linenumber")).alias("code"))


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of many extensions: picture format, container, chapters, type identifiers and what can be written."""
    p = _parts(spark, sf_dir)
    ext = _pick(["JPG", "heif", "mov", "m4b", "mp3", "qt", "wav", "xyz", "", "aifc", "avif", "png"], F.col("p_partkey"))
    name = F.when(ext == "", F.lit("file")).otherwise(F.concat(F.lit("a.b/file."), ext))
    fmt = media.image_format(media.extension(name))
    system = F.array(*map(F.lit, ["public.JPEG", "public.heif", "com.google.webp", "public.png"]))
    kind = _pick(["Public.HEIF", "com.google.webp", "public.none", "com.adobe.pdf"], F.col("p_size"))
    return p.select(
        "p_partkey", fmt.alias("format"), media.container_name(name).alias("container"), library.chapters_supported(media.extension(name)).alias("chapters"), library.format_of_type(kind).alias("typed"), library.writable_type(fmt, system).alias("writable"),
        F.array_join(library.readable_formats(system), ",").alias("readable"), media.can_animate(fmt, F.array(F.lit("heics"), F.lit("avif")), ["png", "gif"]).alias("animated"), media.first_supported(F.array(F.lit("jpegXL"), fmt, F.lit("jpeg")), F.array(F.lit("avif"), F.lit("jpeg"))).alias("first"),
        F.array_join(library.capabilities(F.array_compact(F.array(fmt)), ["webp"]), ",").alias("all"),
    )


def sources_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages' addresses as sources, some in other schemes."""
    p = table(spark, sf_dir, "pages")
    n = F.col("page_id") % 5
    host = F.regexp_extract("url", r"^[a-z]+://(.*)$", 1)
    url = F.when(n == 0, F.concat(F.lit("FILE:///"), host)).when(n == 1, F.concat(F.lit("ftp://"), host)).when(n == 2, F.lit("http:///none")).when(n == 3, F.concat(F.lit("x"), host)).otherwise(F.col("url"))
    tool = F.when(F.col("page_id") % 11 == 0, F.lit("gallery"))
    named = F.when(F.col("page_id") % 7 == 0, F.lit("video site"))
    where = flash.route(F.concat("url", F.when(F.col("page_id") % 3 == 0, F.lit("/a.MP4?x=1")).otherwise(F.lit("/a"))), tool, named, F.col("page_id") % 2 == 0)
    extractor = library.extractor_of(p.select("page_id", "url"), [("paged", r"page/?\d*0$"), ("any", r"^http")], "url")
    return p.select("page_id", F.coalesce(files.allowed_source(url), F.lit(False)).alias("allowed"), where.alias("route")).join(extractor.select("page_id", "extractor"), "page_id")


def title_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as file paths with a year, and the title that would be searched for."""
    p = _parts(spark, sf_dir)
    path = F.concat(F.lit("films/old/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), (1950 + F.col("p_partkey") % 70).cast("string"), F.lit(".1080p.mkv"))
    got = T.with_file_title(p.select("p_partkey", path.alias("path")), "path", "t")
    return got.select("p_partkey", F.col("t.title").alias("title"), F.col("t.year").alias("year"))


def word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's words as ranges: how many, how much of the text they hold, and the last one."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.word_ranges(F.coalesce("text", F.lit(""))).alias("r"))
    held = F.aggregate("r", F.lit(0), lambda a, x: a + x["stop"] - x["start"])
    return d.select("doc_id", F.size("r").alias("words"), held.alias("held"), F.try_element_at("r", F.lit(-1))["start"].alias("start"), F.try_element_at("r", F.lit(-1))["stop"].alias("stop"))


def subtitle_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as subtitle files known by extension or by content, and their times as dates."""
    e = table(spark, sf_dir, "events")
    ext = _pick(["srt", "VTT", "ass", None, None, "txt"], F.col("event_id"))
    content = _pick(["WEBVTT\n\n", "[Script Info]", "1\n00:01 --> 00:02\nx", "nothing"], F.floor(F.col("event_id") / 6))
    return e.select("event_id", T.subtitle_kind(ext, content).alias("kind"), T.iso_date("ts").alias("written"), library.release_year(F.concat(F.year("ts").cast("string"), F.lit(".1.2"))).alias("year"))


def file_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as files under the recipe's own sizes: up to two mebibytes are hashed whole."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return d.select("doc_id", T.fingerprint(F.col("content"), F.col("doc_id") * 1000).alias("fingerprint"))


def lenient_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's properties, read as they come; absent keys are null."""
    from ..functions import lenient as L

    e = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return e.select("event_id", L.lenient_long(F.col("v"), "$.k").alias("k_long"), L.lenient_string(F.col("v"), "$.k").alias("k_string"), L.lenient_double(F.col("v"), "$.k").alias("k_double"), L.lenient_long(F.col("v"), "$.none").alias("none"))


def _metadata_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    key = _pick(["itunes.GPSlat", "id3.APIC", "com.apple.iTunes.tool", "exif.MakerApple.17", None], F.col("p_partkey"))
    return p.select("p_partkey", key.alias("key"), _pick([None, "title", "artwork"], F.col("p_size")).alias("common"), _pick(["itunes", "id3", "quicktime metadata"], F.col("p_partkey")).alias("key_space"))


def items_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as metadata items under two policies: classes stripped, and keys allowed."""
    rows = _metadata_items(spark, sf_dir)
    group = metadata.audio_class(F.lit(None).cast("string"), F.col("key"))
    stripped = metadata.filter_items(rows, group, strip=["gps", "software"]).select("p_partkey", F.lit("strip").alias("policy"))
    allowed = metadata.filter_items(rows, group, allow=["id3.APIC"]).select("p_partkey", F.lit("allow").alias("policy"))
    return stripped.unionByName(allowed)


def items_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items as a destination in the iTunes key space keeps them."""
    return metadata.audio_items_for(_metadata_items(spark, sf_dir), True).select("p_partkey", "to_key")


def still_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as picture properties: IPTC and TIFF in their orders, and signed places."""
    p = _parts(spark, sf_dir)
    entry = lambda k, v: (F.lit(k), v.cast("string"))
    n = F.col("p_partkey") % 3
    props = F.create_map(*(x for pair in (
        entry("iptc.ObjectName", F.when(n == 0, F.lit("")).otherwise(F.col("p_name"))), entry("tiff.DocumentName", F.col("p_type")), entry("tiff.Artist", F.when(n == 1, F.lit(None)).otherwise(F.col("p_brand"))), entry("iptc.Byline", F.lit("by")),
        entry("gps.Latitude", F.col("p_size") / 2), entry("gps.LatitudeRef", F.when(n == 2, "S").otherwise("N")), entry("gps.Altitude", F.col("p_size")), entry("gps.AltitudeRef", n),
    ) for x in pair))
    got = p.select("p_partkey", metadata.still_record(props).alias("r"))
    edited = metadata.edit(got, "r", {"title": F.upper("r.title"), "summary": F.lit("set")})
    return edited.select("p_partkey", "r.title", "r.summary", "r.artist", "r.latitude", "r.longitude", "r.altitude")


def read_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as an extractor's listing in awkward types, read leniently and written again."""
    li = table(spark, sf_dir, "lineitem")
    one = F.to_json(F.struct(F.col("l_linenumber").alias("format_id"), F.col("l_partkey").cast("string").alias("height"), F.lit("none").alias("vcodec"), (F.col("l_quantity") + 0.5).alias("fps"), F.when(F.col("l_returnflag") == "R", F.lit(True)).alias("has_drm")))
    texts = li.groupBy(F.col("l_orderkey").alias("listing_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", one.alias("j")))).alias("f"))
    json = texts.select("listing_id", F.concat(F.lit('{"formats":['), F.array_join(F.transform("f", lambda x: x["j"]), ","), F.lit("]}")).alias("json"))
    rows = formats.renditions(json)
    again = library.rendition_json({"format_id": F.col("format_id"), "height": F.col("height"), "vcodec": F.coalesce("vcodec", F.lit("none"))})
    return rows.select("listing_id", "pos", "format_id", "height", "fps", "vcodec", "has_drm", again.alias("json"))


def gallery_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as galleries: entries up to three, and whether there were more."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    shown = pages.limited(pages.number(c, ["conv_id"], ["turn", "size"]), "conv_id", ["pos"], 3)
    return shown.select("conv_id", "pos", "size", "truncated")


def gallery_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as gallery JSON of their lines, read as a table of files."""
    li = table(spark, sf_dir, "lineitem")
    entry = F.struct(F.concat(F.lit("https://h/"), F.col("l_partkey").cast("string")).alias("url"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".jpg")).alias("filename"), F.when(F.col("l_returnflag") == "A", F.lit("skipped")).alias("note"))
    made = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("files"))
    text = made.select("l_orderkey", F.to_json(F.struct(F.lit("site").alias("category"), F.lit(None).cast("string").alias("subcategory"), F.col("files"))).alias("json"))
    return formats.gallery(text, "l_orderkey", "json").select("l_orderkey", "category", "pos", "url", "filename")


def index_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as projects of a package index, whose JSON is read as releases with their wheels.

    A brand's index comes in pages by ranges of part keys, so no text grows with the table.
    """
    p = _parts(spark, sf_dir)
    page = F.floor(F.col("p_partkey") / 20000)
    version = F.concat((F.col("p_size") % 5).cast("string"), F.lit("."), F.col("p_partkey").cast("string"))
    name = F.concat(F.lit("pkg-"), version, F.when(F.col("p_partkey") % 3 == 0, F.lit(".tar.gz")).otherwise(F.lit("-py3-none-any.whl")))
    file = F.struct(name.alias("filename"), F.when(F.col("p_partkey") % 3 == 0, "sdist").otherwise("bdist_wheel").alias("packagetype"), F.concat(F.lit("https://h/"), name).alias("url"), F.col("p_size").alias("size"), (F.col("p_partkey") % 4 == 0).alias("yanked"), F.when(F.col("p_size") % 2 == 0, F.lit(">=3.9")).alias("requires_python"), F.create_map(F.lit("sha256"), F.lit("AB")).alias("digests"))
    made = p.groupBy("p_brand", page.alias("page")).agg(F.map_from_entries(F.collect_list(F.struct(version.alias("k"), F.array(file).alias("v")))).alias("releases"))
    text = made.select("p_brand", F.to_json(F.struct(F.struct(F.col("p_brand").alias("name")).alias("info"), "releases")).alias("json"))
    got = packages.releases_of(text, "p_brand", "json")
    return got.select("p_brand", "project", "version", "requires_python", "files", "wheel", "sha256")


def wheels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as wheels of their brand: the one to install, and its name's parts."""
    p = _parts(spark, sf_dir)
    tag = _pick(["py3-none-any", "py2.py3-none-any", "cp312-cp312-linux_x86_64"], F.col("p_partkey"))
    rows = p.select(F.col("p_brand").alias("project"), (F.col("p_size") % 3).cast("string").alias("version"), F.concat(F.lit("pkg-"), F.col("p_partkey").cast("string"), F.lit("-"), tag, F.lit(".whl")).alias("filename"), (F.col("p_partkey") % 5 == 0).alias("yanked"))
    parts = T.wheel_parts(F.col("filename"))
    return packages.best_wheel(rows).select("project", "version", "filename", parts["python"].alias("python"), parts["platform"].alias("platform"))


def digests_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against a digest in hex, every third of which is another's."""
    d = table(spark, sf_dir, "documents")
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    wanted = F.when(F.col("doc_id") % 3 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.upper(F.sha2(content, 256)))
    return d.select("doc_id", library.digest_matches(content, wanted).alias("fine"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as environments under markers of every form."""
    p = dealt(spark, sf_dir, "part", "p_partkey")
    python = F.concat(F.lit("3."), (F.col("p_size") % 15).cast("string"))
    env = {"python_version": python, "os_name": _pick(["posix", "nt"], F.col("p_partkey")), "extra": _pick(["", "test"], F.col("p_size"))}
    texts = {"newer": "python_version >= '3.10'", "both": "python_version < \"3.9\" and os_name == 'nt'", "either": "(extra == 'test' or os_name != 'posix') and python_version ~= '3.2'", "inside": "'os' in os_name", "outside": "os_name not in 'nt dos'", "unknown": "platform_machine == 'x'", "none": ""}
    return p.select("p_partkey", *(V.marker_column(t, env).alias(k) for k, t in texts.items()))


def version_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as releases with local parts and epochs against clauses that tell them apart."""
    p = dealt(spark, sf_dir, "part", "p_partkey")
    n = F.col("p_partkey") % 6
    v = F.when(n == 0, "1.2+local.1").when(n == 1, "1!1.4.2").when(n == 2, "1.9").when(n == 3, "1.4").when(n == 4, "1.4.0.post1").otherwise("2.0a1")
    clauses = {"eq": "==1.2", "eq_local": "==1.2+local.1", "ne": "!=1.2", "wild": "==1.4.*", "unwild": "!=1.4.*", "short": "~=1", "near": "~=1.4", "epoch": "==1!1.4.*", "below": "<2.0", "odd": "==not-a-version", "over": ">1!0"}
    return p.select("p_partkey", *(V.satisfies(v, F.lit(c)).alias(k) for k, c in clauses.items()))


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands' packages of sizes as versions, resolved from two roots, in the order of installation."""
    p = _parts(spark, sf_dir)
    name = F.concat(F.lit("p"), (F.col("p_partkey") % 4).cast("string"))
    releases = p.select(name.alias("project"), F.concat((F.col("p_size") % 6).cast("string"), F.lit(".0")).alias("version"), F.lit(None).cast("string").alias("requires_python"), F.lit(True).alias("is_pure")).distinct()
    after = lambda k: F.concat(F.lit("p"), ((F.substring("project", 2, 1).cast("int") + k) % 4).cast("string"))
    texts = F.array(F.concat(after(1), F.lit(" >=1; python_version >= '3.8'")), F.concat(after(2), F.lit("; extra == 'x'")))
    needs = releases.where("project <> 'p3'").select("project", "version", F.posexplode(texts).alias("pos", "text"))
    plan = packages.resolve(spark, releases, needs, ["p0<4", "p2!=5.*"], "3.11", {"p3": "2.0"})
    rows = [("install", i, n, v) for i, (n, v) in enumerate(plan.steps)] + [("present", i, n, v) for i, (n, v) in enumerate(plan.satisfied)] + [("excluded", i, a, c) for i, (a, _, c) in enumerate(plan.excluded)]
    return spark.createDataFrame(rows, "what string, pos int, name string, detail string")


def flash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as payloads: kinds by their first bytes, shared JPEG tables set in, and sound headers."""
    p = _parts(spark, sf_dir)
    heads = ["FFD8FFE0", "89504E470D0A1A0A", "474946383961", "494433", "FFFB90", "52494646000000005741564500", "464F524D0000000041494646", "664C6143", "0000001866747970", "4F676753", "504B0304", "435753", "3C3F786D6C", "00"]
    head = F.unhex(_pick(heads, F.col("p_partkey")))
    merged = flash.with_tables(F.unhex(F.concat(F.when(F.col("p_size") % 2 == 0, "FFD9FFD8").otherwise(""), F.lit("FFD8AAFFD9"))), F.unhex(F.lit("FFD8BBFFD9")))
    sound = flash.sound_header((F.col("p_size") % 256).cast("int"))
    return p.select("p_partkey", flash.payload_kind(head).alias("kind"), F.hex(merged).alias("merged"), F.hex(flash.without_stray_prefix(F.unhex(F.lit("FFD9FFD8FF")))).alias("plain"), *(sound[k].alias(k) for k in ("codec", "rate", "bits", "channels")))


def flash_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as fifteen-bit pictures of two by one pixels in a stored stream, as PNG."""
    p = dealt(spark, sf_dir, "part", "p_partkey")
    be = lambda c, n: F.unhex(F.lpad(F.hex(c.cast("long")), 2 * n, "0"))
    value = (F.col("p_size") % 32) * 1024 + (F.col("p_partkey") % 32)
    high, low = F.shiftright(value.cast("int"), 8), value.bitwiseAND(F.lit(255))
    a = 1 + high + low + 0x7F + 0xFF
    b = F.lit(4) + 4 * high + high + 0 + 3 * low + 2 * 0x7F + 0xFF
    data = F.concat(be(high, 1), be(low, 1), F.unhex(F.lit("7FFF")))
    stored = F.concat(F.unhex(F.lit("7801010400FBFF")), data, be(4 + 4 * high + 3 * low + 2 * 0x7F + 0xFF, 2), be(a, 2))
    body = F.concat(F.unhex(F.lit("0402000100")), F.when(F.col("p_partkey") % 5 == 0, F.unhex(F.lit("00"))).otherwise(stored))
    made = p.select("p_partkey", "p_size", flash.lossless_png(body, F.lit(False)).alias("content"))
    return files.parse(made, "image_info", ["p_partkey"]).select("p_partkey", "format", "width", "height")


def native_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as tracks planned for a transcode."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("lossless"), (F.floor("l_extendedprice") * 4).alias("bitrate"), F.lit(96000).alias("rate"), (F.col("l_linenumber") + 0).cast("int").alias("channels"), F.lit(True).alias("has_layout"))
    return planned.audio_plan(li, 0.5).select("l_orderkey", "l_linenumber", "to_codec", "to_bitrate", "to_rate", "to_channels", "skip", "loses_again")


def native_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files under every kind of native work: what would be made, or why it is skipped."""
    p = _parts(spark, sf_dir)
    n = F.col("p_partkey")
    items = p.select(
        "p_partkey", F.when(n % 7 == 0, 0).otherwise(F.col("p_size") * 40).cast("int").alias("width"), (F.col("p_size") * 20).cast("int").alias("height"), F.when(n % 5 == 0, None).otherwise(F.lit(25.0)).alias("fps"), (n % 4).cast("int").alias("channels"), F.lit(30000).alias("rate"),
        (n % 3).cast("int").alias("frames"), (n % 2).cast("int").alias("chapters"), _pick(["mp4", "wav", "MOV"], n).alias("ext"), _pick(["ger", "x", "en-us"], F.col("p_size")).alias("language"), _pick(["avc1", "vp9", None], n).alias("vcodec"), _pick(["mp4a", "opus"], n).alias("acodec"), _pick(["https://h/a", "ftp://h/a"], n).alias("url"), F.col("p_size").cast("double").alias("seconds"),
    )
    settings = {"video transcode": {"side": 1000}, "av1 encode": {"side": 1000}, "text recognition": {"offered": ("de-DE", "en-US")}, "still encode": {"side": 500}}
    out = None
    for work in planned.NATIVE:
        one = planned.native_plan(items, work, **settings.get(work, {})).select("p_partkey", "work", "status", "settings", "reason")
        out = one if out is None else out.unionByName(one)
    return out


def library_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as animations, documents and queues: canvas, distinct bytes, leftovers, states, clauses, all in one row each."""
    li = table(spark, sf_dir, "lineitem")
    frames = li.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("pos"), (F.col("l_partkey") % 2 + 1).cast("int").alias("width"), F.lit(3).alias("height"))
    canvas = library.canvas(frames, "l_orderkey", "uniform").select("l_orderkey", "width", "reason")
    size = library.distinct_bytes(li.select("l_orderkey", F.col("l_suppkey").alias("source"), F.col("l_suppkey").alias("size")), "l_orderkey", "source", "size")
    name = F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 3 == 0, ".xml").otherwise(".jpg"))
    left = library.left_over(li.select("l_orderkey", name.alias("name")), "l_orderkey", "name", media.is_page(F.col("name"), F.lit(False)))
    states = library.download_states(li.select("l_orderkey", _pick(["finished", "running", "failed", "queued"], F.col("l_partkey")).alias("state")), "l_orderkey", "state")
    clauses = library.merged_clauses(li.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("pos"), F.array(F.concat(F.lit(">="), (F.col("l_partkey") % 3).cast("string")), F.lit("<9")).alias("clauses")), "l_orderkey", "clauses", "pos")
    out = canvas
    for part in (size, left.select("l_orderkey", F.array_join("dropped", ",").alias("dropped")), states, clauses.select("l_orderkey", F.array_join("clauses", ",").alias("clauses"))):
        out = out.join(part, "l_orderkey")
    return out


def removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' types as folders, and the order in which they would be removed."""
    p = _parts(spark, sf_dir).select(F.replace("p_type", F.lit(" "), F.lit("/")).alias("path")).distinct()
    return library.removal_order(p, "path").select("path", F.col("removal_key.length").alias("first"))


def assembled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages named by source and place, one of which is not there; archives in the order of bytes, frames in that of numbers."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    have = pages.number(c, ["conv_id"], ["turn", "role", "size"], "index").select(F.col("conv_id").alias("source"), "index", "size")
    wanted = have.select(F.floor(F.col("source") / 2).alias("doc"), "source", F.when(F.col("index") == 1, 99).otherwise(F.col("index")).alias("index"), F.concat(F.lit("p"), F.col("index").cast("string"), F.lit(".jpg")).alias("name"))
    got = pages.assemble(wanted, have)
    ranked = pages.archive_order(got.withColumn("name", F.concat("name", F.lit("-"), F.col("source").cast("string"))), "doc", "name")
    return pages.frame_order(ranked, "name").select("doc", "source", "index", "pos", "frame_key", F.coalesce("found", F.lit(False)).alias("found"))


def tag_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag code that parts can stand for, odd ones among them."""
    p = _parts(spark, sf_dir)
    code = (F.col("p_partkey") % 96).cast("int")
    return p.groupBy(code.alias("code")).agg(F.count("*").alias("n"), F.first(flash.tag_kind(code)).alias("kind"))


def network_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as errors of the transport and of the platform."""
    e = table(spark, sf_dir, "events")
    message = _pick(["Connection reset by peer", "The read operation timed out", "Unable to download webpage: x", "Temporary failure in name resolution", "nothing known", None, "is live, timed out"], F.col("event_id"))
    kind = F.when(F.col("event_id") % 5 == 0, "HTTPError").when(F.col("event_id") % 5 == 1, None).otherwise("ExtractorError")
    return e.select("event_id", flash.error_class(kind, message, F.col("event_id") % 11 == 0).alias("class"))


def picture_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as flat and mixed pictures of two by two pixels: flat, detail, and set into a canvas of four."""
    c = dealt(spark, sf_dir, "customer", "c_custkey")
    be = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    one, other = F.concat(be(F.col("c_nationkey")), F.unhex(F.lit("1020FF"))), F.unhex(F.lit("F0F0F0FF"))
    rgba = F.when(F.col("c_custkey") % 2 == 0, F.concat(one, one, one, one)).otherwise(F.concat(one, other, other, other))
    rows = c.select("c_custkey", rgba.alias("rgba"), F.lit(2).alias("w"), F.lit(4).alias("side"))
    return rows.select("c_custkey", kernels.is_flat("rgba").alias("flat"), F.round(kernels.detail("rgba"), 4).alias("detail"), F.sha2(kernels.composed("rgba", "w", "w", "side", "side"), 256).alias("composed"))


def worst_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as scores of an order's parts, of which the worst count."""
    li = table(spark, sf_dir, "lineitem")
    return kernels.combine(li.select("l_orderkey", (1 - F.col("l_tax")).alias("overall"), (1 - F.col("l_discount")).alias("worst")), "l_orderkey")


def language_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' wanted languages as those on offer, and the first locale of an order with chapters."""
    e = table(spark, sf_dir, "events").select("event_id", F.array(_pick(["EN-us", "pt", "zh-Hant", "xx"], F.col("event_id")), F.lit("de")).alias("w"))
    return e.select("event_id", F.array_join(matching.resolve_languages(F.col("w"), F.array(*map(F.lit, ["en-US", "de-DE", "pt-BR", "zh-Hans"]))), ",").alias("languages"))


FUNCTIONS = (
    frame_plans, rate_choices, file_kinds, sources_allowed, title_queries, word_spans, subtitle_kinds, file_fingerprints, lenient_properties, items_filtered, items_moved, still_records, read_listings, gallery_entries, gallery_contents,
    index_releases, wheels, digests_checked, markers, version_edges, resolutions, flash_bytes, flash_pictures, native_codes, native_plans, library_rows, removal, assembled_pages, tag_codes, network_errors, picture_kernels, worst_scores, language_matches,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}

ORACLES = {
    "frame_plans": """
WITH p AS (SELECT p_partkey, p_size AS s, p_retailprice AS r FROM part), c AS (SELECT *, (s - 1) // 4 AS last, s % 4 AS m, s <= 15 AS whole, least(100.0::DOUBLE / s, 2.5) AS f FROM p)
SELECT p_partkey, last + 1 AS frames, last * 4.0::DOUBLE AS "last", round(CASE WHEN m = 0 THEN 0 ELSE r * m / 2 END, 3) AS mids, CASE WHEN whole THEN 1 ELSE 2 END AS windows, CASE WHEN whole THEN 0.0 ELSE round(1.5 * s / 2 - 2.5, 6) END::DOUBLE AS starts,
  CAST(floor((100 - round(s * f)) / 2) AS INTEGER) AS x, CAST(floor((50 - round(20 * f)) / 2) AS INTEGER) AS y, CAST(round(s * f) AS INTEGER) AS w, CAST(round(20 * f) AS INTEGER) AS h, s % 2 = 0 AS turned FROM c""",
    "rate_choices": """
WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 1000 AS INTEGER) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN r BETWEEN 8000 AND 12000 OR r = 16000 OR r BETWEEN 32000 AND 48000 THEN r WHEN r > 48000 THEN 48000 WHEN r > 16000 THEN 16000 WHEN r > 12000 THEN 12000 END AS below,
  CASE WHEN r BETWEEN 8000 AND 12000 OR r = 16000 OR r BETWEEN 32000 AND 48000 THEN r ELSE least(greatest(r, 8000), 48000) END AS nearest,
  CASE WHEN least(r, 40000) >= 22050 THEN 22050 ELSE 11025 END AS target, CASE WHEN l_linenumber > 2 THEN least(4, l_linenumber) ELSE 4 END AS lanes, 'avc' || chr(49 + l_linenumber) AS code FROM l""",
    "file_kinds": """
WITH p AS (SELECT p_partkey, p_partkey % 12 AS n, p_size % 4 AS k FROM part),
f AS (SELECT *, ['jpeg', 'heic', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'avif', 'png'][n + 1] AS fmt FROM p)
SELECT p_partkey, fmt AS format, ['jpg', 'heif', 'mov,mp4,m4a,3gp,3g2,mj2', 'm4b', 'mp3', 'mov,mp4,m4a,3gp,3g2,mj2', 'wav', 'xyz', 'unknown', 'aiff', 'avif', 'png'][n + 1] AS container,
  CASE WHEN n IN (2, 3) THEN NULL WHEN n = 4 THEN 'chapters of this container are not written' ELSE 'this container holds no chapters' END AS chapters, ['heic', 'webp', NULL, 'pdf'][k + 1] AS typed,
  CASE fmt WHEN 'heic' THEN 'public.heif' WHEN 'png' THEN 'public.png' END AS writable, 'heic,jpeg,png,webp' AS readable, CASE WHEN fmt IS NOT NULL THEN fmt IN ('png') END AS animated, CASE WHEN fmt = 'avif' THEN 'avif' ELSE 'jpeg' END AS first,
  CASE WHEN fmt IS NULL THEN 'webp' ELSE fmt || ',webp' END AS "all" FROM f""",
    "sources_allowed": """
SELECT page_id, page_id % 5 IN (0, 4) AS allowed, CASE WHEN page_id % 11 = 0 THEN 'gallery' WHEN page_id % 3 = 0 THEN 'direct' WHEN page_id % 7 = 0 THEN 'media' WHEN page_id % 2 = 0 THEN 'gallery' ELSE 'media' END AS route,
  CASE WHEN regexp_matches(url, 'page/?[0-9]*0$') THEN 'paged' WHEN regexp_matches(url, '^http') THEN 'any' END AS extractor FROM pages""",
    "title_queries": "SELECT p_partkey, p_name AS title, 1950 + p_partkey % 70 AS year FROM part",
    "word_spans": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '[^ \t\n\x0B\f\r]+') AS ws FROM d), e AS (SELECT *, length(regexp_replace(t, '[ \t\n\x0B\f\r]+$', '')) AS stop FROM w)
SELECT doc_id, len(ws) AS words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS held, CASE WHEN len(ws) > 0 THEN stop - length(ws[-1]) END AS start, CASE WHEN len(ws) > 0 THEN stop END AS stop FROM e""",
    "subtitle_kinds": """
WITH e AS (SELECT *, event_id % 6 AS n, (event_id // 6) % 4 AS k FROM events)
SELECT event_id, CASE n WHEN 0 THEN 'subrip' WHEN 1 THEN 'webvtt' WHEN 2 THEN 'substation' ELSE ['webvtt', 'substation', 'subrip', 'unknown'][k + 1] END AS kind, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS written, year(ts) AS year FROM e""",
    "file_fingerprints": "SELECT doc_id, 'v1:' || sha256('size=' || strlen(text) || ';mtime=' || doc_id * 1000 || text) AS fingerprint FROM documents",
    "lenient_properties": "SELECT event_id, (props->>'$.k')::BIGINT AS k_long, props->>'$.k' AS k_string, (props->>'$.k')::DOUBLE AS k_double, NULL::BIGINT AS none FROM events",
    "items_filtered": """
SELECT p_partkey, 'strip' AS policy FROM part WHERE p_partkey % 5 NOT IN (0, 2) UNION ALL SELECT p_partkey, 'allow' FROM part WHERE p_partkey % 5 IN (1, 3)""",
    "items_moved": """
WITH p AS (SELECT p_partkey, ['itunes.GPSlat', 'id3.APIC', 'com.apple.iTunes.tool', 'exif.MakerApple.17', NULL][p_partkey % 5 + 1] AS k, [NULL, 'song name', 'cover art'][p_size % 3 + 1] AS c, p_partkey % 3 AS s FROM part)
SELECT p_partkey, CASE WHEN s = 1 THEN c ELSE k END AS to_key FROM p WHERE CASE WHEN s = 1 THEN c ELSE k END IS NOT NULL""",
    "still_records": """
SELECT p_partkey, upper(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END) AS title, 'set' AS summary, CASE WHEN p_partkey % 3 = 1 THEN 'by' ELSE p_brand END AS artist,
  CASE WHEN p_partkey % 3 = 2 THEN -p_size / 2.0 ELSE p_size / 2.0 END::DOUBLE AS latitude, NULL::DOUBLE AS longitude, CASE WHEN p_partkey % 3 = 1 THEN -p_size ELSE p_size END::DOUBLE AS altitude FROM part""",
    "read_listings": """
SELECT l_orderkey AS listing_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS pos, l_linenumber::VARCHAR AS format_id, l_partkey AS height, l_quantity + 0.5 AS fps, 'none' AS vcodec, l_returnflag = 'R' AS has_drm,
  '{"format_id":"' || l_linenumber || '","height":' || l_partkey || ',"vcodec":"none"}' AS json FROM lineitem""",
    "gallery_entries": """
WITH r AS (SELECT conv_id, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, pos, size, n > 3 AS truncated FROM r WHERE pos < 3""",
    "gallery_contents": """
WITH l AS (SELECT l_orderkey, 'https://h/' || l_partkey AS url, l_linenumber || '.jpg' AS filename, CASE WHEN l_returnflag = 'A' THEN 'skipped' END AS note FROM lineitem)
SELECT l_orderkey, 'site' AS category, row_number() OVER (PARTITION BY l_orderkey ORDER BY url, filename, note NULLS FIRST) - 1 AS pos, url, filename FROM l""",
    "index_releases": """
WITH p AS (SELECT p_brand, p_size % 5 || '.' || p_partkey AS version, p_partkey % 3 = 0 AS source, p_size FROM part WHERE p_partkey % 4 <> 0)
SELECT p_brand, p_brand AS project, version, CASE WHEN p_size % 2 = 0 THEN '>=3.9' END AS requires_python, 1 AS files, CASE WHEN NOT source THEN 'pkg-' || version || '-py3-none-any.whl' END AS wheel, CASE WHEN NOT source THEN 'ab' END AS sha256 FROM p""",
    "wheels": """
WITH p AS (SELECT p_brand AS project, (p_size % 3)::VARCHAR AS version, p_partkey % 3 AS n, ['py3', 'py2.py3'][p_partkey % 3 + 1] AS python, 'pkg-' || p_partkey || '-' || ['py3-none-any', 'py2.py3-none-any', 'cp312-cp312-linux_x86_64'][p_partkey % 3 + 1] || '.whl' AS filename FROM part WHERE p_partkey % 5 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY project, version ORDER BY n, filename) AS k FROM p WHERE n < 2) SELECT project, version, filename, python, 'any' AS platform FROM r WHERE k = 1""",
    "digests_checked": "SELECT doc_id, doc_id % 3 <> 0 AS fine FROM documents",
    "markers": """
WITH p AS (SELECT p_partkey, p_size % 15 AS m, p_partkey % 2 = 0 AS posix, p_size % 2 = 1 AS test FROM part)
SELECT p_partkey, m >= 10 AS newer, m < 9 AND NOT posix AS both, (test OR NOT posix) AND m >= 2 AS either, posix AS inside, posix AS outside, false AS unknown, true AS none FROM p""",
    "version_edges": """
WITH p AS (SELECT p_partkey, p_partkey % 6 AS n FROM part)
SELECT p_partkey, n = 0 AS eq, n = 0 AS eq_local, n <> 0 AS ne, n IN (3, 4) AS wild, n NOT IN (3, 4) AS unwild, false AS short, n IN (2, 3, 4) AS near, n = 1 AS epoch, n <> 1 AS below, false AS odd, n = 1 AS over FROM p""",
    "resolutions": """
SELECT 'install' AS what, 0 AS pos, 'p2' AS name, max(p_size % 6) FILTER (p_partkey % 4 = 2 AND p_size % 6 <> 5) || '.0' AS detail FROM part UNION ALL SELECT 'install', 1, 'p1', max(p_size % 6) FILTER (p_partkey % 4 = 1 AND p_size % 6 >= 1) || '.0' FROM part
UNION ALL SELECT 'install', 2, 'p0', max(p_size % 6) FILTER (p_partkey % 4 = 0 AND p_size % 6 < 4) || '.0' FROM part UNION ALL SELECT 'present', 0, 'p3', '2.0'
UNION ALL SELECT 'excluded', unnest([0, 1, 2]), unnest(['p0', 'p2', 'p1']), 'extra not requested'""",
    "flash_bytes": """
SELECT p_partkey, ['jpeg', 'png', 'gif', 'mp3', 'mp3', 'wav', 'aiff', 'flac', 'mp4', 'ogg', 'zip', 'swf', 'xml', 'unknown'][p_partkey % 14 + 1] AS kind, 'FFD8AABBFFD9' AS merged, 'FF' AS plain,
  p_size % 256 // 16 AS codec, [5512, 11025, 22050, 44100][p_size // 4 % 4 + 1] AS rate, CASE WHEN p_size // 2 % 2 = 1 THEN 16 ELSE 8 END AS bits, p_size % 2 + 1 AS channels FROM part""",
    "flash_pictures": "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN 'png' END AS format, CASE WHEN p_partkey % 5 <> 0 THEN 2 END AS width, CASE WHEN p_partkey % 5 <> 0 THEN 1 END AS height FROM part",
    "native_codes": """
WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS lossless, CAST(floor(l_extendedprice) AS BIGINT) * 4 AS rate, CASE WHEN l_linenumber <= 2 THEN l_linenumber ELSE 2 END AS c FROM lineitem), t AS (SELECT *, 60000 * c AS target FROM l),
s AS (SELECT *, CASE WHEN lossless THEN NULL WHEN target <= rate * 0.75 THEN NULL ELSE 'saves too little' END AS skip FROM t)
SELECT l_orderkey, l_linenumber, 'aac' AS to_codec, target AS to_bitrate, 48000 AS to_rate, c AS to_channels, skip, NOT lossless AND skip IS NULL AS loses_again FROM s""",
    "native_plans": """
WITH p AS (SELECT p_partkey, p_partkey AS n, p_size AS s, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size * 40 END AS w, p_size * 20 AS h, CASE WHEN p_partkey % 7 = 0 THEN 'no picture size' END AS size FROM part),
f AS (SELECT *, CASE WHEN w > 1000 THEN 1000 ELSE w END AS fw, CASE WHEN w > 1000 THEN 500 ELSE h END AS fh, CASE WHEN w > 500 THEN 500 ELSE w END AS sw, CASE WHEN w > 500 THEN 250 ELSE h END AS sh, CASE WHEN w > 320 THEN 320 ELSE w END AS tw, CASE WHEN w > 320 THEN 160 ELSE h END AS th, ['deu', NULL, 'en-US'][s % 3 + 1] AS tag FROM p),
r AS (
  SELECT p_partkey, 'still encode' AS work, size AS reason, '{"width":' || sw || ',"height":' || sh || ',"quality":0.8,"lossless":false}' AS settings FROM f
  UNION ALL SELECT p_partkey, 'webp encode', size, '{"width":' || w || ',"height":' || h || ',"quality":0.8,"lossless":false}' FROM f UNION ALL SELECT p_partkey, 'lossless still encode', size, '{"width":' || w || ',"height":' || h || ',"quality":1.0,"lossless":true}' FROM f
  UNION ALL SELECT p_partkey, unnest(['animated webp', 'frames to video']), CASE WHEN n % 3 = 0 THEN 'no frames' ELSE size END, '{"seconds":0.' || n % 3 || ',"loops":0}' FROM f
  UNION ALL SELECT p_partkey, 'video transcode', coalesce(size, CASE WHEN n % 5 = 0 THEN 'no frame rate' END), '{"width":' || fw || ',"height":' || fh || ',"bitrate":' || greatest(64000, CAST(floor((fw * fh)::DOUBLE * 25.0::DOUBLE * 0.12::DOUBLE * 0.625::DOUBLE) AS BIGINT)) || ',"rate":"25/1"}' FROM f
  UNION ALL SELECT p_partkey, 'av1 encode', coalesce(size, CASE WHEN n % 5 = 0 THEN 'no frame rate' END), '{"width":' || fw || ',"height":' || fh || ',"bitrate":' || greatest(64000, CAST(floor((fw * fh)::DOUBLE * 25.0::DOUBLE * 0.07::DOUBLE * 0.625::DOUBLE) AS BIGINT)) || ',"rate":"25/1"}' FROM f
  UNION ALL SELECT p_partkey, 'mp3 encode', CASE WHEN n % 4 = 0 THEN 'no sound' END, '{"level":4,"rate":32000,"channels":' || least(n % 4, 2) || '}' FROM f
  UNION ALL SELECT p_partkey, 'chapter write', CASE WHEN n % 3 = 1 THEN 'this container holds no chapters' WHEN n % 2 = 0 THEN 'no chapters' END, '{"chapters":1}' FROM f
  UNION ALL SELECT p_partkey, 'subtitle inject', CASE WHEN n % 3 = 1 THEN 'this container holds no text tracks' WHEN tag IS NULL THEN 'no language' END, '{"existing":"replace","tag":"' || tag || '"}' FROM f
  UNION ALL SELECT p_partkey, 'stream mux', CASE WHEN n % 3 = 1 THEN 'no muxable video codec' WHEN n % 2 = 1 THEN 'no muxable audio codec' END, CASE WHEN n % 3 = 0 THEN '{"video":"h264","audio":"aac"}' ELSE '{"audio":"aac"}' END FROM f
  UNION ALL SELECT p_partkey, 'text recognition', coalesce(size, CASE WHEN s % 3 <> 2 THEN 'this language is not read' END), '{"languages":["en-US"]}' FROM f
  UNION ALL SELECT p_partkey, 'flash render', size, '{"width":1024,"height":512}' FROM f
  UNION ALL SELECT p_partkey, 'thumbnail', size, '{"width":' || tw || ',"height":' || th || ',"at":' || round(s * 0.1::DOUBLE, 6) || '}' FROM f
  UNION ALL SELECT p_partkey, unnest(['media download', 'gallery download']), CASE WHEN n % 2 = 1 THEN 'this source is not read' END, '{"url":"https://h/a"}' FROM f)
SELECT p_partkey, work, CASE WHEN reason IS NULL THEN 'planned' ELSE 'skipped' END AS status, CASE WHEN reason IS NULL THEN settings END AS settings, reason FROM r""",
    "library_rows": """
WITH l AS (SELECT l_orderkey, (l_linenumber, l_partkey, l_extendedprice) AS pos, l_partkey AS p, l_suppkey AS s FROM lineitem),
c AS (SELECT l_orderkey, CASE WHEN count(DISTINCT p % 2) = 1 THEN CAST(arg_min(p % 2 + 1, pos) AS INTEGER) END AS width, CASE WHEN count(DISTINCT p % 2) > 1 THEN 'frames differ in size' END AS reason, sum(DISTINCT s)::BIGINT AS bytes,
  coalesce(string_agg(p || '.xml', ',' ORDER BY p || '.xml') FILTER (p % 3 = 0), '') AS dropped, count(*) FILTER (p % 4 IN (0, 2)) AS finished, count(*) FILTER (p % 4 IN (1, 3)) AS pending FROM l GROUP BY l_orderkey),
k AS (SELECT l_orderkey, clause, min((pos, i)) AS place FROM (SELECT l_orderkey, pos, unnest(['>=' || p % 3, '<9']) AS clause, unnest([0, 1]) AS i FROM l) GROUP BY ALL), j AS (SELECT l_orderkey, string_agg(clause, ',' ORDER BY place) AS clauses FROM k GROUP BY 1)
SELECT * FROM c JOIN j USING (l_orderkey)""",
    "removal": "WITH p AS (SELECT DISTINCT replace(p_type, ' ', '/') AS path FROM part) SELECT path, -length(path) AS first FROM p",
    "assembled_pages": """
WITH h AS (SELECT conv_id AS source, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text)) - 1 AS i FROM conversations), w AS (SELECT source // 2 AS doc, source, CASE WHEN i = 1 THEN 99 ELSE i END AS "index", 'p' || i || '.jpg-' || source AS name FROM h)
SELECT doc, source, "index", row_number() OVER (PARTITION BY doc ORDER BY name) - 1 AS pos, 'p' || lpad(regexp_extract(name, '^p([0-9]+)', 1), 12, '0') || '.jpg-' || lpad(source::VARCHAR, 12, '0') AS frame_key, "index" <> 99 AS found FROM w""",
    "tag_codes": """
SELECT p_partkey % 96 AS code, count(*) AS n, CASE WHEN p_partkey % 96 IN (6, 8, 14, 15, 18, 19, 20, 21, 35, 36, 45, 60, 61, 87, 89, 90) THEN 'media' WHEN p_partkey % 96 IN (12, 59, 72, 82) THEN 'script'
  WHEN p_partkey % 96 IN (0, 1, 9, 24, 43, 56, 57, 58, 64, 65, 66, 69, 71, 76, 77, 78, 86) THEN 'structural' WHEN p_partkey % 96 IN (3, 16, 25, 27, 29, 30, 31, 38, 40, 41, 42, 44, 47, 49, 50, 51, 52, 53, 54, 55, 63, 67, 68, 79, 80, 81, 85, 92, 93, 94, 95) THEN 'unrecognised' ELSE 'vector' END AS kind FROM part GROUP BY 1, 3""",
    "network_errors": """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'restricted' WHEN event_id % 7 = 6 THEN 'live' WHEN event_id % 7 < 4 THEN 'network' WHEN event_id % 5 = 0 THEN 'network' ELSE 'other' END AS class FROM events""",
    "picture_kernels": """
WITH c AS (SELECT c_custkey, unhex(lpad(hex(c_nationkey), 2, '0') || '1020FF') AS o, unhex('F0F0F0FF') AS w, c_custkey % 2 = 0 AS flat FROM customer), q AS (SELECT *, CASE WHEN flat THEN o ELSE w END AS z FROM c)
SELECT c_custkey, flat, CASE WHEN flat THEN 0.0 ELSE 0.25 END::DOUBLE AS detail, sha256(o || o || z || z || o || o || z || z || z || z || z || z || z || z || z || z) AS composed FROM q""",
    "worst_scores": "SELECT l_orderkey, min(1 - l_tax) AS overall, min(1 - l_discount) AS worst FROM lineitem GROUP BY 1",
    "language_matches": "SELECT event_id, ['en-US,de-DE', 'pt-BR,de-DE', 'zh-Hans,de-DE', 'de-DE'][event_id % 4 + 1] AS languages FROM events",
}
