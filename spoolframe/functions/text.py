"""Names, dates, tags, subtitles' times and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let, prefix_sums

# Words that end a title in a release name.
RELEASE_TAGS = [
    "1080p", "1080i", "720p", "480p", "2160p", "4k", "uhd", "hd", "sd",
    "bluray", "blu-ray", "brrip", "bdrip", "dvdrip", "dvdscr", "webrip",
    "web-dl", "webdl", "hdtv", "hdrip", "camrip", "cam", "ts", "tc", "r5",
    "x264", "x265", "h264", "h265", "hevc", "avc", "xvid", "divx", "av1",
    "aac", "ac3", "dts", "dd5", "ddp5", "truehd", "atmos", "flac", "mp3",
    "hdr", "hdr10", "dolby", "dv", "sdr", "10bit", "8bit", "remux", "proper",
    "repack", "internal", "limited", "multi", "dual", "subbed", "dubbed",
]

# Season and episode spellings, in order of trust.
EPISODE_PATTERNS = [
    r"[Ss]([0-9]{1,2})[ ._-]?[Ee]([0-9]{1,3})",
    r"(?<![0-9])([0-9]{1,2})[xX]([0-9]{1,3})(?![0-9])",
    r"[Ss]eason[ ._-]?([0-9]{1,2})[ ._-]+[Ee]pisode[ ._-]?([0-9]{1,3})",
]
YEAR_PATTERN = r"(?<![0-9])(?:19[0-9]{2}|20[0-9]{2})(?![0-9])"

# Bibliographic language codes and the terminology codes that replace them.
TERMINOLOGY = {
    "alb": "sqi", "arm": "hye", "baq": "eus", "bur": "mya", "chi": "zho",
    "cze": "ces", "dut": "nld", "fre": "fra", "geo": "kat", "ger": "deu",
    "gre": "ell", "ice": "isl", "mac": "mkd", "mao": "mri", "may": "msa",
    "per": "fas", "rum": "ron", "slo": "slk", "tib": "bod", "wel": "cym",
}

# Date shapes after the two ISO ones, in order.
DATE_SHAPES = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy"]


def _first(name: Column, pattern: str) -> Column:
    """1-based place of a pattern's first match, or null."""
    return F.nullif(F.regexp_instr(name, F.lit(pattern)), F.lit(0))


def spaced(name: Column) -> Column:
    """Underscores as spaces, dots too if there is no space then; one pass over double spaces."""
    plain = F.replace(name, F.lit("_"), F.lit(" "))
    dotted = F.when(plain.contains(" "), plain).otherwise(F.replace(plain, F.lit("."), F.lit(" ")))
    return F.replace(dotted, F.lit("  "), F.lit(" "))


def episode(name: Column) -> Column:
    """struct(season, episode, place) of the first spelling that occurs, nulls if none does."""
    found = F.lit(None).cast("struct<season:int,episode:int,place:int>")
    for pattern in reversed(EPISODE_PATTERNS):
        place = _first(name, pattern)
        hit = F.struct(F.regexp_extract(name, pattern, 1).try_cast("int").alias("season"), F.regexp_extract(name, pattern, 2).try_cast("int").alias("episode"), place.alias("place"))
        found = F.when(place.isNotNull(), hit).otherwise(found)
    return found


def year(name: Column, before: Column) -> Column:
    """struct(year, place) of the first year that does not open the name and stands before a place (null: anywhere)."""
    opens = F.regexp_instr(name, F.lit(YEAR_PATTERN)) == 1
    rest = F.when(opens, F.substring(name, 5, 1 << 20)).otherwise(name)
    shift = F.when(opens, F.lit(4)).otherwise(F.lit(0))
    place = _first(rest, YEAR_PATTERN) + shift
    value = F.regexp_extract(rest, f"({YEAR_PATTERN})", 1).try_cast("int")
    return F.when(place.isNotNull() & (before.isNull() | (place < before)), F.struct(value.alias("year"), place.cast("int").alias("place")))


def release_tag(name: Column) -> Column:
    """1-based place of the first release tag among the space-separated words, or null."""
    words = F.split(name, " ", -1)
    clean = F.transform(words, lambda w: F.btrim(F.lower(w), F.lit("[](){}-")))
    tags = F.array(*map(F.lit, RELEASE_TAGS))
    at = F.array_position(F.transform(clean, lambda w: F.array_contains(tags, w)), True)
    before = F.slice(words, 1, (at - 1).cast("int"))
    return F.when(at > 0, F.aggregate(before, F.lit(1), lambda a, w: a + F.length(w) + 1))


def tidy(title: Column, dots: Column) -> Column:
    """A title without bracketed groups, hyphens, runs of spaces and stray marks at its ends."""
    inner = F.when(title.startswith("[") & title.endswith("]") & (F.length(title) > 2), F.regexp_replace(title, r"^\[+(.*?)\]+$", "$1")).otherwise(title)
    bare = F.regexp_replace(inner, r"[\[{(][^\]})]*[\]})]", " ")
    single = F.regexp_replace(F.replace(bare, F.lit("-"), F.lit(" ")), "  +", " ")
    return F.when(dots, F.btrim(single, F.lit(" .-_:([{)]}"))).otherwise(F.btrim(single, F.lit(" -_:([{)]}")))


def _title(clean: Column, dots: Column, mark: Column, when: Column, tag: Column) -> Column:
    cut = F.least(mark["place"], when["place"], tag)
    head = F.when(cut.isNotNull(), F.substring(clean, F.lit(1), cut - 1)).otherwise(clean)
    kind = F.when(mark.isNotNull(), "episode").otherwise("unknown")
    return F.struct(tidy(head, dots).alias("title"), when["year"].alias("year"), mark["season"].alias("season"), mark["episode"].alias("episode"), kind.alias("kind"))


def parse_title(name: Column) -> Column:
    """struct(title, year, season, episode, kind) of a release name; the kind is episode or unknown, never film."""
    dots = ~F.replace(name, F.lit("_"), F.lit(" ")).contains(" ")
    clean = spaced(name)
    mark = episode(clean)
    return _title(clean, dots, mark, year(clean, mark["place"]), release_tag(clean))


def with_title(rows: DataFrame, name: str, out: str = "parsed") -> DataFrame:
    """``parse_title`` in steps, so that each part of a long expression is worked out once per row."""
    dots = ~F.replace(F.col(name), F.lit("_"), F.lit(" ")).contains(" ")
    step = rows.withColumns({"clean__": spaced(F.col(name)), "dots__": dots})
    step = step.withColumns({"mark__": episode(F.col("clean__")), "tag__": release_tag(F.col("clean__"))})
    step = step.withColumn("when__", year(F.col("clean__"), F.col("mark__.place")))
    made = _title(F.col("clean__"), F.col("dots__"), F.col("mark__"), F.col("when__"), F.col("tag__"))
    return step.withColumn(out, made).drop("clean__", "dots__", "mark__", "tag__", "when__")


def file_title(path: Column) -> Column:
    """``parse_title`` of a file name without its extension."""
    return parse_title(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))


def with_file_title(rows: DataFrame, path: str, out: str = "parsed") -> DataFrame:
    """``file_title`` in steps, as ``with_title`` does it."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return with_title(rows.withColumn("base__", base), "base__", out).drop("base__")


def release_key(name: Column) -> Column:
    """Letters, marks and digits only, lower case: what release names are compared by."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{M}\p{N}]", "")


def release_match(a: Column, b: Column) -> Column:
    """Whether one key holds the other, and the shorter is 8 or more and half of the longer."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return F.contains(long, short) & (F.length(short) >= F.greatest(F.lit(8), F.length(long) / 2))


def stamp(text: Column) -> Column:
    """Seconds of a subtitle time [h:]mm:ss[,.]f{1,3}; null where it is none. Its parts come of one match."""
    pattern = r"^(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[,.](\d{1,3}))?(?:\r\n|[\n\r\u0085\u2028\u2029])?\z"

    def seconds(part: Column) -> Column:
        h, m, s, f = (F.nullif(F.element_at(part, i), F.lit("")) for i in (1, 2, 3, 4))
        whole = F.coalesce(h.cast("long"), F.lit(0)) * 3600 + m.cast("long") * 60 + s.cast("long")
        return F.when((m.cast("int") < 60) & (s.cast("int") < 60), whole + F.coalesce(F.rpad(f, 3, "0").cast("double"), F.lit(0.0)) / 1000)

    trimmed = F.trim(text)
    return F.when(trimmed.rlike(pattern), let(F.split(F.regexp_replace(trimmed, pattern, "$1\x1f$2\x1f$3\x1f$4"), "\x1f"), seconds))


def timing(line: Column) -> Column:
    """struct(start, end) of a line with -->; settings after the end are passed over."""

    def both(sides: Column) -> Column:
        right = F.regexp_extract(F.trim(F.try_element_at(sides, F.lit(2))), r"^(\S+)", 1)
        return F.struct(stamp(sides[0]).alias("start"), stamp(right).alias("end"))

    return let(let(F.split(line, "-->", 2), both), lambda t: F.when(t["start"].isNotNull() & t["end"].isNotNull(), t))


def stamped(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS and milliseconds, rounded; hours have no bound."""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def escaped(text: Column) -> Column:
    """Text for WebVTT, with entities."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def subtitle_kind(ext: Column, text: Column) -> Column:
    """The subtitle format by extension, else by content."""
    by_name = F.when(F.lower(ext) == "srt", "subrip").when(F.lower(ext).isin("vtt", "webvtt"), "webvtt").when(F.lower(ext).isin("ass", "ssa"), "substation")
    by_text = F.when(text.startswith("WEBVTT"), "webvtt").when(text.contains("[Script Info]"), "substation").when(text.contains("-->"), "subrip").otherwise("unknown")
    return F.coalesce(by_name, by_text)


def language_tag(code: Column) -> Column:
    """A tag in canonical case with its terminology code; null if it is not well formed."""
    tag = F.replace(F.trim(code), F.lit("_"), F.lit("-"))
    fine = tag.rlike(r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$")
    parts = F.split(tag, "-")
    table = F.create_map(*(F.lit(x) for pair in TERMINOLOGY.items() for x in pair))
    first = F.lower(parts[0])
    first = F.coalesce(table[first], first)
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.when(F.length(p) == 2, F.upper(p)).when((F.length(p) == 4) & p.rlike("^[A-Za-z]+$"), F.initcap(p)).otherwise(F.lower(p)))
    return F.when(fine, F.when(first.isin("und", "zxx", "mul"), first).otherwise(F.concat_ws("-", F.array(first), rest)))


def parse_date(text: Column) -> Column:
    """A date in any known shape, as a UTC time; null if none fits."""
    clean = F.trim(text)
    return F.coalesce(*(F.try_to_timestamp(clean, F.lit(s)) for s in DATE_SHAPES))


def iso_date(when: Column) -> Column:
    """ISO 8601 in UTC."""
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def canonical_package(name: Column) -> Column:
    """A package name in lower case with runs of - _ . as one hyphen."""
    return F.regexp_replace(F.lower(name), "[-_.]+", "-")


def wheel_parts(filename: Column) -> Column:
    """struct(name, version, build, python, abi, platform) of a wheel's file name; null if it is none."""
    parts = F.split(F.regexp_replace(filename, r"\.whl$", ""), "-")
    n = F.size(parts)
    fine = filename.endswith(".whl") & n.isin(5, 6) & F.forall(parts, lambda p: p != "")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    build = F.when(n == 6, at(3))
    return F.when(fine, F.struct(at(1).alias("name"), at(2).alias("version"), build.alias("build"), at(-3).alias("python"), at(-2).alias("abi"), at(-1).alias("platform")))


def natural_key(name: Column, digits: int = 12) -> Column:
    """A key by which img2 comes before img10: runs of digits are padded, letters lowered."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(F.regexp_replace(r, "^0+(?=\\d)", ""), digits, "0")).otherwise(r)), "")


def fingerprint(content: Column, modified_ms: Column, edge: int = 1 << 20, window: int = 256 << 10, windows: int = 4) -> Column:
    """v1: and the SHA-256 of size, time, both edges and inner windows of a file (all of a small one)."""
    data = content.cast("binary")
    size = F.octet_length(data).cast("long")
    head = F.encode(F.concat(F.lit("size="), size.cast("string"), F.lit(";mtime="), modified_ms.cast("string")), "UTF-8")
    parts = [F.substring(data, 1, edge)]
    middle = size - 2 * edge
    for i in range(1, windows + 1):
        centre = F.lit(edge) + F.floor(middle * i / (windows + 1))
        at = centre - F.least(centre, F.lit(window // 2))
        parts.append(F.substring(data, (at + 1).cast("int"), F.lit(window)))
    parts.append(F.substring(data, (size - edge + 1).cast("int"), F.lit(edge)))
    return F.concat(F.lit("v1:"), F.when(size <= 2 * edge, F.sha2(F.concat(head, data), 256)).otherwise(F.sha2(F.concat(head, *parts), 256)))


def job_id(*parts: Column) -> Column:
    """SHA-256 of parts, each after its length in UTF-8 bytes, so no two lists of parts are alike."""
    return F.sha2(F.concat(*(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts)), 256)


def canonical_json(columns: list[str]) -> Column:
    """A JSON object with sorted keys."""
    return F.to_json(F.struct(*sorted(columns)))


def word_ranges(text: Column) -> Column:
    """(start, stop) of every run without white space."""
    words = F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))
    gaps = F.split(text, r"\S+", -1)
    stops = prefix_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(words)), words, lambda g, w: F.length(g) + F.length(w)))
    return F.zip_with(stops, words, lambda stop, w: F.struct((stop - F.length(w)).alias("start"), stop.alias("stop")))
