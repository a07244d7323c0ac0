"""Rates, codecs, formats and rules of media files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codec prefixes that an MPEG-4 file holds.
MUXABLE_VIDEO = ["avc1", "avc3", "h264", "hev1", "hvc1", "hevc", "av01"]
MUXABLE_AUDIO = ["mp4a", "aac", "ac-3", "ec-3", "alac"]

# Four-character codes by their common name.
CODEC_NAMES = {
    "h264": ["avc1", "avc3", "h264"],
    "hevc": ["hvc1", "hev1", "hvc2"],
    "av1": ["av01"],
    "vp9": ["vp09", "vp08"],
    "mpeg4": ["mp4v", "mp4s"],
    "mjpeg": ["jpeg", "mjpa", "mjpb", "dmb1"],
    "prores": ["ap4h", "apch", "apcn", "apcs", "apco", "ap4x"],
    "aac": ["mp4a", "aac", "aach", "aacp", "paac"],
    "mp3": [".mp3", "mp3"],
    "pcm": ["lpcm", "sowt", "twos", "in24", "in32", "fl32", "fl64"],
    "alac": ["alac"],
    "ac3": ["ac-3", "ac3"],
    "eac3": ["ec-3"],
    "opus": ["opus"],
    "timecode": ["qtrl", "tmcd"],
    "mov_text": ["text", "tx3g"],
    "eia_608": ["c608"],
}

# Track kinds in the probe tool's words; any other is data.
TRACK_TYPES = {"video": "video", "audio": "audio", "subtitle": "subtitle", "closedCaption": "subtitle", "text": "subtitle"}

# Picture formats by file extension, and their traits.
IMAGE_EXTENSIONS = {
    "heic": ["heic", "heif"],
    "heics": ["heics", "heifs"],
    "avif": ["avif", "avifs"],
    "jpeg": ["jpg", "jpeg", "jpe"],
    "png": ["png"],
    "tiff": ["tif", "tiff"],
    "gif": ["gif"],
    "webp": ["webp"],
    "jpegXL": ["jxl"],
    "jp2": ["jp2", "j2k", "jpf", "jpx", "jpm"],
    "pdf": ["pdf"],
}
LOSSY_IMAGES = ["jpeg", "heic", "heics", "avif", "jpegXL", "jp2"]
ANIMATABLE_IMAGES = ["gif", "webp", "heics", "avif", "png"]
OPAQUE_IMAGES = ["jpeg"]
EVEN_SIDED_IMAGES = ["avif"]

# Archive members that are never pages, and sample rates that an MP3 may have.
NOT_PAGES = ["comicinfo.xml", ".ds_store", "thumbs.db", "desktop.ini"]
MP3_RATES = [8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000]

# The probe tool's container names by file extension; any other extension is its own name.
CONTAINER_NAMES = {
    "mov,mp4,m4a,3gp,3g2,mj2": ["mov", "mp4", "m4v", "m4a", "3gp", "3g2", "qt"],
    "wav": ["wav", "wave"],
    "aiff": ["aif", "aiff", "aifc"],
    "caf": ["caf"],
    "mp3": ["mp3"],
    "aac": ["aac", "adts"],
    "flac": ["flac"],
}

#: Loudness of silence in decibels.
FLOOR_DB = -91.0


def lookup(table: dict[str, str] | dict[str, list[str]], key: Column) -> Column:
    """A constant table as a map expression; lists are keyed by their members."""
    flat = {k: v for k, v in table.items() if isinstance(v, str)} or {m: k for k, members in table.items() for m in members}
    return F.create_map(*(F.lit(x) for pair in flat.items() for x in pair))[key]


def codec_name(code: Column) -> Column:
    """The common name of a four-character code; an unknown one is itself, trimmed and lowered."""
    key = F.trim(F.lower(code))
    return F.coalesce(lookup(CODEC_NAMES, key), key)


def four_characters(code: Column) -> Column:
    """A number as four ASCII characters, most significant byte first; others than 0x20-0x7E as a dot."""
    byte = lambda shift: F.shiftright(code.cast("long"), shift).bitwiseAND(F.lit(255))
    shown = lambda b: F.when((b >= 32) & (b <= 126), F.chr(b)).otherwise(F.lit("."))
    return F.concat(*(shown(byte(s)) for s in (24, 16, 8, 0)))


def muxable(codec: Column, prefixes: list[str]) -> Column:
    """Whether an MPEG-4 file holds a codec; an unknown codec passes."""
    fits = F.lit(False)
    for p in prefixes:
        fits = fits | F.lower(codec).startswith(p)
    return F.coalesce(fits, F.lit(True))


def has_track(codec: Column) -> Column:
    """A codec of ``none`` is no track; an absent codec is one that is not known."""
    return F.coalesce(codec, F.lit("")) != "none"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def container_name(name: Column) -> Column:
    """The probe tool's name of a file's container by its extension."""
    ext = extension(name)
    return F.when(ext == "", F.lit("unknown")).otherwise(F.coalesce(lookup(CONTAINER_NAMES, ext), ext))


def can_animate(fmt: Column, system: Column, built_in: list[str]) -> Column:
    """Whether animations of a format can be written: it has frame times, and the system or an own writer makes them."""
    return fmt.isin("gif", "png", "webp", "heics") & (F.array_contains(system, fmt) | fmt.isin(built_in))


def image_format(ext: Column) -> Column:
    """The picture format of a file extension, or null."""
    return lookup(IMAGE_EXTENSIONS, F.lower(F.ltrim(ext, F.lit("."))))


def is_page(name: Column, is_directory: Column) -> Column:
    """Whether an archive member is a page: a picture that is no PDF, resource fork or known extra."""
    base = F.element_at(F.split(name, "/"), -1)
    kind = image_format(extension(base))
    return ~is_directory & (name != "") & ~F.array_contains(F.split(name, "/"), "__MACOSX") & ~base.startswith("._") & ~F.lower(base).isin(NOT_PAGES) & F.coalesce(kind != "pdf", F.lit(False))


def unsafe_path(name: Column) -> Column:
    """Whether an archive path could leave its folder."""
    return name.startswith("/") | name.contains("\\") | name.contains("\x00") | name.rlike("^[A-Za-z]:") | F.array_contains(F.split(name, "/"), "..")


def last_component(path: Column) -> Column:
    """A path without its folders, for messages that must not show them."""
    return F.element_at(F.split(path, "/"), -1)


def frame_rate(rate: Column) -> Column:
    """A rate as n/1, then k*1000/1001, then thousandths."""
    ntsc = F.round(rate * 1001 / 1000)
    return (
        F.when(rate <= 0, F.lit("0/0"))
        .when(F.abs(rate - F.round(rate)) < 0.0005, F.concat(F.round(rate).cast("long").cast("string"), F.lit("/1")))
        .when(F.abs(rate - ntsc * 1000 / 1001) < 0.0005, F.concat((ntsc * 1000).cast("long").cast("string"), F.lit("/1001")))
        .otherwise(F.concat(F.round(rate * 1000).cast("long").cast("string"), F.lit("/1000")))
    )


def probe_seconds(seconds: Column) -> Column:
    """Seconds with six decimals, or N/A."""
    fine = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < float("inf"))
    return F.when(fine, F.format_string("%.6f", seconds)).otherwise(F.lit("N/A"))


def decibels(amplitude: Column) -> Column:
    """20 log10 of an amplitude; silence is the floor, not minus infinity."""
    return F.when(amplitude > 0, 20 * F.log10(amplitude)).otherwise(F.lit(FLOOR_DB))


def aac_bitrate(quality: Column, channels: Column) -> Column:
    """24 to 96 kbit/s a channel by quality, in whole thousands a channel."""
    q = F.least(F.greatest(quality, F.lit(0.0)), F.lit(1.0))
    return (F.round((24000 + q * 72000) / 1000) * 1000 * channels).cast("long")


def video_bitrate(width: Column, height: Column, fps: Column, quality: Column, h264: bool = True) -> Column:
    """Bits a second from pixels, rate and quality; at least 64,000."""
    q = F.least(F.greatest(quality, F.lit(0.0)), F.lit(1.0))
    return F.greatest(F.lit(64000).cast("long"), F.floor(width * height * fps * (0.12 if h264 else 0.07) * (0.25 + 0.75 * q)))


def mp3_level(quality: Column) -> Column:
    """The variable-rate level of a quality: 0 is best, 9 smallest."""
    return ((1 - quality) * 9).cast("int")


def mp3_rate(rate: Column) -> Column:
    """The rate itself or the next one up that an MP3 may have, else 44,100."""
    return F.coalesce(F.array_min(F.filter(F.array(*map(F.lit, MP3_RATES)), lambda r: r >= rate)), F.lit(44100))


def rate_at_or_below(rate: Column, ranges: Column) -> Column:
    """A rate inside any (low, high) range, else the highest end below it, else null; without ranges the rate itself."""
    inside = F.exists(ranges, lambda r: (rate >= r["low"]) & (rate <= r["high"]))
    below = F.array_max(F.transform(F.filter(ranges, lambda r: r["high"] < rate), lambda r: r["high"]))
    return F.when((F.size(ranges) == 0) | inside, rate).otherwise(below)


def nearest_bitrate(rate: Column, ranges: Column) -> Column:
    """A bitrate inside any range, else clamped to the ends of all; without ranges the rate itself."""
    inside = F.exists(ranges, lambda r: (rate >= r["low"]) & (rate <= r["high"]))
    low, high = F.array_min(F.transform(ranges, lambda r: r["low"])), F.array_max(F.transform(ranges, lambda r: r["high"]))
    return F.when((F.size(ranges) == 0) | inside, rate).otherwise(F.least(F.greatest(rate, low), high))


def target_rate(asked: Column, source: Column, table: Column) -> Column:
    """The best rate of a table at or below both what is asked and what the source has."""
    most = F.least(asked, source)
    return F.coalesce(F.array_max(F.filter(table, lambda r: r <= most)), F.array_min(table))


def channels(policy: str, count: Column, has_layout: Column, most: int = 2) -> Column:
    """Channels to write: ``preserve``, ``stereo``, ``mono`` or ``at_most``.

    More than two without a known layout, and a partial downmix, become stereo.
    """
    kept = F.when((count > 2) & ~has_layout, F.lit(2)).otherwise(count)
    if policy == "preserve":
        return kept
    if policy in ("mono", "stereo"):
        return F.least(count, F.lit(1 if policy == "mono" else 2))
    if policy == "at_most":
        return F.when(kept <= most, kept).otherwise(F.lit(1 if most == 1 else 2))
    raise ValueError(f"no channel policy {policy!r}")


def lossy_skip(source_lossless: Column, target_lossless: Column, source_rate: Column, target_rate: Column, rule: str = "savings", fraction: float = 0.75) -> Column:
    """Why a lossy source is left alone, or null where encoding goes on."""
    if rule == "allow":
        return F.lit(None).cast("string")
    skip = F.when(source_lossless, F.lit(None).cast("string")).when(target_lossless, F.lit("lossless copy of a lossy source"))
    if rule == "never":
        return skip.otherwise(F.lit("lossy sources are not encoded again"))
    return skip.when(source_rate.isNull(), F.lit("source bitrate unknown")).when(target_rate <= source_rate * fraction, F.lit(None).cast("string")).otherwise(F.lit("saves too little"))


def timing_factor(declared: Column, observed: Column, tolerance: float = 0.02) -> Column:
    """declared / observed where it is close to a half or to two, else 1."""
    ratio = declared / observed
    near = (F.abs(ratio - 0.5) <= tolerance) | (F.abs(ratio - 2) <= tolerance)
    return F.when((declared > 0) & (observed > 0) & near, ratio).otherwise(F.lit(1.0))


def frame_delays(delays: Column) -> Column:
    """Delays of animation frames; 11 ms or less plays as 100 ms."""
    return F.transform(delays, lambda d: F.when(d <= 0.011, F.lit(0.1)).otherwise(d))


def play_time(delays: Column) -> Column:
    """The sum of clamped delays; null where there is no animation."""
    return F.when(F.size(delays) > 1, F.aggregate(frame_delays(delays), F.lit(0.0), lambda a, d: a + d))


def looks_lossless(overall: Column, worst: Column, least_overall: float = 0.99, least_worst: float = 0.97) -> Column:
    """Whether a similarity passes as visually lossless."""
    return (overall >= least_overall) & (worst >= least_worst)


def clamp(value: Column, low: float, high: float) -> Column:
    """A value within bounds; one that is not finite is the lower."""
    wild = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(wild, F.lit(low)).otherwise(F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def lanes(total: Column, limit: Column) -> Column:
    """Tasks of a class that may run at once."""
    return F.least(total, F.coalesce(limit, total))


def http_class(status: Column) -> Column:
    """The error class of an HTTP status, or null for success."""
    return (
        F.when(status.between(200, 299), F.lit(None).cast("string"))
        .when(status.isin(401, 403), F.lit("unauthorised"))
        .when(status == 404, F.lit("not found"))
        .when(status == 429, F.lit("rate limited"))
        .when(status >= 500, F.lit("server"))
        .otherwise(F.lit("refused"))
    )


def first_supported(preferences: Column, capabilities: Column) -> Column:
    """The first preference that is among the capabilities, or null."""
    return F.try_element_at(F.filter(preferences, lambda p: F.array_contains(capabilities, p)), F.lit(1))


def sniff_store(magic: Column) -> Column:
    """The metadata store of a file by its first 16 bytes; the first rule that fits wins, null if none."""
    at = lambda start, n: F.hex(F.substring(magic, start, n))
    box = at(5, 4)
    tag = lambda s: F.lit(s.encode().hex().upper())
    sync = F.coalesce((at(1, 1) == "FF") & (F.conv(at(2, 1), 16, 10).cast("int").bitwiseAND(F.lit(0xE0)) == 0xE0), F.lit(False))
    return (
        F.when(at(1, 5) == tag("%PDF-"), "pdf")
        .when(box.isin("66747970", "6D6F6F76", "6D646174"), "itunes_atoms")
        .when((at(1, 3) == tag("ID3")) | sync, "id3")
        .when((at(1, 3) == "FFD8FF") | (at(1, 8) == "89504E470D0A1A0A"), "image_properties")
        .when(at(1, 4).isin("49492A00", "4D4D002A"), "image_properties")
    )


def sniff_document(magic: Column) -> Column:
    """pdf, rar, zip, spanned_zip or other by the first 8 bytes."""
    head = F.hex(F.substring(magic, 1, 4))
    return F.when(F.hex(F.substring(magic, 1, 5)) == "255044462D", "pdf").when(head == "52617221", "rar").when(head.isin("504B0304", "504B0506"), "zip").when(head == "504B0708", "spanned_zip").otherwise("other")


def sniff_artwork(magic: Column) -> Column:
    """jpeg or png by magic, else null."""
    return F.when(F.hex(F.substring(magic, 1, 3)) == "FFD8FF", "jpeg").when(F.hex(F.substring(magic, 1, 8)) == "89504E470D0A1A0A", "png")


def sniff_flash(magic: Column) -> Column:
    """struct(compression, version) of a Flash file, or null."""
    head = F.hex(F.substring(magic, 1, 3))
    kind = F.when(head == "465753", "none").when(head == "435753", "zlib").when(head == "5A5753", "lzma")
    return F.when(kind.isNotNull(), F.struct(kind.alias("compression"), F.conv(F.hex(F.substring(magic, 4, 1)), 16, 10).cast("int").alias("version")))
