"""Metadata items to records: precedence, classes, removals and edits, on DataFrames and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media import sniff_artwork
from ..functions.text import parse_date

# Words that put an audio or video item in a class, in the order that they are asked.
AUDIO_WORDS = [
    ("gps", ["location", "gps", "xyz"]),
    ("thumbnails", ["covr", "apic", "artwork", "picture"]),
    ("software", ["encoder", "software", "too", "tsse", "tenc"]),
    ("timestamps", ["date", "year", "day", "tdrc", "tyer"]),
    ("deviceIdentity", ["make", "model", "device"]),
]
VIDEO_WORDS = [
    ("gps", ["location", "gps"]),
    ("timestamps", ["date", "time"]),
    ("deviceIdentity", ["make", "model", "camera", "device"]),
    ("software", ["software", "encoder"]),
    ("thumbnails", ["thumbnail", "artwork"]),
]
COMMON_CLASSES = {"artwork": "thumbnails", "creationDate": "timestamps", "lastModifiedDate": "timestamps", "software": "software", "make": "software", "model": "software", "location": "gps"}
AUDIO_PREFIXES = ["itunes.", "id3.", "qt.", "common.", "com.apple.quicktime.", "com.apple."]
VIDEO_PREFIXES = ["qt.", "com.apple.quicktime.", "com.apple.", "udta.", "mdta."]
ITUNES_KEYS = {"title": "song name", "artist": "artist", "creator": "artist", "albumName": "album", "artwork": "cover art", "author": "author", "publisher": "publisher", "copyrights": "copyright", "description": "description", "type": "user genre", "creationDate": "release date"}
MEDIA_KINDS = {1: "Music", 2: "Audiobook", 6: "Music Video", 9: "Movie", 10: "TV Show", 11: "Booklet", 14: "Ringtone"}
FORCED_KEYS = ["exif.MakerApple.17", "qt.com.apple.quicktime.content.identifier"]
OLD_FRAMES = {"TT2": "TIT2", "TT3": "TIT3", "TP1": "TPE1", "TP2": "TPE2", "TAL": "TALB", "TCO": "TCON", "TCR": "TCOP", "TCM": "TCOM", "TCP": "TCMP", "TRK": "TRCK", "TPA": "TPOS", "TYE": "TYER", "TDA": "TDAT"}
FRAME_FIELDS = {"TIT2": "title", "TIT3": "summary", "TPE2": "album_artist", "TALB": "album", "TCON": "genre", "TCOP": "copyright", "TCOM": "composer"}


def _plain(key: Column, prefixes: list[str]) -> Column:
    """A key in lower case without its prefixes, each taken off once, in order."""
    pattern = "".join(f"({p})?" for p in (x.replace(".", r"\.") for x in prefixes))
    return F.regexp_replace(F.lower(key), f"^{pattern}", "")


def _by_words(name: Column, words: list[tuple[str, list[str]]]) -> Column:
    out = F.lit(None).cast("string")
    for group, parts in reversed(words):
        hit = F.lit(False)
        for p in parts:
            hit = hit | name.contains(p)
        out = F.when(hit, F.lit(group)).otherwise(out)
    return out


def audio_class(common: Column, key: Column) -> Column:
    """The class of an audio item: by its common key, else by words of its key; null if none."""
    table = F.create_map(*(F.lit(x) for pair in COMMON_CLASSES.items() for x in pair))
    return F.coalesce(table[common], _by_words(_plain(key, AUDIO_PREFIXES), AUDIO_WORDS))


def video_class(key: Column) -> Column:
    """The class of a video item by words of its key; null if none."""
    return _by_words(_plain(key, VIDEO_PREFIXES), VIDEO_WORDS)


def filter_items(items: DataFrame, group: Column, strip: list[str] | None = None, allow: list[str] | None = None, forced: list[str] | None = None, key: str = "key") -> DataFrame:
    """Items left by a policy: classes to strip keep what has none; an allow-list drops what has no key; forced keys stay."""
    kept = F.lit(True)
    if strip is not None:
        kept = ~F.coalesce(group.isin(strip), F.lit(False))
    if allow is not None:
        kept = F.coalesce(F.col(key).isin(allow), F.lit(False))
    return items.where(kept | F.coalesce(F.col(key).isin(forced if forced is not None else FORCED_KEYS), F.lit(False)))


def audio_items_for(items: DataFrame, itunes: bool) -> DataFrame:
    """Items as a destination keeps them: its own key space as is, others by their common key, the rest not."""
    table = F.create_map(*(F.lit(x) for pair in ITUNES_KEYS.items() for x in pair))
    own = F.col("key_space").isin("itunes", "quicktime metadata", "quicktime user data") & F.lit(itunes)
    to = F.when(own, F.col("key")).when(F.lit(itunes), table[F.col("common")])
    return items.withColumn("to_key", to).where("to_key IS NOT NULL")


def merge_items(items: DataFrame, file: str = "file", lists: tuple[str, ...] = ("creator", "artwork")) -> DataFrame:
    """``(file, key, value, values)`` of items ``(file, pos, iso, key, value)``.

    Of normal items the last counts; those of the ISO store only fill gaps, the
    first of them. Keys of ``lists`` keep all values in order.
    """
    listed = F.col("key").isin(*lists)
    last = F.max_by("value", F.when(~F.col("iso"), F.col("pos")))
    first = F.min_by("value", F.when(F.col("iso"), F.col("pos")))
    values = F.array_sort(F.collect_list(F.when(listed & ~F.col("iso"), F.struct("pos", "value"))))
    got = items.groupBy(file, "key").agg(last.alias("normal"), first.alias("fill"), values.alias("all"))
    return got.select(file, "key", F.coalesce("normal", "fill").alias("value"), F.transform("all", lambda x: x["value"]).alias("values"))


def still_record(properties: Column) -> Column:
    """struct(title, summary, artist, copyright, latitude, longitude, altitude) of a picture's property map.

    IPTC comes before TIFF for title and summary, TIFF before IPTC for artist and
    copyright; S, W and altitude reference 1 make numbers negative.
    """
    at = lambda k: F.nullif(properties[k], F.lit(""))
    signed = lambda k, ref, minus: F.when(at(ref) == minus, -at(k).try_cast("double")).otherwise(at(k).try_cast("double"))
    return F.struct(
        F.coalesce(at("iptc.ObjectName"), at("tiff.DocumentName")).alias("title"), F.coalesce(at("iptc.Caption/Abstract"), at("tiff.ImageDescription")).alias("summary"),
        F.coalesce(at("tiff.Artist"), at("iptc.Byline")).alias("artist"), F.coalesce(at("tiff.Copyright"), at("iptc.CopyrightNotice")).alias("copyright"),
        signed("gps.Latitude", "gps.LatitudeRef", "S").alias("latitude"), signed("gps.Longitude", "gps.LongitudeRef", "W").alias("longitude"), signed("gps.Altitude", "gps.AltitudeRef", "1").alias("altitude"),
    )


def id3_record(frames: DataFrame, file: str = "file") -> DataFrame:
    """One row per file of frames ``(file, pos, frame, text)``; old frame names count as the new ones."""
    table = F.create_map(*(F.lit(x) for pair in OLD_FRAMES.items() for x in pair))
    name = F.coalesce(table[F.col("frame")], F.col("frame"))
    text = F.nullif(F.split_part("text", F.lit("\x00"), F.lit(1)), F.lit(""))
    rows = frames.select(file, "pos", name.alias("f"), text.alias("t"), "text")
    last = lambda f: F.max_by("t", F.when((F.col("f") == f) & F.col("t").isNotNull(), F.col("pos")))
    part = lambda f, i: F.split_part(last(f), F.lit("/"), F.lit(i)).try_cast("int")
    date = F.min_by(parse_date(F.col("t")), F.when(F.col("f").isin("TDRC", "TYER", "TDAT") & parse_date(F.col("t")).isNotNull(), F.col("pos")))
    creators = F.split(F.max_by("text", F.when((F.col("f") == "TPE1") & F.col("t").isNotNull(), F.col("pos"))), "\x00")
    fields = [last(f).alias(k) for f, k in FRAME_FIELDS.items()]
    return rows.groupBy(file).agg(*fields, creators.alias("creators"), part("TRCK", 1).alias("track"), part("TRCK", 2).alias("tracks"), part("TPOS", 1).alias("disc"), part("TPOS", 2).alias("discs"), (last("TCMP") != "0").alias("compilation"), date.alias("date"))


#: Text frames that ``id3_record`` has fields for.
KNOWN_FRAMES = [*FRAME_FIELDS, "TPE1", "TRCK", "TPOS", "TCMP", "TDRC", "TYER", "TDAT"]


def id3_extras(frames: DataFrame, file: str = "file", long_key: str | None = None, id_prefix: str | None = None) -> DataFrame:
    """What ``id3_record`` has no field for, one row per file of frames ``(file, pos, frame, description, text, picture, role)``.

    ``comment``: the last without a description, else the first; ``long_description``:
    the user field named ``long_key``; ``identifiers``: user fields whose name
    starts with ``id_prefix``; ``custom``: the other user fields as ``TXXX:name``
    and text frames without a field; ``artwork``: roles and bytes of JPEG and PNG
    pictures in order. Of repeated names the last counts.
    """
    table = F.create_map(*(F.lit(x) for pair in OLD_FRAMES.items() for x in pair))
    name = F.coalesce(table[F.col("frame")], F.col("frame"))
    d = F.coalesce("description", F.lit(""))
    user, comment = name.isin("TXXX", "TXX"), name.isin("COMM", "COM")
    long = user & (d == long_key) if long_key else F.lit(False)
    known_id = user & d.startswith(id_prefix) if id_prefix else F.lit(False)
    own = F.when(long | known_id, F.lit(None).cast("string")).when(user, F.concat(F.lit("TXXX:"), d)).when(name.startswith("T") & ~name.isin(KNOWN_FRAMES) & (F.coalesce("text", F.lit("")) != ""), name)
    art = F.when(name.isin("APIC", "PIC") & sniff_artwork(F.col("picture")).isNotNull(), F.struct("pos", "role", F.octet_length("picture").alias("bytes"), "picture"))
    pair = lambda key: F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.when(key.isNotNull(), F.struct(key.alias("k"), F.col("pos").alias("p"), F.col("text").alias("t"))))), lambda x: F.struct(x["k"], x["t"])))
    rows = frames.select(file, "pos", "text", name.alias("name"), d.alias("description"), own.alias("own"), comment.alias("is_comment"), long.alias("is_long"), F.when(known_id, F.substring(d, len(id_prefix or "") + 1, 1 << 30)).alias("id"), art.alias("art"))
    # Of repeated names the last: names are first brought to one row each.
    last = lambda c: rows.where(F.col(c).isNotNull()).groupBy(file, c).agg(F.max("pos").alias("pos"), F.max_by("text", "pos").alias("text")).groupBy(file).agg(pair(F.col(c)).alias("m"))
    base = rows.groupBy(file).agg(
        F.coalesce(F.max_by("text", F.when(F.col("is_comment") & (F.col("description") == ""), F.col("pos"))), F.min_by("text", F.when(F.col("is_comment"), F.col("pos")))).alias("comment"),
        F.max_by("text", F.when(F.col("is_long"), F.col("pos"))).alias("long_description"), F.transform(F.array_sort(F.collect_list(F.struct(F.col("art.pos").alias("pos"), F.col("art").alias("art")))), lambda x: x["art"]).alias("arts"),
    )
    out = base.join(last("own").withColumnRenamed("m", "custom"), file, "left").join(last("id").withColumnRenamed("m", "identifiers"), file, "left")
    pictures = F.transform(F.filter("arts", lambda a: a.isNotNull()), lambda a: F.struct(a["role"].alias("role"), a["bytes"].alias("bytes"), a["picture"].alias("picture")))
    return out.select(file, "comment", "long_description", "custom", "identifiers", pictures.alias("artwork"))


def media_kind(code: Column) -> Column:
    """The name of a media kind's number, or null."""
    return F.create_map(*(F.lit(x) for pair in MEDIA_KINDS.items() for x in pair))[code]


def edit(records: DataFrame, column: str, changes: dict[str, Column]) -> DataFrame:
    """A record column with some fields set anew; null removes a value."""
    out = F.col(column)
    for name, value in changes.items():
        out = out.withField(name, value)
    return records.withColumn(column, out)


def track_changes(existing: DataFrame, added: DataFrame, rule: str, key: str = "file") -> DataFrame:
    """Subtitle tracks after adding some: ``keep`` those there, ``replace`` those of the same language, or ``remove`` all."""
    if rule == "keep":
        kept = existing
    elif rule == "replace":
        kept = existing.join(added.select(key, "language").distinct(), [key, "language"], "left_anti").select(*existing.columns)
    elif rule == "remove":
        kept = existing.join(added.select(key).distinct(), key, "left_anti").select(*existing.columns)
    else:
        raise ValueError(f"no rule {rule!r}")
    return kept.unionByName(added)
