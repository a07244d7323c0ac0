"""Matching, ranking and comparing rows of lookups, subtitles, packages and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Keys that removing a class of metadata takes away; "*" ends stand for any rest.
CLASS_KEYS = {
    "gps": ["gps.*", "iptc.City", "iptc.SubLocation", "iptc.Province/State", "iptc.Country/PrimaryLocationName", "iptc.Country/PrimaryLocationCode"],
    "makerNotes": ["makerNote.*", "exif.MakerNote"],
    "faces": ["makerNote.*", "exif.MakerNote"],
    "serials": ["exif.BodySerialNumber", "exif.LensSerialNumber"],
    "software": ["tiff.Software", "exif.Software"],
    "dates": ["exif.DateTimeOriginal", "exif.DateTimeDigitized", "tiff.DateTime"],
    "thumbnails": [],
}


def release_matches(wanted: DataFrame, offered: DataFrame, a: str, b: str, grams: int = 8) -> DataFrame:
    """Pairs whose release keys hold one another (see ``release_match``).

    A name that is held by another has each of its pieces of 8 characters in it.
    So names meet on the one piece of the shorter that fewest names of the other
    side have: pieces are counted by a combinable aggregation, each name chooses
    its rarest, and the join is an equi-join on that. A piece that all names
    share, such as a common word, brings nothing together. Rows that pieces and
    pairs multiply are many more than Spark estimates from the tables, so no join
    may broadcast them: all are merge joins, whatever the size.
    """
    key = {"a": wanted.withColumn("ka", T.release_key(F.col(a))).where(F.length("ka") >= grams), "b": offered.withColumn("kb", T.release_key(F.col(b))).where(F.length("kb") >= grams)}
    pieces = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (grams - 1)), lambda i: F.substring(c, i, F.lit(grams)))))

    def held(short: str, long: str) -> DataFrame:
        names = {side: key[side].select(F.col(f"k{side}").alias("name")).distinct().select("name", pieces(F.col("name")).alias("piece")) for side in (short, long)}
        counts = names[long].groupBy("piece").agg(F.count("*").alias("n"))
        met = names[short].join(counts.hint("merge"), "piece", "left")
        rarest = met.groupBy("name").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"), F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0").drop("n")
        found = rarest.join(names[long].withColumnRenamed("name", "other").hint("merge"), "piece").where(F.contains("other", "name") & (F.length("name") >= F.length("other") / 2))
        pairs = found.select(F.col("name").alias(f"k{short}"), F.col("other").alias(f"k{long}"))
        return pairs

    same = held("a", "b").unionByName(held("b", "a")).distinct()
    return key["a"].join(same.hint("merge"), "ka").join(key["b"].hint("merge"), "kb").where(T.release_match(F.col("ka"), F.col("kb"))).drop("ka", "kb")


def best_per(rows: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in an order that should end in a unique column."""
    return rows.withColumn("rank__", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank__") <= n).drop("rank__")


def subtitle_order(machine: Column, matches: Column, downloads: Column, pos: Column) -> list[Column]:
    """Made by people first, then matching the release, then more downloads, then as they came."""
    return [machine.asc(), matches.desc(), downloads.desc(), pos.asc()]


def interleave(a: DataFrame, b: DataFrame, key: list[str], pos: str) -> DataFrame:
    """Two ranked lists as a1 b1 a2 b2, what is over at the end; ``turn`` orders them."""
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    return both.withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy(pos, "side")) - 1)


def first_difference(rows: DataFrame, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """The first field, in order, whose two values differ; empty text equals null, and times count whole seconds."""
    found = F.lit(None).cast("string")
    for name, (a, b) in reversed(fields.items()):
        found = F.when(~a.eqNullSafe(b), F.lit(name)).otherwise(found)
    return rows.withColumn("difference", found)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _hits(key: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | (key.startswith(p[:-1]) if p.endswith("*") else key == p)
    return out


def apply_policy(metadata: Column, kind: str, names: list[str] | None = None, forced: list[str] | None = None, structural: list[str] | None = None) -> Column:
    """A map of ``space.key`` to value under a policy.

    ``keep`` all, ``strip`` all, ``classes`` without the named classes, or
    ``allow`` the named keys only. Structural keys always go; keys that are
    forced come back.
    """
    names = names or []
    if kind == "keep":
        kept = metadata
    elif kind == "strip":
        kept = F.map_filter(metadata, lambda k, v: F.lit(False))
    elif kind == "classes":
        gone = [p for c in names for p in CLASS_KEYS[c]]
        kept = F.map_filter(metadata, lambda k, v: ~_hits(k, gone))
    elif kind == "allow":
        kept = F.map_filter(metadata, lambda k, v: _hits(k, names))
    else:
        raise ValueError(f"no policy {kind!r}")
    kept = F.map_filter(kept, lambda k, v: ~_hits(k, structural or []))
    back = F.map_filter(metadata, lambda k, v: _hits(k, forced or []) & ~F.map_contains_key(kept, k))
    return F.map_concat(kept, back)


def resolve_languages(wanted: Column, offered: Column) -> Column:
    """Each wanted tag as an offered one: the same but for case, else the first with its primary subtag; others go."""
    exact = lambda w: F.try_element_at(F.filter(offered, lambda o: F.lower(o) == F.lower(w)), F.lit(1))
    loose = lambda w: F.try_element_at(F.filter(offered, lambda o: F.lower(F.split_part(o, F.lit("-"), F.lit(1))) == F.lower(F.split_part(w, F.lit("-"), F.lit(1)))), F.lit(1))
    return F.filter(F.transform(wanted, lambda w: F.coalesce(exact(w), loose(w))), lambda x: x.isNotNull())


def new_urls(lines: DataFrame, queued: DataFrame, text: str = "text", url: str = "url") -> DataFrame:
    """Words of lines that are URLs with a scheme, once each and not queued yet."""
    words = lines.select(F.explode(F.split(F.trim(text), r"\s+")).alias(url)).where(F.col(url).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\s]+"))
    return words.distinct().join(queued.select(url), url, "left_anti")
