"""Choosing renditions of a media listing: admission, ranks, pairing and reasons."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lenient as L
from ..functions import media as M

#: Fields of a rendition in extractor JSON and how each is read.
RENDITION = {
    "format_id": L.lenient_string, "ext": L.lenient_string, "protocol": L.lenient_string, "url": L.lenient_string,
    "width": L.lenient_long, "height": L.lenient_long, "fps": L.lenient_double, "vcodec": L.lenient_string, "acodec": L.lenient_string,
    "tbr": L.lenient_double, "vbr": L.lenient_double, "abr": L.lenient_double, "asr": L.lenient_double, "audio_channels": L.lenient_long,
    "filesize": L.lenient_long, "filesize_approx": L.lenient_long, "format_note": L.lenient_string, "language": L.lenient_string,
    "has_drm": L.lenient_boolean, "quality": L.lenient_double,
}


@dataclass(frozen=True)
class Policy:
    """What may be chosen. Intents: ``both``, ``audio``, ``video``."""

    intent: str = "both"
    max_height: int | None = None
    max_bytes: int | None = None
    muxing: bool = True
    single_request: bool = False
    containers: list[str] = field(default_factory=lambda: ["mp4", "m4a", "mov"])
    language: str | None = None


def renditions(listings: DataFrame, json_col: str = "json", key: str = "listing_id") -> DataFrame:
    """Extractor JSON to one row per rendition, with ``pos``; fields are read leniently.

    A rendition without a format id is dropped. Text that is not JSON gives no row.
    """
    parsed = listings.select(key, F.try_parse_json(json_col).alias("v")).where("v IS NOT NULL")
    # The formats as an array of variants, exploded natively.
    each = parsed.select(key, F.posexplode(F.expr("try_variant_get(v, '$.formats', 'array<variant>')")).alias("pos", "f"))
    return each.select(key, "pos", *(read(F.col("f"), f"$.{name}").alias(name) for name, read in RENDITION.items())).where("format_id IS NOT NULL")


def _kinds() -> tuple[Column, Column, Column]:
    video, audio = M.has_track(F.col("vcodec")), M.has_track(F.col("acodec"))
    return video & audio, video & ~audio, audio & ~video


def _single() -> Column:
    return F.coalesce(F.col("protocol"), F.lit("https")).isin("http", "https")


def admitted(policy: Policy) -> Column:
    """Whether a rendition may be taken; an unknown height or size passes."""
    fine = ~F.coalesce(F.col("has_drm"), F.lit(False)) & F.col("url").isNotNull()
    if policy.single_request:
        fine = fine & _single()
    if policy.max_height is not None:
        fine = fine & F.coalesce(F.col("height") <= policy.max_height, F.lit(True))
    if policy.max_bytes is not None:
        fine = fine & F.coalesce(F.col("filesize") <= policy.max_bytes, F.lit(True))
    return fine


def _container(policy: Policy) -> Column:
    score = F.lit(0)
    for rank, ext in enumerate(reversed(policy.containers), 1):
        score = F.when(F.col("ext") == ext, F.lit(rank)).otherwise(score)
    return score


def _video_rank(policy: Policy) -> Column:
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return F.struct(zero(F.col("height")).alias("r1"), zero(F.col("width") * F.col("height")).alias("r2"), zero(F.col("fps")).alias("r3"), _container(policy).alias("r4"), F.coalesce("vbr", "tbr", F.lit(0.0)).alias("r5"), _single().cast("int").alias("r6"), (-F.col("pos")).alias("r7"))


def _audio_rank(policy: Policy) -> Column:
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    spoken = F.lit(0) if policy.language is None else F.when(F.col("language") == policy.language, 2).when(F.col("language").isNull(), 1).otherwise(0)
    return F.struct(spoken.alias("r1"), _container(policy).alias("r2"), F.coalesce("abr", "tbr", F.lit(0.0)).alias("r3"), zero(F.col("asr")).alias("r4"), zero(F.col("audio_channels")).alias("r5"), _single().cast("int").alias("r6"), (-F.col("pos")).alias("r7"))


def select_formats(rows: DataFrame, policy: Policy = Policy(), key: str = "listing_id") -> DataFrame:
    """One row per listing: ``(key, kind, video_id, audio_id, height, bytes, reason)``.

    ``kind`` is single, pair or none. All picks are maxima of (rank, -pos), so the
    first of equals wins, and come from one combinable aggregation over the
    renditions: nothing is sorted and no listing is gathered, however many
    renditions it has. ``bytes`` is null if any chosen part's size is unknown.
    A listing all of whose renditions are refused has a reason.
    """
    pre, video_only, audio_only = _kinds()
    base = rows.select("*", admitted(policy).alias("ok__"), pre.alias("pre__"), video_only.alias("vo__"), audio_only.alias("ao__"))
    chosen = F.struct(F.col("format_id"), F.col("height"), F.coalesce("filesize", "filesize_approx").alias("bytes"))
    v, a = F.struct(_video_rank(policy).alias("rank"), chosen.alias("it")), F.struct(_audio_rank(policy).alias("rank"), chosen.alias("it"))
    mux_v, mux_a = M.muxable(F.col("vcodec"), M.MUXABLE_VIDEO), M.muxable(F.col("acodec"), M.MUXABLE_AUDIO)
    best = lambda what, where: F.max(F.when(F.col("ok__") & where, what))
    sure_v, sure_a = F.col("vcodec").isNotNull() & _single(), F.col("acodec").isNotNull() & _single()
    got = base.groupBy(key).agg(
        best(v, F.col("pre__")).alias("pre"),
        best(v, F.col("vo__") & mux_v & sure_v).alias("v1"),
        best(v, F.col("vo__") & mux_v).alias("v2"),
        best(a, F.col("ao__") & mux_a & sure_a).alias("a1"),
        best(a, F.col("ao__") & mux_a).alias("a2"),
        best(a, F.col("ao__")).alias("any_a"),
        best(a, M.has_track(F.col("acodec"))).alias("has_a"),
        best(v, F.col("vo__")).alias("any_v"),
        best(v, M.has_track(F.col("vcodec"))).alias("has_v"),
        F.bool_or(M.has_track(F.col("vcodec"))).alias("listed_v"),
        F.bool_or("ok__").alias("some"),
        F.bool_and(F.coalesce("has_drm", F.lit(False))).alias("all_drm"),
        F.bool_and(~_single()).alias("no_single"),
        F.min("height").alias("least"),
    )
    nothing = F.lit(None).cast(got.schema["pre"].dataType)
    if policy.intent == "audio":
        single, video, audio, pair = F.coalesce("any_a", "has_a"), nothing, nothing, F.lit(False)
    elif policy.intent == "video":
        single, video, audio, pair = F.coalesce("any_v", "has_v"), nothing, nothing, F.lit(False)
    else:
        video, audio = F.coalesce("v1", "v2"), F.coalesce("a1", "a2")
        vetted = F.col("v1").isNotNull() & F.col("a1").isNotNull()
        both = video.isNotNull() & audio.isNotNull() if policy.muxing else F.lit(False)
        tall = F.coalesce(F.col("pre.it.height"), F.lit(0)) >= F.coalesce(video["it"]["height"], F.lit(0))
        pair = both & ~F.coalesce(F.col("pre").isNotNull() & (~vetted | tall), F.lit(False))
        single = F.when(F.col("pre").isNotNull(), F.col("pre")["it"]).otherwise(F.when(~F.col("listed_v"), F.col("any_a")["it"]))
    item = single if policy.intent == "both" else single["it"]
    refused = F.when(F.col("all_drm"), "all protected")
    if policy.single_request:
        refused = refused.when(F.col("no_single"), "no single-request rendition")
    if policy.max_height is not None:
        refused = refused.when(F.col("least") > policy.max_height, F.concat(F.lit(f"height over {policy.max_height}, least "), F.col("least").cast("string")))
    refused = refused.when(F.lit(policy.max_bytes is not None), "every size over the cap").otherwise("nothing satisfies the policy")
    missing = (
        F.when(~F.col("some"), refused)
        .when(F.lit(policy.intent == "audio"), "no audio")
        .when(F.lit(policy.intent == "video"), "no video")
        .when(F.lit(not policy.muxing), "needs muxing")
        .when(F.col("any_v").isNotNull() & F.col("v2").isNull(), "no muxable video codec")
        .when(F.col("any_a").isNotNull() & F.col("a2").isNull(), "no muxable audio codec")
        .when(F.col("any_v").isNotNull(), "no audio to pair with")
        .otherwise("no video")
    )
    out = got.select(key, pair.alias("pair"), video["it"].alias("v"), audio["it"].alias("a"), item.alias("s"), missing.alias("missing"))
    return out.select(
        key,
        F.when(F.col("pair"), "pair").when(F.col("s").isNotNull(), "single").otherwise("none").alias("kind"),
        F.when(F.col("pair"), F.col("v.format_id")).otherwise(F.col("s.format_id")).alias("video_id"),
        F.when(F.col("pair"), F.col("a.format_id")).alias("audio_id"),
        F.when(F.col("pair"), F.greatest("v.height", "a.height")).otherwise(F.col("s.height")).alias("height"),
        F.when(F.col("pair"), F.col("v.bytes") + F.col("a.bytes")).otherwise(F.col("s.bytes")).alias("bytes"),
        F.when(~F.col("pair") & F.col("s").isNull(), F.col("missing")).alias("reason"),
    )


def gallery(texts: DataFrame, key: str, json_col: str = "json") -> DataFrame:
    """Gallery JSON as ``(key, category, subcategory, pos, url, filename, size)``, a row per file; text that is not JSON gives no row."""
    parsed = texts.select(key, F.try_parse_json(json_col).alias("v")).where("v IS NOT NULL")
    each = parsed.select(key, L.lenient_string(F.col("v"), "$.category").alias("category"), L.lenient_string(F.col("v"), "$.subcategory").alias("subcategory"), F.posexplode(F.expr("try_variant_get(v, '$.files', 'array<variant>')")).alias("pos", "f"))
    return each.select(key, "category", "subcategory", "pos", L.lenient_string(F.col("f"), "$.url").alias("url"), L.lenient_string(F.col("f"), "$.filename").alias("filename"), L.lenient_long(F.col("f"), "$.size").alias("size"))
