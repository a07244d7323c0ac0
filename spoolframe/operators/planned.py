"""Codec work as plan rows: what would be made and how, or why nothing is. Nothing is encoded here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import media as M
from ..functions.text import language_tag
from ..sources.files import allowed_source
from .library import chapters_supported
from .matching import resolve_languages

# Containers by extension that hold chapters and text tracks, and where a sequence of frames has its times.
TEXT_CONTAINERS = ["mp4", "m4v", "mov"]
TIMED_PICTURES = ["gif", "png", "webp", "heics"]


def still_plan(images: DataFrame, target: str, side: int, probed: list[str]) -> DataFrame:
    """Pictures ``(format, width, height)`` with what an encode to ``target`` would be: size, backend and reason."""
    size = G.resize("longest_side", F.col("width"), F.col("height"), F.lit(side))
    even = target in M.EVEN_SIDED_IMAGES
    side_of = lambda k: G.even_floor(size[k]) if even else size[k]
    backend = "system" if target in probed else "built in" if target == "webp" else None
    reason = F.when(F.lit(backend is None), "no encoder for this format").when((F.col("width") <= 0) | (F.col("height") <= 0), "picture without size")
    return images.withColumns({"to": F.lit(target), "to_width": side_of("width"), "to_height": side_of("height"), "backend": F.lit(backend).cast("string"), "reason": reason})


def audio_plan(tracks: DataFrame, quality: float, lossless_target: bool = False, rule: str = "savings") -> DataFrame:
    """Tracks ``(lossless, bitrate, rate, channels, has_layout)`` with the decision of a transcode, without doing it."""
    channels = M.channels("at_most", F.col("channels"), F.col("has_layout"), most=2)
    target = F.when(F.lit(lossless_target), F.lit(None).cast("long")).otherwise(M.aac_bitrate(F.lit(quality), channels))
    skip = M.lossy_skip(F.col("lossless"), F.lit(lossless_target), F.col("bitrate"), target, rule)
    return tracks.withColumns({"to_codec": F.lit("alac" if lossless_target else "aac"), "to_bitrate": target, "to_rate": F.least(F.col("rate"), F.lit(48000)), "to_channels": channels, "skip": skip, "loses_again": ~F.col("lossless") & F.lit(not lossless_target) & skip.isNull()})


def _pictured() -> Column:
    return F.when((F.col("width") > 0) & (F.col("height") > 0), F.lit(None).cast("string")).otherwise("no picture size")


def _scaled(side: int, even: bool = False) -> dict[str, Column]:
    size = G.resize("longest_side", F.col("width"), F.col("height"), F.lit(side))
    return {k: G.even_floor(size[k]) if even else size[k] for k in ("width", "height")}


def _film(h264: bool) -> Callable[..., tuple[dict[str, Column], Column]]:
    def rule(quality: float = 0.5, side: int = 1920) -> tuple[dict[str, Column], Column]:
        size = _scaled(side, True)
        rate = M.video_bitrate(size["width"], size["height"], F.col("fps"), F.lit(quality), h264)
        return {**size, "bitrate": rate.cast("long"), "rate": M.frame_rate(F.col("fps"))}, F.coalesce(_pictured(), F.when(~F.coalesce(F.col("fps") > 0, F.lit(False)), "no frame rate"))

    return rule


def _picture(lossless: bool) -> Callable[..., tuple[dict[str, Column], Column]]:
    def rule(quality: float = 0.8, side: int = 1 << 30) -> tuple[dict[str, Column], Column]:
        return {**_scaled(side), "quality": F.lit(1.0 if lossless else quality), "lossless": F.lit(lossless)}, _pictured()

    return rule


def _mp3(quality: float = 0.5) -> tuple[dict[str, Column], Column]:
    return {"level": M.mp3_level(F.lit(quality)), "rate": M.mp3_rate(F.col("rate")), "channels": F.least(F.col("channels"), F.lit(2))}, F.when(F.coalesce(F.col("channels"), F.lit(0)) <= 0, "no sound")


def _sequence(kind: str) -> Callable[..., tuple[dict[str, Column], Column]]:
    def rule(seconds: float = 0.1, loops: int = 0) -> tuple[dict[str, Column], Column]:
        few = F.when(F.coalesce(F.col("frames"), F.lit(0)) <= 0, "no frames")
        untimed = F.when(F.lit(kind not in TIMED_PICTURES and kind != "film"), "frames of this format have no times")
        return {"seconds": F.round(F.col("frames") * seconds, 6), "loops": F.lit(loops)}, F.coalesce(few, _pictured(), untimed)

    return rule


def _chapters() -> tuple[dict[str, Column], Column]:
    return {"chapters": F.col("chapters")}, F.coalesce(chapters_supported(F.col("ext")), F.when(F.coalesce(F.col("chapters"), F.lit(0)) <= 0, "no chapters"))


def _subtitles(rule: str = "replace") -> tuple[dict[str, Column], Column]:
    return {"existing": F.lit(rule), "tag": language_tag(F.col("language"))}, F.when(~F.lower("ext").isin(TEXT_CONTAINERS), "this container holds no text tracks").when(language_tag(F.col("language")).isNull(), "no language")


def _mux() -> tuple[dict[str, Column], Column]:
    return {"video": M.codec_name(F.col("vcodec")), "audio": M.codec_name(F.col("acodec"))}, F.when(~M.muxable(F.col("vcodec"), M.MUXABLE_VIDEO), "no muxable video codec").when(~M.muxable(F.col("acodec"), M.MUXABLE_AUDIO), "no muxable audio codec")


def _download() -> tuple[dict[str, Column], Column]:
    return {"url": F.col("url")}, F.when(~F.coalesce(allowed_source(F.col("url")), F.lit(False)), "this source is not read")


def _recognition(offered: tuple[str, ...] = ()) -> tuple[dict[str, Column], Column]:
    found = resolve_languages(F.array(F.col("language")), F.array(*map(F.lit, offered)) if offered else F.array().cast("array<string>"))
    return {"languages": found}, F.coalesce(_pictured(), F.when(F.size(found) == 0, "this language is not read"))


def _render(side: int = 1024) -> tuple[dict[str, Column], Column]:
    size = G.render_size(F.col("width"), F.col("height"), F.lit(side))
    return {"width": size["width"], "height": size["height"]}, _pictured()


def _thumbnail(side: int = 320, at: float = 0.1) -> tuple[dict[str, Column], Column]:
    return {**_scaled(side), "at": F.round(F.coalesce(F.col("seconds"), F.lit(0.0)) * at, 6)}, _pictured()


#: Work that needs a codec or a system service, with the rule of its settings and of why it is not done.
NATIVE: dict[str, Callable[..., tuple[dict[str, Column], Column]]] = {
    "still encode": _picture(False), "lossless still encode": _picture(True), "webp encode": _picture(False), "animated webp": _sequence("webp"), "frames to video": _sequence("film"), "video transcode": _film(True), "av1 encode": _film(False),
    "mp3 encode": _mp3, "chapter write": _chapters, "subtitle inject": _subtitles, "stream mux": _mux, "text recognition": _recognition, "flash render": _render, "thumbnail": _thumbnail, "media download": _download, "gallery download": _download,
}


def native_plan(items: DataFrame, work: str, **settings) -> DataFrame:
    """Items with one kind of native work planned on each: ``work``, ``status``, ``settings`` as JSON, and ``reason``.

    Every kind has its rule (see ``NATIVE``), which reads the columns that it
    needs, such as ``width`` and ``height``, and says what would be made, or why
    an item is skipped. Keywords set what the rule leaves open. Kinds that are not
    known are refused.
    """
    if work not in NATIVE:
        raise ValueError(f"no such work {work!r}")
    made, reason = NATIVE[work](**settings)
    json = F.to_json(F.struct(*(c.alias(k) for k, c in made.items())))
    return items.withColumns({"work": F.lit(work), "status": F.when(reason.isNull(), "planned").otherwise("skipped"), "settings": F.when(reason.isNull(), json), "reason": reason})


def editable_in_place(boxes: DataFrame, key: str, most_header: int = 256 << 20) -> DataFrame:
    """``(key, editable)`` of ISO files by their boxes: one whole movie box, not large, no fragments and nothing open-ended."""
    top = F.col("depth") == 0
    fragments = F.col("type").isin("moof", "mvex", "sidx", "styp")
    header = F.sum(F.when(top & (F.col("type") == "moov"), F.col("size")))
    return boxes.groupBy(key).agg(((F.count_if(top & (F.col("type") == "moov")) == 1) & ~F.bool_or(fragments) & F.bool_and("whole") & F.coalesce(header <= most_header, F.lit(False))).alias("editable"))
