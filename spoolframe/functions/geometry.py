"""Picture sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest side that a rendered Flash frame may have.
LARGEST_RENDER = 8192


def _sized(width: Column, height: Column, ratio: Column, down: bool = False) -> Column:
    """Both sides times a ratio below one, at least 1 each; a ratio of one or more (or null) keeps them."""
    whole = F.floor if down else F.round
    scaled = F.struct(
        F.greatest(F.lit(1), whole(width * ratio).cast("int")).alias("width"),
        F.greatest(F.lit(1), whole(height * ratio).cast("int")).alias("height"),
    )
    return F.when((width > 0) & (height > 0) & (ratio < 1), scaled).otherwise(F.struct(width.cast("int").alias("width"), height.cast("int").alias("height")))


def resize(kind: str, width: Column, height: Column, a: Column | None = None, b: Column | None = None) -> Column:
    """The size a target asks for, as struct(width, height); a target never enlarges.

    Kinds: ``none``; ``fit`` into a box a x b; ``longest_side`` a; ``scale`` a;
    ``max_pixels`` a (rounded down, the others to nearest, halves away from
    zero). A target that is not positive, and a size that is not, change nothing.
    """
    w, h = width.cast("double"), height.cast("double")
    if kind == "none":
        ratio = F.lit(None).cast("double")
    elif kind == "fit":
        ratio = F.when((a > 0) & (b > 0), F.least(a / w, b / h))
    elif kind == "longest_side":
        ratio = F.when(a > 0, a / F.greatest(w, h))
    elif kind == "scale":
        ratio = F.when(a > 0, a.cast("double"))
    elif kind == "max_pixels":
        ratio = F.when((a > 0) & (w * h > a), F.sqrt(a / (w * h)))
    else:
        raise ValueError(f"no resize target {kind!r}")
    return _sized(width, height, ratio, down=kind == "max_pixels")


def even_floor(side: Column) -> Column:
    """The next even number down, for formats that need even sides; 1 stays."""
    return F.when(side > 1, side.bitwiseAND(F.lit(-2))).otherwise(side)


def swaps_axes(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether an affine transform (a, b, c, d) is a quarter turn."""
    return (F.abs(b) > 0.5) & (F.abs(c) > 0.5) & (F.abs(a) < 0.5) & (F.abs(d) < 0.5)


def render_size(width: Column, height: Column, side: Column) -> Column:
    """A Flash stage drawn with its longest side at ``side``; unlike ``resize`` this may enlarge."""
    ratio = F.least(side, F.lit(LARGEST_RENDER)) / F.greatest(width, height)
    return F.struct(F.greatest(F.lit(1), F.round(width * ratio).cast("int")).alias("width"), F.greatest(F.lit(1), F.round(height * ratio).cast("int")).alias("height"))


def canvas_fit(width: Column, height: Column, canvas_width: Column, canvas_height: Column) -> Column:
    """A frame scaled into a canvas and centred: struct(x, y, width, height)."""
    ratio = F.least(canvas_width / width, canvas_height / height)
    w, h = F.round(width * ratio), F.round(height * ratio)
    return F.struct(F.floor((canvas_width - w) / 2).cast("int").alias("x"), F.floor((canvas_height - h) / 2).cast("int").alias("y"), w.cast("int").alias("width"), h.cast("int").alias("height"))


def frame_times(kind: str, duration: Column, value: Column) -> Column:
    """Times of frames to take: ``every`` n seconds, or ``count`` of them at mid-points.

    Times are whole multiples, not running sums, so no drift builds up.
    """
    if kind == "every":
        last = F.floor((duration - F.lit(1e-9)) / value)
        return F.when((value > 0) & (duration > 0), F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: i * value)).otherwise(F.array().cast("array<double>"))
    if kind == "count":
        return F.when(value > 0, F.transform(F.sequence(F.lit(0), (value - 1).cast("int")), lambda i: (i + 0.5) * duration / value)).otherwise(F.array().cast("array<double>"))
    raise ValueError(f"no frame rule {kind!r}")


def sample_ranges(duration: Column, count: int, seconds: float) -> Column:
    """Windows of a clip to try: the whole of a short one, else ``count`` windows centred in equal parts."""
    part = duration / count
    windows = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(F.greatest(F.lit(0.0), (i + 0.5) * part - seconds / 2).alias("start"), F.lit(seconds).alias("length")))
    whole = F.array(F.struct(F.lit(0.0).alias("start"), duration.alias("length")))
    return F.when(duration <= count * seconds * 1.5, whole).otherwise(windows)
