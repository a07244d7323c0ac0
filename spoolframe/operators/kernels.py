"""Picture kernels on raw RGBA planes, as Arrow-batched numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# The similarity's window, spread, constants and tile.
TAPS, SIGMA, C1, C2, TILE = 11, 1.5, 1e-4, 9e-4, 32
_X = np.arange(TAPS) - TAPS // 2
_KERNEL = np.exp(-(_X**2) / (2 * SIGMA**2))
_KERNEL = (_KERNEL / _KERNEL.sum()).astype(np.float32)


def planes(rgba: bytes, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Luma and chroma in 0..1 of a picture on white; null for bytes of another size."""
    if rgba is None or width <= 0 or height <= 0 or len(rgba) != 4 * width * height:
        return None
    p = np.frombuffer(rgba, np.uint8).reshape(height, width, 4).astype(np.float32) / 255
    rgb = p[..., :3] * p[..., 3:] + (1 - p[..., 3:])
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return y, 0.5 + (b - y) / 1.772, 0.5 + (r - y) / 1.402


def _blur(x: np.ndarray) -> np.ndarray:
    """Pictures blurred, those of a stack at once; a picture is the last two axes."""
    for axis in (-2, -1):
        pad = [(0, 0)] * x.ndim
        pad[axis] = (TAPS // 2, TAPS // 2)
        wide = np.pad(x, pad, mode="edge")
        n = x.shape[axis]
        x = sum(_KERNEL[i] * (wide[..., i : i + n, :] if axis == -2 else wide[..., i : i + n]) for i in range(TAPS))
    return x


def similarity_map(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Structural similarity around every pixel; variances are not below zero."""
    ma, mb, aa, bb, ab = _blur(np.stack([a, b, a * a, b * b, a * b]))
    va, vb = np.maximum(aa - ma * ma, 0), np.maximum(bb - mb * mb, 0)
    cov = ab - ma * mb
    return (2 * ma * mb + C1) * (2 * cov + C2) / ((ma * ma + mb * mb + C1) * (va + vb + C2))


def _half(x: np.ndarray) -> np.ndarray:
    h, w = x.shape[-2:]
    x = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(0, h % 2), (0, w % 2)], mode="edge")
    return (x[..., ::2, ::2] + x[..., 1::2, ::2] + x[..., ::2, 1::2] + x[..., 1::2, 1::2]) / 4


def compare(a: bytes, b: bytes, width: int, height: int) -> tuple[float, float] | None:
    """(overall, worst tile): luma counts six parts, each chroma at half size one."""
    pa, pb = planes(a, width, height), planes(b, width, height)
    if pa is None or pb is None:
        return None
    luma = similarity_map(pa[0], pb[0])
    chroma = [m.mean() for m in similarity_map(_half(np.stack(pa[1:])), _half(np.stack(pb[1:])))]
    rows, columns = np.arange(0, height, TILE), np.arange(0, width, TILE)
    sums = np.add.reduceat(np.add.reduceat(luma.astype(np.float64), rows, 0), columns, 1)
    sizes = np.outer(np.diff(np.append(rows, height)), np.diff(np.append(columns, width)))
    return float((6 * luma.mean() + sum(chroma)) / 8), float((sums / sizes).min())


@pandas_udf(T.StructType([T.StructField("overall", T.DoubleType()), T.StructField("worst", T.DoubleType())]))
def similarity(a: pd.Series, b: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """struct(overall, worst) of two RGBA planes; nulls where a plane has another size."""
    got = [compare(*row) or (None, None) for row in zip(a, b, width, height)]
    return pd.DataFrame(got, columns=["overall", "worst"])


@pandas_udf(T.DoubleType())
def detail(rgba: pd.Series) -> pd.Series:
    """1 minus the share of the fullest of the 4-bit colour buckets; null for no pixels."""

    def one(data: bytes | None) -> float | None:
        if not data or len(data) % 4:
            return None
        p = (np.frombuffer(data, np.uint8).reshape(-1, 4) >> 4).astype(np.int64)
        return float(1 - np.bincount(p @ np.array([4096, 256, 16, 1])).max() / len(p))

    return rgba.map(one)


@pandas_udf(T.BooleanType())
def is_flat(rgba: pd.Series) -> pd.Series:
    """Whether all pixels are one."""
    return rgba.map(lambda d: None if not d or len(d) % 4 else d == d[:4] * (len(d) // 4))


@pandas_udf(T.BinaryType())
def composed(rgba: pd.Series, width: pd.Series, height: pd.Series, canvas_width: pd.Series, canvas_height: pd.Series) -> pd.Series:
    """A frame scaled (nearest) into a clear canvas and centred."""

    def one(data, w, h, cw, ch):
        if data is None or len(data) != 4 * w * h or min(w, h, cw, ch) <= 0:
            return None
        ratio = min(cw / w, ch / h)
        nw, nh = max(1, round(w * ratio)), max(1, round(h * ratio))
        p = np.frombuffer(data, np.uint8).reshape(h, w, 4)
        scaled = p[np.minimum((np.arange(nh) / ratio).astype(int), h - 1)][:, np.minimum((np.arange(nw) / ratio).astype(int), w - 1)]
        out = np.zeros((ch, cw, 4), np.uint8)
        y, x = (ch - nh) // 2, (cw - nw) // 2
        out[y : y + nh, x : x + nw] = scaled
        return out.tobytes()

    return pd.Series([one(*row) for row in zip(rgba, width, height, canvas_width, canvas_height)])


def combine(scores: DataFrame, key: str) -> DataFrame:
    """The worst of several similarities, part by part."""
    return scores.groupBy(key).agg(F.min("overall").alias("overall"), F.min("worst").alias("worst"))


def guarded(rows: DataFrame, function, value: Column, schema: str) -> DataFrame:
    """A user's function over a column, one outcome per row: ``status``, ``value``, ``error``.

    ``function`` gets a value and may raise; its error is the row's and the run goes on.
    """

    @pandas_udf(f"status string, value {schema}, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for v in batch:
                try:
                    out.append(("succeeded", function(v), None))
                except Exception as e:  # a row's own failure is its outcome
                    out.append(("failed", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["status", "value", "error"])

    return rows.withColumn("outcome", run(value)).select("*", "outcome.*").drop("outcome")
