"""Flash payloads as column expressions and kernels: pictures, sounds and their containers."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Kinds of tags by code, for the census, omissions and verdict.
STRUCTURAL_TAGS = [0, 1, 9, 24, 43, 56, 57, 58, 64, 65, 66, 69, 71, 76, 77, 78, 86]
VECTOR_TAGS = [2, 4, 5, 7, 10, 11, 13, 17, 22, 23, 26, 28, 32, 33, 34, 37, 39, 46, 48, 62, 70, 73, 74, 75, 83, 84, 88, 91]
SCRIPT_TAGS = [12, 59, 72, 82]
MEDIA_TAGS = [6, 8, 14, 15, 18, 19, 20, 21, 35, 36, 45, 60, 61, 87, 89, 90]
MEDIA_BEARING_TAGS = [6, 14, 19, 20, 21, 35, 36, 60, 61, 87, 90]
SOUND_RATES = [5512, 11025, 22050, 44100]


def tag_kind(code: Column) -> Column:
    return F.when(code.isin(STRUCTURAL_TAGS), "structural").when(code.isin(VECTOR_TAGS), "vector").when(code.isin(SCRIPT_TAGS), "script").when(code.isin(MEDIA_TAGS), "media").otherwise("unrecognised")


def payload_kind(data: Column) -> Column:
    """What a payload is by its first bytes; the first rule that fits wins."""
    at = lambda start, n: F.hex(F.substring(data, start, n))
    tag = lambda s: s.encode().hex().upper()
    sync = F.coalesce((at(1, 1) == "FF") & (F.conv(at(2, 1), 16, 10).cast("int") >= 0xE0), F.lit(False))
    return (
        F.when(at(1, 3) == "FFD8FF", "jpeg").when(at(1, 8) == "89504E470D0A1A0A", "png").when(at(1, 6).isin(tag("GIF87a"), tag("GIF89a")), "gif")
        .when((at(1, 3) == tag("ID3")) | sync, "mp3").when((at(1, 4) == tag("RIFF")) & (at(9, 4) == tag("WAVE")), "wav").when((at(1, 4) == tag("FORM")) & (at(9, 4) == tag("AIFF")), "aiff")
        .when(at(1, 4) == tag("fLaC"), "flac").when(at(5, 4) == tag("ftyp"), "mp4").when(at(1, 4) == tag("OggS"), "ogg").when(at(1, 4) == "504B0304", "zip")
        .when(at(1, 3).isin(tag("FWS"), tag("CWS"), tag("ZWS")), "swf").when(at(1, 5) == tag("<?xml"), "xml").otherwise("unknown")
    )


def without_stray_prefix(jpeg: Column) -> Column:
    """JPEG bytes without an end and start mark before the picture."""
    return F.when(F.hex(F.substring(jpeg, 1, 4)) == "FFD9FFD8", F.substring(jpeg, 5, 1 << 30)).otherwise(jpeg)


def with_tables(tables: Column, scan: Column) -> Column:
    """Shared JPEG tables and a scan without them as one picture."""
    head, tail = without_stray_prefix(tables), without_stray_prefix(scan)
    n = F.octet_length(head)
    head = F.when(F.hex(F.substring(head, n - 1, F.lit(2))) == "FFD9", F.substring(head, F.lit(1), n - 2)).otherwise(head)
    tail = F.when(F.hex(F.substring(tail, 1, 2)) == "FFD8", F.substring(tail, 3, 1 << 30)).otherwise(tail)
    return F.concat(head, tail)


def sound_header(flags: Column) -> Column:
    """struct(codec, rate, bits, channels) of a sound's flag byte."""
    part = lambda shift, mask: F.shiftright(flags, shift).bitwiseAND(F.lit(mask))
    rates = F.array(*map(F.lit, SOUND_RATES))
    return F.struct(part(4, 15).alias("codec"), F.element_at(rates, part(2, 3) + 1).alias("rate"), F.when(part(1, 1) == 1, 16).otherwise(8).alias("bits"), (part(0, 1) + 1).alias("channels"))


def _png(rgba: np.ndarray) -> bytes:
    h, w, _ = rgba.shape
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgba.reshape(h, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def raster(body: bytes, alpha: bool) -> np.ndarray | None:
    """RGBA pixels of a lossless picture's tag body after its id: palette, 15 or 24 bits, or with alpha; null if malformed.

    A pixel whose index is not in the palette is transparent black.
    """
    if body is None or len(body) < 5:
        return None
    kind, w, h = struct.unpack_from("<BHH", body)
    if not w or not h or w * h > 1 << 26:
        return None
    colours = body[5] + 1 if kind == 3 and len(body) > 5 else 0
    row = {3: (w + 3) // 4 * 4, 4: (2 * w + 3) // 4 * 4, 5: 4 * w}.get(kind)
    if row is None or kind == 4 and alpha:
        return None
    need = row * h + colours * (4 if alpha else 3)
    try:
        data = zlib.decompressobj().decompress(body[6 if kind == 3 else 5 :], need)
    except zlib.error:
        return None
    if len(data) < need:
        return None
    out = np.full((h, w, 4), 255, np.uint8)
    if kind == 3:
        size = 4 if alpha else 3
        palette = np.frombuffer(data, np.uint8, colours * size).reshape(-1, size)
        index = np.frombuffer(data, np.uint8, row * h, colours * size).reshape(h, row)[:, :w]
        known = index < colours
        out[..., :size] = palette[np.where(known, index, 0)]
        out[~known] = 0
    elif kind == 4:
        v = np.frombuffer(data, ">u2", row * h // 2).reshape(h, row // 2)[:, :w]
        for c, shift in enumerate((10, 5, 0)):
            five = v >> shift & 31
            out[..., c] = five << 3 | five >> 2
    else:
        v = np.frombuffer(data, np.uint8, row * h).reshape(h, w, 4)
        out[..., :3] = v[..., 1:]
        if alpha:
            out[..., 3] = v[..., 0]
    return out


@pandas_udf(T.BinaryType())
def lossless_png(body: pd.Series, alpha: pd.Series) -> pd.Series:
    """A lossless picture's tag body as PNG bytes; null if malformed."""
    made = [raster(b, bool(a)) for b, a in zip(body, alpha)]
    return pd.Series([None if m is None else _png(m) for m in made])


# Phrases of extractor errors and the class that the first of them names, in the order that they are asked.
ERROR_PHRASES = [
    ("unsupported site", ["unsupported url", "no suitable extractor"]),
    ("protected", ["drm", "protected by"]),
    ("bot check", ["sign in to confirm you're not a bot", "sign in to confirm your age", "confirm you're not a bot", "the page needs to be reloaded", "captcha"]),
    ("authentication", ["login required", "requires authentication", "sign in", "log in", "members-only", "subscribers only", "private video", "this video is private"]),
    ("geo restricted", ["available in your country", "blocked in your country", "blocked it in your country", "not available from your location", "geo restrict", "geo-restrict", "geo restriction", "geographic"]),
    ("live", ["live event", "is live", "live stream has not", "premieres in"]),
    ("unavailable", ["video unavailable", "this video is unavailable", "has been removed", "no longer available", "does not exist", "account associated with this video has been terminated"]),
    ("no usable format", ["requested format is not available", "no video formats found", "only images are available"]),
    ("network", ["unable to download", "connection reset", "timed out", "temporary failure in name resolution"]),
]


def error_class(kind: Column, message: Column, restricted: Column | None = None) -> Column:
    """The class of an extractor's error.

    A flagged platform restriction comes first, then missing modules, then the
    first phrase that the message has; errors of the transport are of the network
    whatever they say, and the rest is ``other``. Null kinds and messages count as empty.
    """
    kind, text = F.coalesce(kind, F.lit("")), F.lower(F.coalesce(message, F.lit("")))
    out = F.when((kind == "URLError") | kind.contains("HTTPError"), "network").otherwise("other")
    for name, phrases in reversed(ERROR_PHRASES):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | text.contains(p)
        out = F.when(hit, name).otherwise(out)
    out = F.when((kind == "ModuleNotFoundError") | kind.endswith("ImportError"), "not installed").otherwise(out)
    return out if restricted is None else F.when(F.coalesce(restricted, F.lit(False)), "restricted").otherwise(out)


def route(url: Column, tool: Column, named: Column, gallery: Column) -> Column:
    """Which tool takes a URL: the one asked for, a direct media file, a named extractor, a gallery, else the extractor's fallback."""
    direct = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1)).isin("mp4", "m4v", "mov", "mp3", "m4a", "wav", "jpg", "jpeg", "png", "gif", "webp", "pdf", "zip", "cbz")
    return F.when(tool.isNotNull(), tool).when(direct, "direct").when(named.isNotNull(), "media").when(F.coalesce(gallery, F.lit(False)), "gallery").otherwise("media")
