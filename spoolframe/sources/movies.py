"""ISO media files to rows: tracks, samples, subtitle cues, chapters and metadata items, and metadata back into files.

As in ``containers``, parsers are plain functions from bytes to a list of dicts,
``BadFile`` is what they raise, and declared sizes are never trusted.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from .containers import MOST_DEPTH, MOST_TAGS, BadFile, _need, strip_markup, timed_text

# Kinds of tracks by handler, and text keys of the item list.
HANDLERS = {"vide": "video", "soun": "audio", "sbtl": "subtitle", "subt": "subtitle", "text": "text", "clcp": "closed caption", "tmcd": "timecode", "meta": "metadata", "hint": "hint"}
ITEM_KEYS = {
    "\xa9nam": "title", "\xa9ART": "artist", "aART": "album_artist", "\xa9alb": "album", "\xa9gen": "genre", "\xa9cmt": "comment", "cprt": "copyright", "\xa9day": "date", "\xa9wrt": "composer",
    "desc": "summary", "ldes": "long_description", "covr": "artwork", "stik": "media_kind", "tvsh": "series", "tvsn": "season", "tves": "episode", "tven": "episode_id", "tvnn": "network", "trkn": "track", "disk": "disc", "cpil": "compilation",
}
#: Boxes whose content is boxes.
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"tref", b"ilst"}


_HEAD = struct.Struct(">I4s")


def boxes(data: bytes, at: int = 0, stop: int | None = None) -> Iterator[tuple[bytes, int, int, int]]:
    """(type, start, start of the content, end) of the boxes side by side in a range; a box that runs past it is an error."""
    stop = len(data) if stop is None else stop
    while at + 8 <= stop:
        size, tag = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            _need(at + 16 <= stop, "cut long size")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = stop - at
        _need(size >= head and at + size <= stop, f"box {tag.decode('latin-1')} does not fit")
        yield tag, at, at + head, at + size
        at += size


def find(data: bytes, path: str, at: int = 0, stop: int | None = None) -> tuple[int, int] | None:
    """(start of the content, end) of the first box at a path such as ``mdia/mdhd``."""
    stop = len(data) if stop is None else stop
    for wanted in path.encode("latin-1").split(b"/"):
        while at + 8 <= stop:
            size, tag = _HEAD.unpack_from(data, at)
            head = 8
            if size < 8:  # a long size, one to the end, or a bad one
                _, _, body, end = next(boxes(data, at, stop))
                size, head = end - at, body - at
            elif at + size > stop:
                raise BadFile(f"box {tag.decode('latin-1')} does not fit")
            if tag == wanted:
                at, stop = at + head, at + size
                break
            at += size
        else:
            return None
    return at, stop


def _u(data: bytes, at: int, size: int, stop: int) -> int:
    _need(at + size <= stop, "cut field")
    return int.from_bytes(data[at : at + size], "big")


def _tracks(data: bytes) -> list[tuple[int, int]]:
    moov = find(data, "moov")
    _need(moov is not None, "no movie box")
    return [(body, end) for tag, _, body, end in boxes(data, *moov) if tag == b"trak"]


def _header(data: bytes, trak: tuple[int, int]) -> dict:
    """Identity, times, handler and sample entry of a track."""
    tkhd, mdia = find(data, "tkhd", *trak), find(data, "mdia", *trak)
    mdhd, hdlr, stsd = (mdia and find(data, p, *mdia) for p in ("mdhd", "hdlr", "minf/stbl/stsd"))
    _need(tkhd is not None and mdhd is not None, "track without headers")
    at, stop = tkhd
    wide = _u(data, at, 1, stop) == 1
    row = {"track_id": _u(data, at + (20 if wide else 12), 4, stop), "enabled": bool(_u(data, at + 3, 1, stop) & 1)}
    sides = at + (88 if wide else 76)
    row["width"], row["height"] = _u(data, sides, 4, stop) / 65536, _u(data, sides + 4, 4, stop) / 65536
    at, stop = mdhd
    wide = _u(data, at, 1, stop) == 1
    row["scale"] = _u(data, at + (20 if wide else 12), 4, stop)
    row["length"] = _u(data, at + (24 if wide else 16), 8 if wide else 4, stop)
    code = _u(data, at + (32 if wide else 20), 2, stop)
    letters = "".join(chr(0x60 + (code >> shift & 31)) for shift in (10, 5, 0))
    row["language"] = letters if code < 0x8000 and letters.isalpha() and letters != "und" else None
    row["handler"] = data[hdlr[0] + 8 : hdlr[0] + 12].decode("latin-1") if hdlr is not None else ""
    row |= {"code": None, "rate": None, "channels": None, "coded_width": None, "coded_height": None}
    if stsd is not None:
        for tag, _, body, end in boxes(data, stsd[0] + 8, stsd[1]):
            row["code"] = tag.decode("latin-1")
            if row["handler"] == "soun" and body + 28 <= end:
                row["channels"], row["rate"] = _u(data, body + 16, 2, end), _u(data, body + 24, 4, end) / 65536
            elif row["handler"] == "vide" and body + 28 <= end:
                row["coded_width"], row["coded_height"] = _u(data, body + 24, 2, end), _u(data, body + 26, 2, end)
            break
    return row


def _table(data: bytes, stbl: tuple[int, int], name: str, fields: str) -> list[tuple]:
    """Rows of a sample table box with a count of entries; entries that are not there are an error."""
    place = find(data, name, *stbl)
    if place is None:
        return []
    at, stop = place
    count, size = _u(data, at + 4, 4, stop), struct.calcsize(fields)
    _need(count <= MOST_TAGS and at + 8 + count * size <= stop, f"cut table {name}")
    return list(struct.iter_unpack(fields, data[at + 8 : at + 8 + count * size]))


def _samples(data: bytes, trak: tuple[int, int]) -> list[tuple[int, int, int, int]]:
    """(start, duration, offset, size) of a track's samples, times in its own scale."""
    sizes: list[int] = []
    stbl = find(data, "mdia/minf/stbl", *trak)
    if stbl is None:
        return []
    list(boxes(data, *stbl))  # a box that does not fit is an error, wherever it stands
    place = find(data, "stsz", *stbl)
    if place is not None:
        at, stop = place
        each, count = _u(data, at + 4, 4, stop), _u(data, at + 8, 4, stop)
        _need(count <= MOST_TAGS, "too many samples")
        sizes = [each] * count if each else [_u(data, at + 12 + 4 * i, 4, stop) for i in range(count)]
    chunks = [o for (o,) in _table(data, stbl, "stco", ">I")] or [o for (o,) in _table(data, stbl, "co64", ">Q")]
    runs = _table(data, stbl, "stsc", ">III")
    times = [(n, d) for n, d in _table(data, stbl, "stts", ">II")]
    _need(sum(n for n, _ in times) <= MOST_TAGS, "too many samples")
    durations = [d for n, d in times for _ in range(n)]
    out, k, clock = [], 0, 0
    for i, (first, per, _) in enumerate(runs):
        last = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(chunks)
        for chunk in range(first, min(last, len(chunks)) + 1):
            _need(chunk >= 1, "bad chunk number")
            place = chunks[chunk - 1]
            for _ in range(per):
                if k >= len(sizes):
                    return out
                length = durations[k] if k < len(durations) else 0
                out.append((clock, length, place, sizes[k]))
                place, clock, k = place + sizes[k], clock + length, k + 1
    return out


def movie_tracks(data: bytes) -> list[dict]:
    """A row per track: kind, codec, times, sizes, sound layout, language and its samples' number and bytes."""
    out = []
    for i, trak in enumerate(_tracks(data)):
        h, samples = _header(data, trak), _samples(data, trak)
        seconds = h["length"] / h["scale"] if h["scale"] else None
        total = sum(s[3] for s in samples)
        video = h["handler"] == "vide"
        out.append({
            "index": i, "track_id": h["track_id"], "kind": HANDLERS.get(h["handler"], "other"), "code": h["code"], "enabled": h["enabled"], "seconds": seconds, "language": h["language"],
            "width": (h["coded_width"] or round(h["width"])) if video else None, "height": (h["coded_height"] or round(h["height"])) if video else None,
            "rate": h["rate"] or None, "channels": h["channels"] or None, "samples": len(samples), "bytes": total, "bitrate": total * 8 / seconds if seconds else None, "fps": len(samples) / seconds if video and seconds else None,
        })
    return out


def movie_samples(data: bytes) -> list[dict]:
    """A row per sample of every track: its times in seconds and its place in the file."""
    out = []
    for trak in _tracks(data):
        h = _header(data, trak)
        scale = h["scale"] or 1
        out += [{"track_id": h["track_id"], "pos": k, "start": start / scale, "seconds": length / scale, "offset": offset, "size": size} for k, (start, length, offset, size) in enumerate(_samples(data, trak))]
    return out


def web_sample(data: bytes) -> list[dict]:
    """A WebVTT sample: the cues in it as one text with its style runs; none for an empty one."""
    text, runs = "", []
    for tag, _, body, end in boxes(data):
        if tag == b"vttc":
            for inner, _, lo, hi in boxes(data, body, end):
                if inner == b"payl":
                    shown, styles = strip_markup(data[lo:hi].decode("utf-8", "replace"))
                    if shown:
                        shift = len(text) + bool(text)
                        text = f"{text}\n{shown}" if text else shown
                        runs += [{**r, "lo": r["lo"] + shift, "hi": r["hi"] + shift} for r in styles]
    return [{"text": text, "runs": runs}] if text else []


_DECODE = {"tx3g": timed_text, "text": timed_text, "wvtt": web_sample}


def _decoded(data: bytes, trak: tuple[int, int], h: dict) -> Iterator[tuple[float, float, str, list[dict]]]:
    for start, length, offset, size in _samples(data, trak):
        _need(offset + size <= len(data), "sample outside the file")
        for row in _DECODE[h["code"]](data[offset : offset + size]):
            if row["text"]:
                yield start / (h["scale"] or 1), (start + length) / (h["scale"] or 1), row["text"], row["runs"]


def movie_cues(data: bytes) -> list[dict]:
    """Cues of every readable subtitle track; samples that carry on with the same text are one cue."""
    out: list[dict] = []
    for trak in _tracks(data):
        h = _header(data, trak)
        if HANDLERS.get(h["handler"]) not in ("subtitle", "text") or h["code"] not in _DECODE or _is_chapters(data, h["track_id"]):
            continue
        own: list[dict] = []
        for start, end, text, runs in _decoded(data, trak, h):
            if own and abs(own[-1]["end"] - start) < 0.0005 and (own[-1]["text"], own[-1]["runs"]) == (text, runs):
                own[-1]["end"] = end
            else:
                own.append({"track_id": h["track_id"], "language": h["language"], "pos": len(own), "start": start, "end": end, "text": text, "runs": runs})
        out += own
    return out


def _chapter_tracks(data: bytes) -> list[int]:
    """Tracks that others name as their chapters."""
    out = []
    for trak in _tracks(data):
        place = find(data, "tref/chap", *trak)
        if place is not None:
            out += [_u(data, at, 4, place[1]) for at in range(place[0], place[1] - 3, 4)]
    return out


def _is_chapters(data: bytes, track_id: int) -> bool:
    return track_id in _chapter_tracks(data)


def movie_chapters(data: bytes) -> list[dict]:
    """Chapters of the first chapter track that has any, else of the movie's chapter list, with their lengths."""
    wanted, found, length = _chapter_tracks(data), [], 0.0
    for trak in _tracks(data):
        h = _header(data, trak)
        length = max(length, h["length"] / h["scale"] if h["scale"] else 0.0)
        if h["track_id"] in wanted and h["code"] in _DECODE and not found:
            found = [(start, end, text) for start, end, text, _ in _decoded(data, trak, h)]
    place = find(data, "moov/udta/chpl")
    if not found and place is not None:
        at, stop = place
        at += 5 if _u(data, at, 1, stop) == 0 else 8
        count, at, starts = _u(data, at, 1, stop), at + 1, []
        for _ in range(count):
            start, size = _u(data, at, 8, stop) / 1e7, _u(data, at + 8, 1, stop)
            _need(at + 9 + size <= stop, "cut chapter title")
            starts.append((start, data[at + 9 : at + 9 + size].decode("utf-8", "replace")))
            at += 9 + size
        starts.sort(key=lambda c: c[0])
        ends = [s for s, _ in starts[1:]] + [max(length, starts[-1][0] if starts else 0.0)]
        found = [(s, e, t) for (s, t), e in zip(starts, ends)]
    return [{"pos": i, "start": s, "seconds": e - s, "title": t} for i, (s, e, t) in enumerate(found)]


def _item_list(data: bytes) -> tuple[int, int] | None:
    meta = find(data, "moov/udta/meta")
    return None if meta is None else find(data, "ilst", meta[0] + 4, meta[1])


def movie_items(data: bytes) -> list[dict]:
    """Values of the movie's item list: key, its plain name, and text, number or bytes as the value's type says.

    Numbers of tracks and discs are the number before the total, whose text is
    ``number/total``.
    """
    _need(find(data, "moov") is not None, "no movie box")
    place, out = _item_list(data), []
    for tag, _, body, end in boxes(data, *place) if place is not None else ():
        key = tag.decode("latin-1")
        if tag == b"----":
            parts = {t: data[b + 4 : e].decode("utf-8", "replace") for t, _, b, e in boxes(data, body, end) if t in (b"mean", b"name")}
            key = f"----:{parts.get(b'mean', '')}:{parts.get(b'name', '')}"
        for inner, _, lo, hi in boxes(data, body, end):
            if inner != b"data" or lo + 8 > hi:
                continue
            kind, raw = _u(data, lo, 4, hi) & 0xFFFFFF, data[lo + 8 : hi]
            text = number = payload = None
            if key in ("trkn", "disk") and len(raw) >= 6:
                number, total = struct.unpack_from(">HH", raw, 2)
                text = f"{number}/{total}" if total else str(number)
            elif kind == 1:
                text = raw.decode("utf-8", "replace")
            elif kind == 2:
                text = raw.decode("utf-16-be", "replace")
            elif kind in (21, 22) and 1 <= len(raw) <= 8:
                number = int.from_bytes(raw, "big", signed=kind == 21)
            else:
                payload = raw
            out.append({"pos": len(out), "key": key, "name": ITEM_KEYS.get(key), "type": kind, "text": text, "number": number, "payload": payload})
    return out


def box(tag: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + tag.encode("latin-1") + body


def item(key: str, value: str | int | bytes) -> bytes:
    """An entry of the item list; ``----:mean:name`` keys are written with their parts."""
    if isinstance(value, bytes):
        kind, raw = (14 if value[:4] == b"\x89PNG" else 13 if value[:2] == b"\xff\xd8" else 0), value
    elif isinstance(value, int):
        kind, raw = 21, value.to_bytes(8 if not -(1 << 31) <= value < 1 << 31 else 4, "big", signed=True)
    else:
        kind, raw = 1, value.encode()
    if key in ("trkn", "disk"):
        number, _, total = str(value).partition("/")
        kind, raw = 0, struct.pack(">HHH", 0, int(number), int(total or 0)) + b"\0\0" * (key == "trkn")
    content = box("data", struct.pack(">II", kind, 0), raw)
    if key.startswith("----:"):
        _, mean, name = key.split(":", 2)
        return box("----", box("mean", b"\0" * 4, mean.encode()), box("name", b"\0" * 4, name.encode()), content)
    return box(key, content)


def _shifted(data: bytes, at: int, stop: int, path: tuple[bytes, ...], by: int, depth: int = 0) -> bytes:
    """The boxes of a range with every chunk offset moved."""
    _need(depth <= MOST_DEPTH, "boxes nest too deep")
    out = []
    for tag, start, body, end in boxes(data, at, stop):
        if tag in (b"stco", b"co64"):
            form, count = ">I" if tag == b"stco" else ">Q", _u(data, body + 4, 4, end)
            size = struct.calcsize(form)
            _need(body + 8 + count * size <= end, "cut chunk offsets")
            moved = [o + by for (o,) in struct.iter_unpack(form, data[body + 8 : body + 8 + count * size])]
            _need(all(0 <= o < 1 << 8 * size for o in moved), "a chunk offset does not fit")
            out.append(data[start : body + 8] + b"".join(struct.pack(form, o) for o in moved) + data[body + 8 + count * size : end])
        elif tag in _NESTED and tag not in (b"udta", b"ilst", b"tref"):
            inner = _shifted(data, body, end, (*path, tag), by, depth + 1)
            out.append(struct.pack(">I4s", 8 + len(inner), tag) + inner)
        else:
            out.append(data[start:end])
    return b"".join(out)


def with_items(data: bytes, items: list[tuple[str, str | int | bytes]]) -> bytes:
    """The file with these values in its item list, in place of all that it had; no other byte of its media changes.

    Where the movie box comes before media that it points at, chunk offsets are
    moved by what the box grows or shrinks. Files in fragments are refused.
    """
    top = list(boxes(data))
    moov = [b for b in top if b[0] == b"moov"]
    _need(len(moov) == 1, "not one movie box")
    _need(not any(b[0] in (b"moof", b"sidx") for b in top) and find(data, "moov/mvex") is None, "a file in fragments is not edited")
    _, start, body, end = moov[0]
    handler = box("hdlr", struct.pack(">II4s4s", 0, 0, b"mdir", b"appl"), b"\0" * 9)
    meta = box("meta", b"\0" * 4, handler, box("ilst", *(item(k, v) for k, v in items))) if items else b""
    inside = list(boxes(data, body, end))
    kept_user = b"".join(data[s:e] for tag, _, b, stop in inside if tag == b"udta" for t, s, _, e in boxes(data, b, stop) if t != b"meta")
    user = box("udta", kept_user, meta) if kept_user or meta else b""
    others = [(s, e) for tag, s, _, e in inside if tag != b"udta"]

    def rebuilt(by: int) -> bytes:
        return box("moov", *(_shifted(data, s, e, (b"moov",), by) for s, e in others), user)

    plain = rebuilt(0)
    grown = len(plain) - (end - start)
    after = any(b[0] == b"mdat" and b[1] > start for b in top)
    before = any(b[0] == b"mdat" and b[1] < start for b in top)
    _need(not (after and before and grown), "media on both sides of the movie box")
    return data[:start] + (rebuilt(grown) if after and grown else plain) + data[end:]


#: Parser name -> (function, columns of a row).
PARSERS = {
    "movie_tracks": (movie_tracks, "index int, track_id long, kind string, code string, enabled boolean, seconds double, language string, width int, height int, rate double, channels int, samples int, bytes long, bitrate double, fps double"),
    "movie_samples": (movie_samples, "track_id long, pos int, start double, seconds double, offset long, size long"),
    "movie_cues": (movie_cues, "track_id long, language string, pos int, start double, end double, text string, runs array<struct<lo:int,hi:int,style:int>>"),
    "movie_chapters": (movie_chapters, "pos int, start double, seconds double, title string"),
    "movie_items": (movie_items, "pos int, key string, name string, type int, text string, number long, payload binary"),
    "web_sample": (web_sample, "text string, runs array<struct<lo:int,hi:int,style:int>>"),
}
