"""Container bytes to rows: ZIP, WAV, pictures, ISO boxes, ID3, Flash, subtitles and package metadata.

Parsers are plain functions from bytes to a list of dicts; ``BadFile`` is the only
error they raise. Declared sizes are never trusted beyond the bytes that are there.
"""

from __future__ import annotations

import re
import struct
import zlib

#: Guards against hostile input.
MOST_TAGS, MOST_DEPTH, MOST_INFLATED, MOST_SUBTITLE, MOST_CUE = 1_000_000, 32, 256 << 20, 32 << 20, 16 << 10


class BadFile(ValueError):
    """The bytes are not what they were read as."""


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise BadFile(why)


# ZIP


def zip_entries(data: bytes) -> list[dict]:
    """The central directory: name, method, CRC, sizes and place of every member, ZIP64 included."""
    end = data.rfind(b"PK\x05\x06", max(0, len(data) - 65557))
    _need(end >= 0 and end + 22 <= len(data), "no end of central directory")
    count, size, at = struct.unpack_from("<HII", data, end + 10)
    wide = data.rfind(b"PK\x06\x06", 0, end)
    if (count == 0xFFFF or at == 0xFFFFFFFF) and wide >= 0:
        _need(wide + 56 <= len(data), "cut ZIP64 record")
        count, size, at = struct.unpack_from("<QQQ", data, wide + 32)
    _need(at <= end and at + size <= len(data), "central directory outside the file")
    out = []
    for pos in range(count):
        _need(at + 46 <= len(data) and data[at : at + 4] == b"PK\x01\x02", f"no header for member {pos}")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, packed, plain, n, extra, comment = struct.unpack_from("<IIIHHH", data, at + 16)
        attributes, offset = struct.unpack_from("<II", data, at + 38)
        raw, more = data[at + 46 : at + 46 + n], data[at + 46 + n : at + 46 + n + extra]
        _need(len(raw) == n, "cut member name")
        wanted = [x == 0xFFFFFFFF for x in (plain, packed, offset)]
        k = 0
        while k + 4 <= len(more) and any(wanted):
            tag, length = struct.unpack_from("<HH", more, k)
            if tag == 1:
                values = [plain, packed, offset]
                j = k + 4
                for i in range(3):
                    if wanted[i] and j + 8 <= min(k + 4 + length, len(more)):
                        values[i] = struct.unpack_from("<Q", more, j)[0]
                        j += 8
                plain, packed, offset = values
            k += 4 + length
        try:
            name = raw.decode("utf-8")
        except UnicodeDecodeError:
            name = raw.decode("latin-1")
        out.append({"pos": pos, "name": name, "is_dir": name.endswith("/"), "method": method, "encrypted": bool(flags & 1), "crc32": crc, "compressed": packed, "size": plain, "external_attrs": attributes, "offset": offset})
        at += 46 + n + extra + comment
    return out


def zip_raw(data: bytes, entry: dict) -> bytes:
    """A member's bytes as they are stored."""
    at = entry["offset"]
    _need(at + 30 <= len(data) and data[at : at + 4] == b"PK\x03\x04", "no local header")
    n, extra = struct.unpack_from("<HH", data, at + 26)
    start = at + 30 + n + extra
    _need(start + entry["compressed"] <= len(data), "member runs past the file")
    return data[start : start + entry["compressed"]]


def zip_member(data: bytes, entry: dict) -> bytes:
    """A member's content, stored or deflated, checked by size and CRC."""
    raw = zip_raw(data, entry)
    if entry["method"] == 0:
        out = raw
    elif entry["method"] == 8:
        out = inflate(raw, entry["size"], -15)
    else:
        raise BadFile(f"method {entry['method']} is not read")
    _need(len(out) == entry["size"] and zlib.crc32(out) == entry["crc32"], "member does not match its directory entry")
    return out


def zip_write(members: list[tuple[str, bytes]]) -> bytes:
    """Members as a ZIP without compression; the same members give the same bytes."""
    body, directory = bytearray(), bytearray()
    for name, content in members:
        raw, crc, at = name.encode(), zlib.crc32(content), len(body)
        common = struct.pack("<HHHHHIIIH", 20, 0x800, 0, 0, 0x21, crc, len(content), len(content), len(raw))
        body += b"PK\x03\x04" + common + struct.pack("<H", 0) + raw + content
        directory += b"PK\x01\x02" + struct.pack("<H", 20) + common + struct.pack("<HHHHII", 0, 0, 0, 0, 0, at) + raw
    return bytes(body + directory + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, len(members), len(members), len(directory), len(body), 0))


def inflate(raw: bytes, most: int, window: int = 15) -> bytes:
    """Inflates up to a bound; more is an error."""
    machine = zlib.decompressobj(window)
    try:
        out = machine.decompress(raw, min(most, MOST_INFLATED) + 1)
    except zlib.error as e:
        raise BadFile(f"bad deflate data: {e}") from None
    _need(len(out) <= min(most, MOST_INFLATED), "inflates to more than it may")
    return out


# Sound


def wav_info(data: bytes) -> list[dict]:
    """One row: codec, channels, rate, bits and seconds of a RIFF wave."""
    _need(data[:4] == b"RIFF" and data[8:12] == b"WAVE", "no wave file")
    at, shape, size = 12, None, None
    while at + 8 <= len(data):
        tag, length = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if tag == b"fmt ":
            _need(length >= 16 and at + 24 <= len(data), "cut format")
            shape = struct.unpack_from("<HHIIHH", data, at + 8)
        elif tag == b"data":
            size = min(length, len(data) - at - 8)
        at += 8 + length + (length & 1)
    _need(shape is not None and size is not None, "no format or data")
    code, channels, rate, per_second, block, bits = shape
    return [{"codec": {1: "pcm", 3: "float", 6: "alaw", 7: "mulaw"}.get(code, str(code)), "channels": channels, "rate": rate, "bits": bits, "seconds": size / per_second if per_second else None}]


def wav_write(pcm: bytes, rate: int, channels: int, bits: int = 16) -> bytes:
    """Samples with the 44-byte header, and a pad byte after an odd length."""
    block = channels * bits // 8
    pad = b"\0" * (len(pcm) & 1)
    return b"RIFF" + struct.pack("<I", 36 + len(pcm) + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * block, block, bits) + b"data" + struct.pack("<I", len(pcm)) + pcm + pad


# Pictures


def image_info(data: bytes) -> list[dict]:
    """One row: format, size, frames, delays in seconds and loops, from headers alone."""
    row = {"format": None, "width": None, "height": None, "frames": 1, "delays": [], "loops": None}
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        _need(len(data) >= 24, "cut PNG")
        row |= {"format": "png", "width": struct.unpack_from(">I", data, 16)[0], "height": struct.unpack_from(">I", data, 20)[0]}
        at = 8
        while at + 8 <= len(data):
            length, tag = struct.unpack_from(">I4s", data, at)
            if tag == b"acTL" and at + 16 <= len(data):
                row["frames"], row["loops"] = struct.unpack_from(">II", data, at + 8)
            elif tag == b"fcTL" and at + 34 <= len(data):
                num, den = struct.unpack_from(">HH", data, at + 28)
                row["delays"].append(num / (den or 100))
            at += 12 + length
    elif data[:6] in (b"GIF87a", b"GIF89a"):
        _need(len(data) >= 13, "cut GIF")
        row |= {"format": "gif", "frames": 0}
        row["width"], row["height"], packed = struct.unpack_from("<HHB", data, 6)
        at, delay = 13 + (3 << (packed & 7) + 1 if packed & 0x80 else 0), 0.0

        def skip(at: int) -> int:
            while at < len(data) and data[at]:
                at += 1 + data[at]
            return at + 1

        while at < len(data) and data[at] != 0x3B:
            if data[at] == 0x21:
                _need(at + 2 < len(data), "cut GIF block")
                if data[at + 1] == 0xF9 and at + 6 <= len(data):
                    delay = struct.unpack_from("<H", data, at + 4)[0] / 100
                elif data[at + 1] == 0xFF and data[at + 3 : at + 14] == b"NETSCAPE2.0" and at + 18 <= len(data):
                    row["loops"] = struct.unpack_from("<H", data, at + 16)[0]
                at = skip(at + 2)
            elif data[at] == 0x2C:
                _need(at + 10 <= len(data), "cut GIF picture")
                row["frames"] += 1
                row["delays"].append(delay)
                at += 10 + (3 << (data[at + 9] & 7) + 1 if data[at + 9] & 0x80 else 0)
                at = skip(at + 1)
            else:
                break
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        row |= {"format": "webp", "frames": 0}
        at = 12
        while at + 8 <= len(data):
            tag, length = struct.unpack_from("<4sI", data, at)
            body = data[at + 8 : at + 8 + length]
            if tag == b"VP8X" and len(body) >= 10:
                row["width"], row["height"] = (int.from_bytes(body[i : i + 3], "little") + 1 for i in (4, 7))
            elif tag == b"VP8 " and len(body) >= 10:
                row["frames"] = max(row["frames"], 1)
                if row["width"] is None:
                    row["width"], row["height"] = (x & 0x3FFF for x in struct.unpack_from("<HH", body, 6))
            elif tag == b"VP8L" and len(body) >= 5:
                row["frames"] = max(row["frames"], 1)
                if row["width"] is None:
                    bits = int.from_bytes(body[1:5], "little")
                    row["width"], row["height"] = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            elif tag == b"ANIM" and len(body) >= 6:
                row["loops"] = struct.unpack_from("<H", body, 4)[0]
            elif tag == b"ANMF" and len(body) >= 16:
                row["frames"] += 1
                row["delays"].append(int.from_bytes(body[12:15], "little") / 1000)
            at += 8 + length + (length & 1)
    elif data[:2] == b"\xff\xd8":
        row["format"], at = "jpeg", 2
        while at + 9 <= len(data):
            if data[at] != 0xFF:
                break
            kind = data[at + 1]
            if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:
                at += 1 if kind == 0xFF else 2
                continue
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                row["height"], row["width"] = struct.unpack_from(">HH", data, at + 5)
                break
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    else:
        raise BadFile("no known picture")
    return [row]


# ISO base media

_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"dinf", b"mvex", b"moof", b"traf"}


def iso_boxes(data: bytes) -> list[dict]:
    """Every box with its place, size, depth and path; 64-bit and open sizes are read."""
    out: list[dict] = []

    def walk(at: int, stop: int, path: str, depth: int) -> None:
        _need(depth <= MOST_DEPTH, "boxes nest too deep")
        while at + 8 <= stop:
            size, tag = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1:
                _need(at + 16 <= stop, "cut long size")
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            elif size == 0:
                size = stop - at
            _need(size >= head, "box smaller than its header")
            name = tag.decode("latin-1")
            out.append({"pos": len(out), "type": name, "offset": at, "size": size, "depth": depth, "path": f"{path}/{name}", "whole": at + size <= stop})
            _need(len(out) <= MOST_TAGS, "too many boxes")
            if tag in _CONTAINERS:
                walk(at + head, min(at + size, stop), f"{path}/{name}", depth + 1)
            at += size

    walk(0, len(data), "", 0)
    _need(bool(out), "no boxes")
    return out


def movie_seconds(data: bytes) -> float | None:
    """The duration that the movie header declares."""
    for box in iso_boxes(data):
        if box["path"] == "/moov/mvhd":
            at = box["offset"] + 8
            _need(at < len(data), "cut movie header")
            form = ">IQ" if data[at] == 1 else ">II"
            _need(at + (32 if data[at] == 1 else 20) <= len(data), "cut movie header")
            scale, length = struct.unpack_from(form, data, at + (20 if data[at] == 1 else 12))
            return length / scale if scale else None
    return None


# ID3


def _unsync(b: bytes) -> bytes:
    return b.replace(b"\xff\x00", b"\xff")


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


# What a picture is for by its type; any other is a thumbnail.
PICTURE_ROLES = {3: "cover", 8: "poster", 11: "banner", 18: "poster"}
_ID3_CODES = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _cut(code: int, data: bytes) -> tuple[str, bytes]:
    """A text up to its end mark, and what follows."""
    wide, at = code in (1, 2), 0
    while wide and at + 1 < len(data) and data[at : at + 2] != b"\0\0":
        at += 2
    if not wide:
        at = data.find(b"\0")
        at = len(data) if at < 0 else at
    return data[:at].decode(_ID3_CODES.get(code, "latin-1"), "replace"), data[at + 1 + wide :]


def _frame(name: bytes, payload: bytes) -> dict:
    """Text, description, picture and its role of a frame, as far as its kind has them."""
    row = {"text": None, "description": None, "language": None, "picture": None, "role": None}
    code, rest = payload[0] if payload else 0, payload[1:]
    decode = lambda b: b.decode(_ID3_CODES.get(code, "latin-1"), "replace").rstrip("\0")
    if name in (b"TXXX", b"TXX"):
        row["description"], rest = _cut(code, rest)
        row["text"] = decode(rest)
    elif name[:1] == b"T" and payload:
        row["text"] = decode(rest)
    elif name in (b"COMM", b"COM", b"USLT", b"ULT") and len(payload) >= 4:
        row["language"] = rest[:3].decode("latin-1")
        row["description"], rest = _cut(code, rest[3:])
        row["text"] = decode(rest)
    elif name == b"APIC" or name == b"PIC" and len(payload) > 5:
        rest = _cut(0, rest)[1] if name == b"APIC" else rest[3:]
        row["role"] = PICTURE_ROLES.get(rest[0], "thumbnail") if rest else None
        row["description"], row["picture"] = _cut(code, rest[1:])
    return row


def id3_frames(data: bytes) -> list[dict]:
    """Frames of an ID3 tag of version 2.2, 2.3 or 2.4; texts, comments, fields of their own and pictures decoded."""
    _need(data[:3] == b"ID3" and len(data) >= 10, "no ID3 tag")
    version, flags = data[3], data[5]
    _need(version in (2, 3, 4), f"version 2.{version} is not read")
    body = data[10 : 10 + _syncsafe(data[6:10])]
    if flags & 0x80 and version < 4:
        body = _unsync(body)
    at = 0
    if flags & 0x40 and version >= 3 and len(body) >= 4:
        at = _syncsafe(body[:4]) if version == 4 else 4 + struct.unpack_from(">I", body)[0]
    out, head = [], 6 if version == 2 else 10
    while at + head <= len(body) and body[at]:
        if version == 2:
            name, size, bits = body[at : at + 3], int.from_bytes(body[at + 3 : at + 6], "big"), 0
        else:
            name, raw, bits = body[at : at + 4], body[at + 4 : at + 8], body[at + 9]
            size = _syncsafe(raw) if version == 4 else struct.unpack(">I", raw)[0]
        if not name.isalnum():
            break
        payload = body[at + head : at + head + size]
        _need(len(payload) == size, f"frame {name.decode('latin-1')} runs past the tag")
        if version == 4 and (bits & 0x02 or flags & 0x80):
            payload = _unsync(payload)
        out.append({"pos": len(out), "frame": name.decode("latin-1"), "size": size, **_frame(name, payload), "payload": payload})
        at += head + size
    return out


# Flash


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int, signed: bool = False) -> int:
        _need(self.at + n <= 8 * len(self.data), "cut bit field")
        value = 0
        for i in range(self.at, self.at + n):
            value = value << 1 | self.data[i >> 3] >> (7 - (i & 7)) & 1
        self.at += n
        return value - (1 << n) if signed and n and value >> (n - 1) else value


def _swf_body(data: bytes) -> tuple[str, int, bytes]:
    _need(len(data) >= 8 and data[:3] in (b"FWS", b"CWS", b"ZWS"), "no Flash file")
    size = struct.unpack_from("<I", data, 4)[0]
    if data[:1] == b"F":
        return "none", data[3], data[8:]
    if data[:1] == b"C":
        return "zlib", data[3], inflate(data[8:], max(size - 8, 0))
    import lzma

    try:
        machine = lzma.LZMADecompressor(lzma.FORMAT_ALONE)
        return "lzma", data[3], machine.decompress(data[12:17] + b"\xff" * 8 + data[17:], max_length=min(max(size - 8, 0), MOST_INFLATED))
    except lzma.LZMAError as e:
        raise BadFile(f"bad LZMA data: {e}") from None


def swf_header(data: bytes) -> list[dict]:
    """One row: compression, version, stage in twips, rate and frames."""
    kind, version, body = _swf_body(data)
    bits = _Bits(body[:64])
    n = bits.take(5)
    x0, x1, y0, y1 = (bits.take(n, True) for _ in range(4))
    at = -(-bits.at // 8)
    _need(at + 4 <= len(body), "cut header")
    return [{"compression": kind, "version": version, "width_twips": x1 - x0, "height_twips": y1 - y0, "fps": struct.unpack_from("<H", body, at)[0] / 256, "frames": struct.unpack_from("<H", body, at + 2)[0]}]


def swf_tags(data: bytes) -> list[dict]:
    """Tags depth first: code, length, depth and the sprites that they are in."""
    _, _, body = _swf_body(data)
    bits = _Bits(body[:64])
    start = -(-(5 + 4 * bits.take(5)) // 8) + 4
    out: list[dict] = []

    def walk(at: int, stop: int, sprites: list[int]) -> None:
        _need(len(sprites) <= MOST_DEPTH, "sprites nest too deep")
        while at + 2 <= stop:
            head = struct.unpack_from("<H", body, at)[0]
            code, length, at = head >> 6, head & 63, at + 2
            if length == 63:
                _need(at + 4 <= stop, "cut tag length")
                length, at = struct.unpack_from("<I", body, at)[0], at + 4
            _need(at + length <= stop, f"tag {code} runs past its stream")
            out.append({"pos": len(out), "code": code, "length": length, "depth": len(sprites), "sprite_path": list(sprites), "offset": at})
            _need(len(out) <= MOST_TAGS, "too many tags")
            if code == 0:
                return
            if code == 39 and length >= 4:
                walk(at + 4, at + length, [*sprites, struct.unpack_from("<H", body, at)[0]])
            at += length

    walk(start, len(body), [])
    return out


# Subtitles

_TIME = re.compile(r"(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[,.](\d{1,3}))?$")
#: A tag or time in angle brackets, a block of overrides, or a character reference; each is short.
_MARK = re.compile(r"<\s*(?:(/?)\s*([^\W\d_]+)[^>]{0,250}|[0-9:.]+\s*)>|\{\\([^}]{0,255})\}|&(#[xX]?[0-9a-fA-F]{1,9}|\w{1,11});")
#: Style bits, and the tags that they are written as.
_STYLES = {"b": 1, "i": 2, "u": 4}
# Named character references of subtitles.
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "lrm": "‎", "rlm": "‏"}


def decode_text(data: bytes) -> str:
    """Subtitle bytes as text: byte-order marks, then zero bytes, UTF-8, and the Western code page."""
    for mark, code in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(code, "replace")
    head = data[:4096]
    even, odd = head[::2].count(0), head[1::2].count(0)
    if max(even, odd) > len(head) // 8:
        return data.decode("utf-16-be" if even > odd else "utf-16-le", "replace")
    for code in ("utf-8", "cp1252"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def _seconds(text: str) -> float | None:
    m = _TIME.match(text.strip())
    if not m or int(m[2]) > 59 or int(m[3]) > 59:
        return None
    return int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3]) + int((m[4] or "0").ljust(3, "0")) / 1000


def strip_markup(text: str) -> tuple[str, list[dict]]:
    """Text without tags, and its style runs in characters: disjoint, in order, each with the bits of all its styles.

    Tags nest by count, overrides set a style on or off, and a style that is not
    closed ends with the text. Spaces at line ends and blank lines go, and the
    runs move with the text.
    """
    depth, out, marked, at = dict.fromkeys(_STYLES, 0), [], [], 0

    def add(piece: str) -> None:
        out.append(piece)
        marked.extend([sum(bit for name, bit in _STYLES.items() if depth[name])] * len(piece))

    for m in _MARK.finditer(text):
        add(text[at : m.start()])
        at = m.end()
        if m[2] and m[2].lower() in depth:
            name = m[2].lower()
            depth[name] = max(0, depth[name] + (-1 if m[1] else 1))
        elif m[3]:
            for word in m[3].split("\\"):
                if len(word) == 2 and word[0] in depth and word[1] in "01":
                    depth[word[0]] = int(word[1])
        elif m[4]:
            add(_entity(m))
    add(text[at:])
    whole = "".join(out)
    keep = [True] * len(whole)
    for m in re.finditer(r"[ \t]+(?=\n|$)|^\s+|\s+$", whole):
        keep[m.start() : m.end()] = [False] * (m.end() - m.start())
    line_ended = False
    for i, c in enumerate(whole):
        if keep[i]:
            keep[i] = c != "\n" or not line_ended
            line_ended = c == "\n"
    shown = [(c, style) for c, style, k in zip(whole, marked, keep) if k]
    runs: list[dict] = []
    for i, (_, style) in enumerate(shown):
        if style and runs and runs[-1]["hi"] == i and runs[-1]["style"] == style:
            runs[-1]["hi"] = i + 1
        elif style:
            runs.append({"lo": i, "hi": i + 1, "style": style})
    return "".join(c for c, _ in shown), runs


def _entity(m: re.Match) -> str:
    name = m[4]
    if not name.startswith("#"):
        return _ENTITIES.get(name, m[0])
    digits, base = (name[2:], 16) if name[1:2] in ("x", "X") else (name[1:], 10)
    try:
        code = int(digits, base)
    except ValueError:
        return m[0]
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


def subtitle_format(text: str) -> str:
    """``vtt`` for a text that opens with the WebVTT header, else ``srt``."""
    return "vtt" if re.match(r"WEBVTT(?:[ \t\n]|$)", text.lstrip("\ufeff")) else "srt"


def subtitle_cues(data: bytes, strict: bool = False) -> list[dict]:
    """Cues of SubRip or WebVTT in order of their start: start, end, text and style runs.

    A cue's text ends at a blank line, at the next timing line, or at the number
    (in WebVTT any line) right above it. Bad cues are passed over unless ``strict``.
    """
    _need(len(data) <= MOST_SUBTITLE, "subtitles too large")
    text = decode_text(data).replace("\r\n", "\n").replace("\r", "\n")
    vtt, lines = subtitle_format(text) == "vtt", text.split("\n")
    timed = ["-->" in line for line in lines] + [False]
    blank = [not line.strip(" \t\ufeff") for line in lines]
    out, k = [], 0
    while k < len(lines):
        if blank[k]:
            k += 1
        elif not timed[k] and not timed[k + 1] or vtt and not timed[k] and re.match(r"(NOTE|STYLE|REGION)(?:[ \t]|$)", lines[k]):
            known = vtt and (k == 0 or re.match(r"(NOTE|STYLE|REGION)(?:[ \t]|$)", lines[k]))
            _need(known or not strict, f"text outside a cue in line {k + 1}")
            while k < len(lines) and not blank[k] and not (vtt and timed[k] and k):
                k += 1
        else:
            k += not timed[k]
            at, body = k, []
            left, right = lines[k].split("-->", 1)
            start, end = _seconds(left), _seconds((right.split() or [""])[0])
            k += 1
            while k < len(lines) and not blank[k] and not timed[k] and not (timed[k + 1] and (vtt or re.fullmatch(r"\s*[0-9]+\s*", lines[k]))):
                body.append(lines[k].strip())
                k += 1
            raw = "\n".join(body)
            fine = start is not None and end is not None and end > start and len(raw.encode("utf-8", "replace")) <= MOST_CUE
            _need(fine or not strict, f"bad cue in line {at + 1}")
            shown, runs = strip_markup(raw) if fine else ("", [])
            if shown:
                out.append({"start": start, "end": end, "text": shown, "runs": runs})
    out.sort(key=lambda c: c["start"])
    return [{"pos": i, **c} for i, c in enumerate(out)]


def render_markup(text: str, runs: list[dict], escape: bool = False) -> str:
    """Text with tags around its style runs, the inverse of ``strip_markup``; of runs that overlap the earlier keeps the text."""
    plain = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") if escape else s
    out, at = [], 0
    for run in sorted(runs, key=lambda r: r["lo"]):
        lo = max(at, min(run["lo"], len(text)))
        hi = max(lo, min(run["hi"], len(text)))
        if hi > lo:
            tags = [name for name, bit in _STYLES.items() if run["style"] & bit]
            out += [plain(text[at:lo]), *(f"<{t}>" for t in tags), plain(text[lo:hi]), *(f"</{t}>" for t in reversed(tags))]
            at = hi
    return "".join([*out, plain(text[at:])])


def timed_text(data: bytes) -> list[dict]:
    """A tx3g sample: its text and style runs, cut to the text."""
    _need(len(data) >= 2, "cut sample")
    n = struct.unpack_from(">H", data)[0]
    raw = data[2 : 2 + n]
    _need(len(raw) == n, "text runs past the sample")
    text = raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("utf-8", "replace")
    runs, at = [], 2 + n
    while at + 8 <= len(data):
        size, tag = struct.unpack_from(">I4s", data, at)
        _need(size >= 8, "bad box in sample")
        if tag == b"styl" and at + 10 <= len(data):
            for i in range(struct.unpack_from(">H", data, at + 8)[0]):
                p = at + 10 + 12 * i
                if p + 12 > len(data):
                    break
                lo, hi, _, face = struct.unpack_from(">HHHB", data, p)
                if face & 7 and min(hi, len(text)) > lo:
                    runs.append({"lo": lo, "hi": min(hi, len(text)), "style": face & 7})
        at += size
    return [{"text": text, "runs": runs}]


# Packages


def package_metadata(data: bytes) -> list[dict]:
    """Header fields up to the first blank line, one row each; continuation lines are joined."""
    out: list[dict] = []
    for line in data.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if not line:
            break
        if line[0] in " \t":
            _need(bool(out), "continuation before any field")
            out[-1]["value"] += "\n" + line.strip()
        else:
            name, colon, value = line.partition(":")
            _need(bool(colon), f"no field in {line[:40]!r}")
            out.append({"pos": len(out), "field": name.strip().lower(), "value": value.strip()})
    return out


def movie_lengths(data: bytes) -> list[dict]:
    """One row: the seconds that the movie header declares, null without one."""
    return [{"seconds": movie_seconds(data)}]


#: Parser name -> (function, columns of a row).
PARSERS = {
    "movie_lengths": (movie_lengths, "seconds double"),
    "zip_entries": (zip_entries, "pos int, name string, is_dir boolean, method int, encrypted boolean, crc32 long, compressed long, size long, external_attrs long, offset long"),
    "wav_info": (wav_info, "codec string, channels int, rate int, bits int, seconds double"),
    "image_info": (image_info, "format string, width int, height int, frames int, delays array<double>, loops int"),
    "iso_boxes": (iso_boxes, "pos int, type string, offset long, size long, depth int, path string, whole boolean"),
    "id3_frames": (id3_frames, "pos int, frame string, size int, text string, description string, language string, picture binary, role string, payload binary"),
    "swf_header": (swf_header, "compression string, version int, width_twips int, height_twips int, fps double, frames int"),
    "swf_tags": (swf_tags, "pos int, code int, length long, depth int, sprite_path array<int>, offset long"),
    "subtitle_cues": (subtitle_cues, "pos int, start double, end double, text string, runs array<struct<lo:int,hi:int,style:int>>"),
    "timed_text": (timed_text, "text string, runs array<struct<lo:int,hi:int,style:int>>"),
    "package_metadata": (package_metadata, "pos int, field string, value string"),
}
