"""Documents, animations and Flash files: PDF facts, pictures as PDF pages, animated PNG and GIF, and media out of Flash."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

from ..functions.flash import SOUND_RATES, _png, raster
from .containers import BadFile, _need, _swf_body, image_info, swf_tags, wav_write, zip_entries, zip_member

# PDF

#: Most bytes that a stream of objects may inflate to.
MOST_OBJECTS = 64 << 20
_PLAIN = re.compile(rb"[^\\()]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_text(raw: bytes) -> str:
    """A PDF string: UTF-16 after its mark, else Latin."""
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    return raw[3:].decode("utf-8", "replace") if raw[:3] == b"\xef\xbb\xbf" else raw.decode("latin-1")


def _pdf_value(raw: bytes, at: int) -> bytes | None:
    """The bytes of the string, in brackets or hex, that starts after a key; null if no string does."""
    while at < len(raw) and raw[at : at + 1].isspace():
        at += 1
    if raw[at : at + 1] == b"(":
        out, depth, at = bytearray(), 1, at + 1
        while at < len(raw):
            if plain := _PLAIN.match(raw, at):
                out += plain[0]
                at = plain.end()
                continue
            c = raw[at : at + 1]
            if c == b"\\":
                octal = re.match(rb"[0-7]{1,3}", raw[at + 1 : at + 4])
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    at += 1 + len(octal[0])
                    continue
                out += _ESCAPES.get(raw[at + 1 : at + 2], raw[at + 1 : at + 2])
                at += 2
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                return bytes(out)
            out += c
            at += 1
        return None
    m = re.match(rb"<([0-9A-Fa-f\s]*)>", raw[at:])
    if m:
        digits = re.sub(rb"\s", b"", m[1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return None


def _pdf_objects(data: bytes) -> list[bytes]:
    """Bodies of the objects: those in the file, and those in streams of objects, which are inflated."""
    bodies, room = [], MOST_OBJECTS
    for m in re.finditer(rb"\b\d+\s+\d+\s+obj\b", data):
        stop = data.find(b"endobj", m.end())
        body = data[m.end() : stop if stop >= 0 else len(data)]
        cut = body.find(b"stream")
        head = body if cut < 0 else body[:cut]
        bodies.append(head)
        if cut >= 0 and re.search(rb"/Type\s*/ObjStm\b", head) and b"FlateDecode" in head and room > 0:
            at = cut + 6 + (2 if body[cut + 6 : cut + 8] == b"\r\n" else 1)
            try:
                inside = zlib.decompressobj().decompress(body[at:], room)
            except zlib.error as e:
                raise BadFile(f"bad stream of objects: {e}") from None
            room -= len(inside)
            first = re.search(rb"/First\s+(\d+)", head)
            places = [int(x) for x in re.findall(rb"\d+\s+(\d+)", inside[: int(first[1])])] if first else []
            base = int(first[1]) if first else 0
            bodies += [inside[base + a : base + b] for a, b in zip(places, [*places[1:], len(inside) - base])]
    return bodies


def pdf_info(data: bytes) -> list[dict]:
    """One row: version, pages, whether it is encrypted, and the document's own facts as text."""
    m = re.match(rb"\s*%PDF-(\d+\.\d+)", data[:1024])
    _need(m is not None, "no PDF file")
    bodies = _pdf_objects(data)
    counts = [int(c[1]) for b in bodies if re.search(rb"/Type\s*/Pages\b", b) and (c := re.search(rb"/Count\s+(\d+)", b)) and not re.search(rb"/Parent\b", b)]
    pages = sum(bool(re.search(rb"/Type\s*/Page\b(?!s)", b)) for b in bodies)
    row = {"version": m[1].decode(), "pages": max(counts, default=pages) or pages, "encrypted": bool(re.search(rb"/Encrypt\s+\d+\s+\d+\s+R|/Encrypt\s*<<", data))}
    facts = [b for b in bodies if not re.search(rb"/Type\b", b)]
    for name in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate"):
        value = None
        for body in facts:
            if k := re.search(rb"/" + name.encode() + rb"(?=[\s(<])", body):
                value = _pdf_value(body, k.end()) or value
        row[re.sub("(?<=[a-z])(?=[A-Z])", "_", name).lower()] = None if value is None or row["encrypted"] else _pdf_text(value)
    return [row]


def pdf_write(pictures: list[bytes]) -> bytes:
    """JPEG and eight-bit RGB or grey PNG pictures as the pages of a PDF, a point a pixel; the same pictures give the same bytes."""
    _need(bool(pictures), "no picture for a page")
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []

    def put(number: int, body: bytes) -> None:
        places.append((number, len(out)))
        out.extend(b"%d 0 obj\n" % number + body + b"\nendobj\n")

    put(1, b"<< /Type /Catalog /Pages 2 0 R >>")
    kids = b" ".join(b"%d 0 R" % (3 + 3 * i) for i in range(len(pictures)))
    put(2, b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(pictures)))
    for i, picture in enumerate(pictures):
        info = image_info(picture)[0]
        w, h, n = info["width"], info["height"], 3 + 3 * i
        _need(bool(w and h), "a picture without size")
        if info["format"] == "jpeg":
            frame = re.search(rb"\xff[\xc0-\xc3]..(.)....(.)", picture, re.S)
            space = {1: b"/DeviceGray", 3: b"/DeviceRGB", 4: b"/DeviceCMYK"}.get(frame[2][0] if frame else 3, b"/DeviceRGB")
            kind, content = b"/ColorSpace %s /BitsPerComponent 8 /Filter /DCTDecode" % space, picture
        elif info["format"] == "png" and picture[24:26] in (b"\x08\x02", b"\x08\x00") and picture[28] == 0:
            parts, at = [], 8
            while at + 12 <= len(picture):
                size, tag = struct.unpack_from(">I4s", picture, at)
                parts += [picture[at + 8 : at + 8 + size]] * (tag == b"IDAT")
                at += 12 + size
            colours = 3 if picture[25] == 2 else 1
            content = b"".join(parts)
            kind = b"/ColorSpace %s /BitsPerComponent 8 /Filter /FlateDecode /DecodeParms << /Predictor 15 /Colors %d /Columns %d >>" % (b"/DeviceRGB" if colours == 3 else b"/DeviceGray", colours, w)
        else:
            raise BadFile(f"a {info['format']} picture of this kind cannot be a page as it is")
        put(n, b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /XObject << /P %d 0 R >> >> /Contents %d 0 R >>" % (w, h, n + 1, n + 2))
        put(n + 1, b"<< /Type /XObject /Subtype /Image /Width %d /Height %d %s /Length %d >>\nstream\n" % (w, h, kind, len(content)) + content + b"\nendstream")
        draw = b"q %d 0 0 %d 0 0 cm /P Do Q" % (w, h)
        put(n + 2, b"<< /Length %d >>\nstream\n" % len(draw) + draw + b"\nendstream")
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % at for _, at in sorted(places))
    out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, start)
    return bytes(out)


def book_info(data: bytes) -> list[dict]:
    """One row for a PDF or a ZIP of pictures: kind, pages, and entries that are no page."""
    if data[:1024].lstrip().startswith(b"%PDF-"):
        return [{"kind": "pdf", "pages": pdf_info(data)[0]["pages"], "excluded": 0}]
    _need(data[:2] == b"PK", "neither a PDF nor a ZIP")
    entries = zip_entries(data)
    pages = sum(is_page(e["name"]) and not e["is_dir"] for e in entries)
    return [{"kind": "cbz", "pages": pages, "excluded": len(entries) - pages}]


# Names that are no page, and extensions of pictures that are.
NO_PAGES = {"comicinfo.xml", ".ds_store", "thumbs.db", "desktop.ini"}
PAGE_EXTENSIONS = {"avif", "gif", "heic", "heics", "heif", "jp2", "jpeg", "jpg", "jxl", "png", "tif", "tiff", "webp"}


def is_page(name: str) -> bool:
    base = name.rsplit("/", 1)[-1]
    return "__MACOSX" not in name.split("/") and not base.startswith("._") and base.lower() not in NO_PAGES and "." in base and base.rsplit(".", 1)[-1].lower() in PAGE_EXTENSIONS


def zip_members(data: bytes) -> list[dict]:
    """Content of every member that is no folder; one that cannot be read has its reason instead."""
    out = []
    for entry in zip_entries(data):
        if entry["is_dir"]:
            continue
        try:
            content, problem = zip_member(data, entry), None
        except BadFile as e:
            content, problem = None, str(e)
        out.append({"pos": entry["pos"], "name": entry["name"], "content": content, "problem": problem})
    return out


# Animations


def _frames(rgba: list[bytes], width: int, height: int, delays: list[float]) -> list[np.ndarray]:
    _need(bool(rgba) and width > 0 and height > 0 and len(delays) == len(rgba), "frames, sizes and delays do not go together")
    _need(all(len(f) == 4 * width * height for f in rgba), "a frame is not as large as the canvas")
    return [np.frombuffer(f, np.uint8).reshape(height, width, 4) for f in rgba]


def apng_write(rgba: list[bytes], width: int, height: int, delays: list[float], loops: int = 0) -> bytes:
    """RGBA frames as an animated PNG; 0 loops go on for ever, delays are kept to the millisecond."""
    frames = _frames(rgba, width, height, delays)
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    out = [b"\x89PNG\r\n\x1a\n", chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)), chunk(b"acTL", struct.pack(">II", len(frames), loops))]
    number = 0
    for i, (frame, delay) in enumerate(zip(frames, delays)):
        out.append(chunk(b"fcTL", struct.pack(">IIIIIHHBB", number, width, height, 0, 0, min(65535, max(0, round(delay * 1000))), 1000, 0, 0)))
        lines = np.concatenate([np.zeros((height, 1), np.uint8), frame.reshape(height, -1)], axis=1).tobytes()
        body = zlib.compress(lines)
        out.append(chunk(b"IDAT", body) if i == 0 else chunk(b"fdAT", struct.pack(">I", number + 1) + body))
        number += 1 if i == 0 else 2
    return b"".join([*out, chunk(b"IEND", b"")])


def gif_write(rgba: list[bytes], width: int, height: int, delays: list[float], loops: int = 0) -> bytes:
    """RGBA frames as an animated GIF: a palette a frame, exact up to 255 colours, else the nearest of a cube of 6 x 7 x 6."""
    out = [b"GIF89a" + struct.pack("<HHBBB", width, height, 0x70, 0, 0), b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0"]
    for frame, delay in zip(_frames(rgba, width, height, delays), delays):
        seen = frame[..., 3] >= 128
        colours = frame[..., :3].astype(np.int64)
        names, code = np.unique((colours[..., 0] << 16 | colours[..., 1] << 8 | colours[..., 2])[seen], return_inverse=True)
        palette, index = np.zeros((256, 3), np.uint8), np.full((height, width), 255, np.uint8)
        if len(names) <= 255:
            palette[: len(names)] = np.stack([names >> 16, names >> 8 & 255, names & 255], axis=-1)
            index[seen] = code
        else:
            step = np.array([6, 7, 6])
            near = np.rint(colours * (step - 1) / 255).astype(np.int64)
            index[seen] = (near[..., 0] * 42 + near[..., 1] * 6 + near[..., 2])[seen]
            grid = np.stack(np.meshgrid(*(np.arange(s) for s in step), indexing="ij"), axis=-1).reshape(-1, 3)
            palette[:252] = np.rint(grid * 255 / (step - 1))
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 0x09, min(65535, round(delay * 100)), 255, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0x87) + palette.tobytes() + b"\x08")
        body = _plain_codes(index.ravel())
        out += [bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def _plain_codes(index: np.ndarray) -> bytes:
    """Nine-bit codes of single colours; a clear code every 254 keeps them nine bits wide."""
    parts = [np.concatenate([[256], index[i : i + 254].astype(np.int64)]) for i in range(0, len(index), 254)]
    codes = np.concatenate([*parts, [257]])
    bits = (codes[:, None] >> np.arange(9) & 1).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


# Flash

#: Codecs of sound that have a file of their own.
_SOUNDS = {0: "wav", 2: "mp3", 3: "wav"}


def _sound(flags: int) -> tuple[int, int, int, int]:
    """(codec, rate, bits, channels) of a sound's flag byte."""
    return flags >> 4, SOUND_RATES[flags >> 2 & 3], 16 if flags & 2 else 8, 1 + (flags & 1)


def swf_assets(data: bytes) -> list[dict]:
    """Media that a Flash file holds, a row each, in the order of the file: name, kind, content, and why a payload is left.

    Pictures with shared tables get them, lossless ones become PNG, PCM becomes
    WAV. The blocks of a timeline's streaming soundtrack are one sound, which
    comes after all others. A row without content says what was left and why.
    Names that would be taken twice get ``-2``, ``-3`` and so on.
    """
    _, _, body = _swf_body(data)
    out: list[dict] = []
    tables, used, heads, blocks = b"", set(), {}, {}

    def left(code: int, size: int, reason: str) -> None:
        out.append({"pos": len(out), "name": None, "kind": None, "code": code, "character": None, "content": None, "size": size, "reason": reason})

    def keep(base: str, ext: str, kind: str, code: int, character: int | None, content: bytes) -> None:
        name, n = f"{base}.{ext}", 2
        while name in used:
            name, n = f"{base}-{n}.{ext}", n + 1
        used.add(name)
        out.append({"pos": len(out), "name": name, "kind": kind, "code": code, "character": character, "content": content, "size": len(content), "reason": None})

    for tag in swf_tags(data):
        code, raw = tag["code"], body[tag["offset"] : tag["offset"] + tag["length"]]
        where = "sprite-" + "-".join(map(str, tag["sprite_path"])) if tag["sprite_path"] else "main"
        number = struct.unpack_from("<H", raw)[0] if len(raw) >= 2 else None
        if code == 8:
            tables = raw
        elif code in (6, 21, 35, 90) and number is not None:
            start = {6: 2, 21: 2, 35: 6, 90: 8}[code]
            size = struct.unpack_from("<I", raw, 2)[0] if code in (35, 90) and len(raw) >= start else len(raw) - start
            picture = raw[start : start + size]
            picture = picture[4:] if picture[:4] == b"\xff\xd9\xff\xd8" else picture
            if code == 6:
                shared = tables[4:] if tables[:4] == b"\xff\xd9\xff\xd8" else tables
                shared = shared[:-2] if shared[-2:] == b"\xff\xd9" else shared
                picture = shared + (picture[2:] if picture[:2] == b"\xff\xd8" and shared else picture)
            ext = "png" if picture[:4] == b"\x89PNG" else "gif" if picture[:4] == b"GIF8" else "jpg"
            if picture:
                keep(f"character-{number:05d}", ext, "picture", code, number, picture)
            else:
                left(code, len(raw), "malformed")
        elif code in (20, 36) and number is not None:
            pixels = raster(raw[2:], code == 36)
            if pixels is None:
                left(code, len(raw), "malformed")
            else:
                keep(f"character-{number:05d}", "png", "picture", code, number, _png(pixels))
        elif code == 14 and len(raw) >= 7:
            codec, rate, bits, channels = _sound(raw[2])
            sound = raw[9:] if codec == 2 else raw[7:]
            if codec not in _SOUNDS:
                left(code, len(raw), "codec")
            elif not sound:
                left(code, len(raw), "malformed")
            else:
                keep(f"character-{number:05d}", _SOUNDS[codec], "sound", code, number, sound if codec == 2 else wav_write(sound, rate, channels, bits))
        elif code in (18, 45) and len(raw) >= 4:
            heads.setdefault(where, raw[1])
        elif code == 19:
            if where not in heads:
                left(code, len(raw), "block without head")
            else:
                blocks.setdefault(where, []).append(raw[4:] if heads[where] >> 4 == 2 else raw)
        elif code == 60 and len(raw) >= 10:
            left(code, len(raw), "codec")
        elif code == 87 and len(raw) > 6:
            keep(f"binary-{number:05d}", "bin", "binary", code, number, raw[6:])
        elif code in (6, 14, 20, 21, 35, 36, 60, 87, 90):
            left(code, len(raw), "malformed")
    for where, flags in heads.items():
        codec, rate, bits, channels = _sound(flags)
        sound = b"".join(blocks.get(where, []))
        if sound and codec in _SOUNDS:
            keep(f"soundtrack-{where}", _SOUNDS[codec], "soundtrack", 19, None, sound if codec == 2 else wav_write(sound, rate, channels, bits))
        elif sound:
            left(19, len(sound), "codec")
    return out


#: Parser name -> (function, columns of a row).
PARSERS = {
    "pdf_info": (pdf_info, "version string, pages int, encrypted boolean, title string, author string, subject string, keywords string, creator string, producer string, creation_date string"),
    "book_info": (book_info, "kind string, pages int, excluded int"),
    "zip_members": (zip_members, "pos int, name string, content binary, problem string"),
    "swf_assets": (swf_assets, "pos int, name string, kind string, code int, character int, content binary, size long, reason string"),
}
