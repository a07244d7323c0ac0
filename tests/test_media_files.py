"""ISO media, documents, animations and Flash extraction on bytes made here."""

import io
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from spoolframe.sources import containers as C
from spoolframe.sources import documents as D
from spoolframe.sources import files
from spoolframe.sources import movies as M


def movie(samples, code="tx3g", handler=b"sbtl", scale=1000, wide=False, refs=b"", user=b"", last=True, entry=b""):
    """A film of one track whose samples (payload, duration) lie in one chunk."""
    media = b"".join(p for p, _ in samples)
    offset = 20 if last else 0
    stbl = M.box("stbl", M.box("stsd", struct.pack(">II", 0, 1), M.box(code, b"\0" * 6 + b"\0\1" + (entry or b"\0" * 30))), M.box("stts", struct.pack(">II", 0, len(samples)), *(struct.pack(">II", 1, d) for _, d in samples)),
        M.box("stsc", struct.pack(">IIIII", 0, 1, 1, len(samples), 1)), M.box("stsz", struct.pack(">III", 0, 0, len(samples)), *(struct.pack(">I", len(p)) for p, _ in samples)), M.box("co64" if wide else "stco", struct.pack(">II", 0, 1), struct.pack(">Q" if wide else ">I", offset)))
    mdia = M.box("mdia", M.box("mdhd", b"\0" * 12, struct.pack(">IIHH", scale, sum(d for _, d in samples), 0x15C7, 0)), M.box("hdlr", b"\0" * 8, handler, b"\0" * 13), M.box("minf", stbl))
    tkhd = M.box("tkhd", struct.pack(">I", 1), b"\0" * 8, struct.pack(">I", 7), b"\0" * 60, struct.pack(">II", 640 << 16, 360 << 16))
    moov = M.box("moov", M.box("mvhd", b"\0" * 12, struct.pack(">II", scale, 1), b"\0" * 80), M.box("trak", tkhd, refs, mdia), user)
    head = M.box("ftyp", b"isom")
    if last:
        return head + M.box("mdat", media) + moov
    data = head + moov + M.box("mdat", media)
    at = data.index(b"co64" if wide else b"stco") + 12
    return data[:at] + struct.pack(">Q" if wide else ">I", len(head) + len(moov) + 8) + data[at + (8 if wide else 4) :]


def tx3g(text):
    return struct.pack(">H", len(text.encode())) + text.encode()


def test_tracks_and_cues():
    data = movie([(tx3g("one"), 1000), (tx3g("one"), 500), (b"\0\0", 100), (tx3g("two é"), 400)])
    row = M.movie_tracks(data)[0]
    assert (row["kind"], row["code"], row["seconds"], row["language"], row["samples"], row["track_id"]) == ("subtitle", "tx3g", 2.0, "eng", 4, 7)
    assert [(c["start"], c["end"], c["text"]) for c in M.movie_cues(data)] == [(0.0, 1.5, "one"), (1.6, 2.0, "two é")]
    vtt = M.box("vttc", M.box("payl", b"<b>a</b>")) + M.box("vttc", M.box("payl", b"b"))
    cue = M.movie_cues(movie([(vtt, 1000), (M.box("vtte"), 1000)], "wvtt"))
    assert [(c["text"], c["runs"]) for c in cue] == [("a\nb", [{"lo": 0, "hi": 1, "style": 1}])]
    sound = movie([(b"xx", 480), (b"yyyy", 480)], "mp4a", b"soun", 48000, entry=b"\0" * 8 + struct.pack(">HHII", 2, 16, 0, 48000 << 16))
    got = M.movie_tracks(sound)[0]
    assert (got["kind"], got["rate"], got["channels"], got["bytes"], got["seconds"]) == ("audio", 48000.0, 2, 6, 0.02)
    film = M.movie_tracks(movie([(b"x", 40)] * 25, "avc1", b"vide", entry=b"\0" * 16 + struct.pack(">HH", 320, 180) + b"\0" * 10))[0]
    assert (film["width"], film["height"], film["fps"]) == (320, 180, 25.0)


def test_chapters_of_a_track_and_of_a_list():
    refs = M.box("tref", M.box("chap", struct.pack(">I", 7)))
    data = movie([(tx3g("one"), 1000), (tx3g("two"), 3000)], "text", b"text", refs=refs)
    assert [(c["start"], c["seconds"], c["title"]) for c in M.movie_chapters(data)] == [(0.0, 1.0, "one"), (1.0, 3.0, "two")] and M.movie_cues(data) == []
    listed = M.box("udta", M.box("chpl", b"\0" * 5, b"\2", struct.pack(">QB", 20_000_000, 1), b"b", struct.pack(">QB", 0, 1), b"a"))
    assert [(c["start"], c["seconds"], c["title"]) for c in M.movie_chapters(movie([(b"\0\0", 5000)], user=listed))] == [(0.0, 2.0, "a"), (2.0, 3.0, "b")]


@pytest.mark.parametrize("last", [True, False])
@pytest.mark.parametrize("wide", [True, False])
def test_items_are_written_and_media_stay(last, wide):
    data = movie([(tx3g("one"), 1000), (tx3g("two"), 3000)], wide=wide, last=last, user=M.box("udta", M.box("chpl", b"\0" * 5, b"\0")))
    picture = b"\x89PNG\r\n\x1a\nrest"
    made = M.with_items(data, [("\xa9nam", "A title é"), ("trkn", "3/12"), ("stik", 9), ("covr", picture), ("----:com.example:mood", "calm")])
    items = {i["key"]: (i["text"], i["number"], i["payload"]) for i in M.movie_items(made)}
    assert items == {"\xa9nam": ("A title é", None, None), "trkn": ("3/12", 3, None), "stik": (None, 9, None), "covr": (None, None, picture), "----:com.example:mood": ("calm", None, None)}
    assert M.movie_cues(made) == M.movie_cues(data) and M.movie_tracks(made) == M.movie_tracks(data)
    again = M.with_items(made, [])
    assert M.movie_items(again) == [] and M.movie_cues(again) == M.movie_cues(data) and len(again) == len(data)
    with pytest.raises(C.BadFile):
        M.with_items(data + M.box("moof"), [])


def test_pdf():
    jpeg = b"\xff\xd8\xff\xc0\0\x0b\x08" + struct.pack(">HH", 9, 11) + b"\1\1\x11\0\xff\xd9"
    made = D.pdf_write([jpeg, jpeg])
    assert D.pdf_info(made)[0]["pages"] == 2 and b"/DeviceGray" in made and b"[0 0 11 9]" in made
    start = int(made.rsplit(b"startxref\n", 1)[1].split()[0])
    assert made[start : start + 4] == b"xref"
    for line, at in enumerate(int(x.split()[0]) for x in made[start:].split(b"\n")[3:-5] if x.endswith(b"n ")):
        assert made[at:].startswith(b"%d 0 obj" % (line + 1))
    packed = zlib.compress(b"5 0 6 60 " + b"<< /Title (in a (stream) \\)x) /Keywords <FEFF00E9> >>".ljust(60) + b"<< /Type /Page /Parent 2 0 R >>")
    streamed = b"%PDF-1.5\n1 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode >> stream\n" + packed + b"\nendstream endobj\ntrailer << >>"
    row = D.pdf_info(streamed)[0]
    assert (row["title"], row["keywords"], row["pages"], row["version"]) == ("in a (stream) )x", "é", 1, "1.5")
    with pytest.raises(C.BadFile):
        D.pdf_write([])


def test_books_and_members():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for n in ("p1.jpg", "__MACOSX/._p1.jpg", "ComicInfo.xml", "d/", "x.pdf", "d/p2.PNG"):
            z.writestr(n, n * 5)
    data = b.getvalue()
    assert D.book_info(data) == [{"kind": "cbz", "pages": 2, "excluded": 4}]
    assert {m["name"]: m["content"] for m in D.zip_members(data)}["d/p2.PNG"] == b"d/p2.PNG" * 5
    bad = bytearray(data)
    bad[data.index(b"p1.jpg") + 8] ^= 255
    assert [m["problem"] is None for m in D.zip_members(bytes(bad))].count(False) == 1


def lzw(data, size):
    """The indexes of a GIF picture's codes."""
    bits = int.from_bytes(data, "little")
    table, width, out, last, at = {}, size + 1, [], None, 0
    while True:
        code = bits >> at & (1 << width) - 1
        at += width
        if code == 1 << size:
            table, width, last = {i: [i] for i in range(1 << size)} | {1 << size: [], (1 << size) + 1: []}, size + 1, None
            continue
        if code == (1 << size) + 1:
            return out
        seq = table[code] if code in table else [*last, last[0]]
        out += seq
        if last is not None:
            table[len(table)] = [*last, seq[0]]
            if len(table) == 1 << width and width < 12:
                width += 1
        last = seq


def test_animations():
    rng = random.Random(3)
    frames = [bytes(rng.choice([0, 100, 255]) if i % 4 < 3 else 255 for i in range(4 * 40 * 30)) for _ in range(3)]
    png = D.apng_write(frames, 40, 30, [0.1, 0.25, 0.04], 2)
    assert C.image_info(png)[0] == {"format": "png", "width": 40, "height": 30, "frames": 3, "delays": [0.1, 0.25, 0.04], "loops": 2}
    gif = D.gif_write(frames, 40, 30, [0.1, 0.25, 0.04], 2)
    assert C.image_info(gif)[0] == {"format": "gif", "width": 40, "height": 30, "frames": 3, "delays": [0.1, 0.25, 0.04], "loops": 2}
    at = gif.index(b"\x2c" + struct.pack("<HHHH", 0, 0, 40, 30))
    palette, body, k = gif[at + 10 : at + 10 + 768], b"", at + 10 + 768 + 1
    while gif[k]:
        body += gif[k + 1 : k + 1 + gif[k]]
        k += 1 + gif[k]
    shown = b"".join(palette[3 * i : 3 * i + 3] + b"\xff" for i in lzw(body, 8))
    assert shown == frames[0]
    with pytest.raises(C.BadFile):
        D.gif_write(frames, 41, 30, [0.1] * 3)


def flash(tags):
    body = b"\x00" + struct.pack("<HH", 24 * 256, 3) + b"".join(struct.pack("<HI", code << 6 | 63, len(d)) + d for code, d in tags)
    return b"FWS" + bytes([8]) + struct.pack("<I", 8 + len(body)) + body


def test_flash_assets():
    jpeg = b"\xff\xd8SCAN\xff\xd9"
    pixels = struct.pack("<BHH", 5, 2, 1) + zlib.compress(bytes([0, 1, 2, 3, 0, 4, 5, 6]))
    block = struct.pack("<HH", 576, 0)
    data = flash([
        (8, b"\xff\xd9\xff\xd8\xff\xd8TT\xff\xd9"), (6, struct.pack("<H", 3) + jpeg), (21, struct.pack("<H", 3) + jpeg), (20, struct.pack("<H", 4) + pixels), (20, struct.pack("<H", 5) + b"bad"), (14, struct.pack("<HBI", 6, 0x3E, 2) + b"\1\2\3\4"), (14, struct.pack("<HBI", 7, 0x6E, 2) + b"zz"),
        (18, bytes([0, 0x2E, 0, 0])), (19, block + b"mp3a"), (19, block + b"mp3b"), (60, struct.pack("<HHHHBB", 8, 1, 2, 3, 0, 4)), (87, struct.pack("<HI", 9, 0) + b"payload"), (0, b""),
    ])
    got = [(r["name"], r["kind"], r["reason"]) for r in D.swf_assets(data)]
    assert got == [("character-00003.jpg", "picture", None), ("character-00003-2.jpg", "picture", None), ("character-00004.png", "picture", None), (None, None, "malformed"), ("character-00006.wav", "sound", None), (None, None, "codec"), (None, None, "codec"), ("binary-00009.bin", "binary", None), ("soundtrack-main.mp3", "soundtrack", None)]
    content = {r["name"]: r["content"] for r in D.swf_assets(data)}
    assert content["character-00003.jpg"] == b"\xff\xd8TTSCAN\xff\xd9" and content["soundtrack-main.mp3"] == b"mp3amp3b" and C.wav_info(content["character-00006.wav"])[0]["channels"] == 1


def seeds():
    jpeg = b"\xff\xd8\xff\xc0\0\x0b\x08" + struct.pack(">HH", 9, 11) + b"\1\1\x11\0\xff\xd9"
    film = movie([(tx3g("one"), 1000), (tx3g("two"), 3000)], refs=M.box("tref", M.box("chap", struct.pack(">I", 7))))
    return [film, M.with_items(film, [("\xa9nam", "t"), ("trkn", "1/2")]), movie([(M.box("vttc", M.box("payl", b"x")), 5)], "wvtt"), D.pdf_write([jpeg]), flash([(18, bytes([0, 0x2E, 0, 0])), (19, b"0000abc"), (20, b"\4\0" + struct.pack("<BHH", 3, 2, 1) + b"\1" + zlib.compress(bytes(10))), (0, b"")]), C.zip_write([("a.jpg", b"1"), ("b", b"2")]), b"ID3\3\0\0\0\0\0\x15APIC\0\0\0\x0b\0\0\3image/p\0\3\0"]


@pytest.mark.parametrize("name", sorted(files.PARSERS))
def test_mutations_end_as_rows_or_errors(name):
    """Bits flipped and tails cut, as hostile files have them: a row or an error that ``parse`` makes a row of, never more."""
    rng = random.Random(0x5EED)
    function = files.PARSERS[name][0]
    for seed in seeds():
        for k in range(120):
            data = bytearray(seed)
            for _ in range(rng.randint(0, 6)):
                data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
            cut = bytes(data[: rng.randint(0, len(data))] if k % 2 else data)
            try:
                function(cut)
            except files.UNREADABLE:
                pass


def test_bad_files_are_rows(spark):
    """Errors that are no ``BadFile``, and values that a column cannot hold, end as the row's error."""
    wide = C.zip_write([("a", b"1")])
    at = wide.index(b"PK\1\2")
    extra = struct.pack("<HH", 1, 60) + b"\0" * 4
    broken = wide[: at + 20] + b"\xff" * 4 + wide[at + 24 : at + 30] + struct.pack("<H", len(extra)) + wide[at + 32 : at + 47] + extra + wide[at + 47 :]
    end = broken.index(b"PK\5\6")
    broken = broken[: end + 12] + struct.pack("<I", end - at) + broken[end + 16 :]
    cut = M.box("moov", M.box("mvhd"))
    rows = spark.createDataFrame([(1, broken), (2, wide), (3, None)], "id int, content binary")
    got = {r.id: (r.name, r.error) for r in files.parse(rows, "zip_entries", ["id"]).collect()}
    assert set(got) == {1, 2, 3} and got[2] == ("a", None) and got[3][1] == "no bytes"
    one = files.parse(spark.createDataFrame([(1, cut), (2, b"\0\0\0\1mdat" + b"\xff" * 8)], "id int, content binary"), "movie_lengths", ["id"]).collect()
    assert {r.id: (r.seconds, r.error is None) for r in one} == {1: (None, False), 2: (None, True)}  # the second has no header to read
    big = struct.pack(">I4sII", 16, b"tkhd", 0, 0)
    assert files.parse(spark.createDataFrame([(1, big)], "id int, content binary"), "movie_tracks", ["id"]).first().error


def test_files_of_rows(spark):
    film = movie([(tx3g("one"), 1000)])
    rows = spark.createDataFrame([(1, film, [("\xa9nam", "x")]), (2, b"no", [("\xa9nam", "x")]), (3, None, []), (4, film, None)], "id int, content binary, items array<struct<key:string,value:string>>")
    got = {r.id: r.tagged for r in files.tagged(rows, "content", "items").collect()}
    assert M.movie_items(bytes(got[1].content))[0]["text"] == "x" and got[2].content is None and got[2].error and got[3].error == "no bytes" and got[4].error is None
    frames = spark.createDataFrame([("a", 0, b"\1\2\3\4", 1, 1, 0.5), ("b", 0, b"\1", 1, 1, 0.5)], "k string, pos int, rgba binary, w int, h int, d double")
    made = {r.k: (r.content, r.error) for r in files.animations(frames, "k", "pos", "rgba", "w", "h", "d", "gif").collect()}
    assert made["a"][1] is None and made["b"][0] is None and made["b"][1]
    waves = spark.createDataFrame([(1, b"12", 8000, 1, 8), (2, None, 8000, 1, 8), (3, b"12", 8000, 0, 8)], "id int, pcm binary, rate int, channels int, bits int")
    assert {r.id: r.wave is not None for r in files.waves(waves, "pcm", "rate", "channels", "bits").collect()} == {1: True, 2: False, 3: False}


def test_prefix_sums(spark):
    from spoolframe.functions.arrays import prefix_sums

    rows = spark.createDataFrame([(1, list(range(1000))), (2, [])], "id int, n array<int>").select("id", prefix_sums(F.col("n")).alias("s")).collect()
    assert {r.id: r.s for r in rows} == {1: [i * (i + 1) // 2 for i in range(1000)], 2: []}


@pytest.mark.parametrize("name", ["movie_retagged", "pdf_facts", "movie_lengths", "flash_assets", "movie_items", "flash_headers", "movie_tracks", "movie_cues", "id3_extras", "picture_kernels", "flash_pictures", "movie_chapters", "pdf_pages", "flash_manifest", "movie_samples", "similarity_scores", "subtitle_times", "image_headers", "package_fields", "book_pages", "animated_png"])
def test_narrow_rows_are_dealt_to_all_tasks(spark, data, name):
    """A packed table is one or two tasks where it is read; the work on its rows is done in all of them, once; ID3 extras take two passes."""
    from spoolframe.plans.catalog import QUERIES

    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == (2 if name == "id3_extras" else 1)


def test_several_parsers_in_one_pass(spark):
    """As one after another; null bytes and bytes that are no movie have their reasons for each parser."""
    from spoolframe.plans import recordings
    from spoolframe.sources import files

    names = ["movie_items", "movie_cues", "movie_chapters"]
    bad = spark.createDataFrame([(-1, None), (-2, bytearray(b"none")), (-3, bytearray(b"\0\0\0\x0cmoov\0\0\0\x09"))], "p_partkey long, content binary")
    made = recordings._movies(spark, "/root/testdata/sf0.001").select("p_partkey", "content").unionByName(bad)
    got = files.parse_each(made, names, ["p_partkey"])
    for name in names:
        one = files.parse(made, name, ["p_partkey"])
        assert sorted(map(str, one.collect())) == sorted(map(str, got.where(F.col("parser") == name).select(*one.columns).collect()))


def test_one_bad_value_is_its_own_row(spark, monkeypatch):
    """Rows are put together by the batch; a value that its column cannot hold takes no other file's rows along."""
    from spoolframe.sources import files

    def size(data):
        return [{"size": 1 << 40 if data == b"big" else len(data)}]

    monkeypatch.setitem(files.PARSERS, "size", (size, "size int"))
    rows = spark.createDataFrame([(i, bytearray(b"big" if i == 5 else b"x" * i)) for i in range(10)], "id int, content binary").coalesce(1)
    got = {r.id: (r.size, r.error) for r in files.parse(rows, "size", ["id"]).collect()}
    assert len(got) == 10 and got.pop(5)[1] and all(v == (k, None) for k, v in got.items())
