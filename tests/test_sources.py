import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from spoolframe.sources import containers as C
from spoolframe.sources import files, sinks


def archive(names, method=zipfile.ZIP_DEFLATED):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", method) as z:
        for n in names:
            z.writestr(n, n * 20)
    return b.getvalue()


def box(tag, body=b""):
    return struct.pack(">I4s", 8 + len(body), tag) + body


def flash(tags, packed=False):
    body = b"\x00" + struct.pack("<HH", 24 * 256, 3) + b"".join(struct.pack("<H", code << 6 | len(d)) + d if len(d) < 63 else struct.pack("<HI", code << 6 | 63, len(d)) + d for code, d in tags)
    return (b"CWS" if packed else b"FWS") + bytes([8]) + struct.pack("<I", 8 + len(body)) + (zlib.compress(body) if packed else body)


def id3():
    frame = b"TIT2" + struct.pack(">I", 6) + b"\0\0" + b"\x03title"
    return b"ID3\x03\0\0" + bytes([0, 0, 0, len(frame)]) + frame


def test_zip():
    data = archive(["a/p1.jpg", "a/", "ComicInfo.xml"])
    rows = C.zip_entries(data)
    assert [r["name"] for r in rows] == ["a/p1.jpg", "a/", "ComicInfo.xml"] and rows[1]["is_dir"]
    assert C.zip_member(data, rows[0]) == b"a/p1.jpg" * 20
    assert zlib.decompress(C.zip_raw(data, rows[0]), -15) == b"a/p1.jpg" * 20
    again = C.zip_write([("x.jpg", b"1"), ("y.jpg", b"22")])
    assert zipfile.ZipFile(io.BytesIO(again)).read("y.jpg") == b"22" and C.zip_entries(C.zip_write([])) == []


def test_sound():
    data = C.wav_write(b"\0" * 8820, 44100, 1)
    assert C.wav_info(data)[0] == {"codec": "pcm", "channels": 1, "rate": 44100, "bits": 16, "seconds": 0.1}
    assert len(C.wav_write(b"123", 8000, 1, 8)) == 48


def test_pictures():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBBI", 13, b"IHDR", 7, 5, 8, 6, 0, 0, 0, 0)
    assert (C.image_info(png)[0]["width"], C.image_info(png)[0]["height"]) == (7, 5)
    frame = b"\x21\xf9\x04\0" + struct.pack("<H", 25) + b"\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 3, 2, 0) + b"\x02\x01x\0"
    gif = b"GIF89a" + struct.pack("<HHBBB", 3, 2, 0, 0, 0) + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x05\0\0" + frame * 2 + b";"
    assert C.image_info(gif)[0] == {"format": "gif", "width": 3, "height": 2, "frames": 2, "delays": [0.25, 0.25], "loops": 5}
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08" + struct.pack(">HH", 9, 11) + b"\x01\0\0\0"
    assert (C.image_info(jpeg)[0]["width"], C.image_info(jpeg)[0]["height"]) == (11, 9)
    webp = b"RIFF\0\0\0\0WEBP" + b"VP8X" + struct.pack("<I", 10) + b"\0" * 4 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert C.image_info(webp)[0]["width"] == 100


def test_boxes():
    mvhd = box(b"mvhd", bytes(12) + struct.pack(">II", 1000, 2500) + bytes(80))
    data = box(b"ftyp", b"isom") + box(b"moov", mvhd) + box(b"mdat", b"xx")
    assert [r["path"] for r in C.iso_boxes(data)] == ["/ftyp", "/moov", "/moov/mvhd", "/mdat"] and C.movie_seconds(data) == 2.5


def test_tags():
    assert C.id3_frames(id3())[0]["text"] == "title"
    sprite = struct.pack("<HH", 5, 1) + struct.pack("<H", 1 << 6) + struct.pack("<H", 0)
    for packed in (False, True):
        data = flash([(9, b"abc"), (39, sprite), (21, b"z" * 70), (0, b"")], packed)
        assert [(r["code"], r["depth"]) for r in C.swf_tags(data)] == [(9, 0), (39, 0), (1, 1), (0, 1), (21, 0), (0, 0)]
        assert C.swf_header(data)[0]["fps"] == 24
    with pytest.raises(C.BadFile):
        C.swf_tags(flash([(9, b"abc")])[:-2])


SRT = "1\n00:00:01,000 --> 00:00:02,500\n<i>one</i> &amp; {\\b1}two{\\b0}\n\n2\n00:00:03,000 --> bad\nx\n\n3\n00:00:04,000 --> 00:00:05,000\nlast\n"


def test_subtitles():
    cues = C.subtitle_cues(SRT.encode())
    assert [(c["start"], c["text"]) for c in cues] == [(1.0, "one & two"), (4.0, "last")]
    assert cues[0]["runs"] == [{"lo": 0, "hi": 3, "style": 2}, {"lo": 6, "hi": 9, "style": 1}]
    with pytest.raises(C.BadFile):
        C.subtitle_cues(SRT.encode(), strict=True)
    assert C.subtitle_cues(SRT.encode("utf-16"))[1]["text"] == "last"
    assert C.strip_markup(C.render_markup("one & two", cues[0]["runs"], escape=True)) == ("one & two", cues[0]["runs"])
    sample = struct.pack(">H", 3) + b"abc" + box(b"styl", struct.pack(">H", 1) + struct.pack(">HHHBB4s", 1, 9, 0, 2, 12, b"\0" * 4))
    assert C.timed_text(sample) == [{"text": "abc", "runs": [{"lo": 1, "hi": 3, "style": 2}]}]


def test_package_fields():
    assert C.package_metadata(b"Name: a\nSummary: x\n  more\n\nBody: no\n") == [{"pos": 0, "field": "name", "value": "a"}, {"pos": 1, "field": "summary", "value": "x\nmore"}]


def test_no_bytes_break_a_parser():
    import random

    rng = random.Random(0x5EED)
    seeds = [archive(["a", "b"]), C.wav_write(b"12345678", 8000, 1), box(b"moov", box(b"trak")), id3(), flash([(9, b"abc"), (0, b"")], True), SRT.encode()]
    for function, _ in C.PARSERS.values():
        for seed in seeds:
            for _ in range(60):
                data = bytearray(seed)
                for _ in range(rng.randint(1, 6)):
                    data[rng.randrange(len(data))] = rng.randrange(256)
                try:
                    function(bytes(data[: rng.randint(0, len(data))]))
                except C.BadFile:
                    pass


def test_parse_rows(spark):
    rows = [(1, archive(["p2.jpg", "p10.jpg"])), (2, b"no"), (3, None), (4, C.zip_write([]))]
    got = files.parse(spark.createDataFrame(rows, "id int, content binary"), "zip_entries", ["id"]).orderBy("id", "pos").collect()
    assert [(r.id, r.name, r.error is None) for r in got] == [(1, "p2.jpg", True), (1, "p10.jpg", True), (2, None, False), (3, None, False)]
    files.register_table_functions(spark)
    spark.createDataFrame(rows, "id int, content binary").createOrReplaceTempView("archives")
    assert spark.sql("SELECT id, name FROM archives, LATERAL zip_entries(content) WHERE error IS NULL").count() == 2
    assert sorted(r.id for r in spark.sql("SELECT id FROM archives, LATERAL zip_entries(content) WHERE error IS NOT NULL").collect()) == [2, 3]


def test_read_files(spark, tmp_path):
    for n, size in (("a.jpg", 3), (".b.jpg", 3), ("c.JPG", 3), ("d.txt", 3), ("e.jpg", 99)):
        (tmp_path / n).write_bytes(b"x" * size)
    got = files.read_files(spark, str(tmp_path), ["jpg"], most=10)
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.select("path").collect()) == ["a.jpg", "c.JPG"]
    urls = spark.createDataFrame([("file:///a",), ("https://h/x",), ("https:///x",), ("ftp://h/x",)], "u string").select(files.allowed_source(F.col("u"))).collect()
    assert [r[0] for r in urls] == [True, True, False, False]


def test_sinks(spark):
    cues = spark.createDataFrame([("d", 1, 2.0, 3.0, "b<"), ("d", 0, 0.5, 1.0, "a")], "doc string, pos int, start double, end double, text string")
    assert sinks.subrip(cues, "doc").first().text == "1\n00:00:00,500 --> 00:00:01,000\na\n\n2\n00:00:02,000 --> 00:00:03,000\nb<\n\n"
    assert sinks.webvtt(cues, "doc").first().text.startswith("WEBVTT\n\n00:00:00.500") and "b&lt;" in sinks.webvtt(cues, "doc").first().text
    pages = spark.createDataFrame([("k", 1, "002.jpg", b"2"), ("k", 0, "001.jpg", b"1")], "k string, pos int, name string, content binary")
    made = files.book(pages, "k", "pos", "name", "content").first().content
    assert [e["name"] for e in C.zip_entries(bytes(made))] == ["001.jpg", "002.jpg"]
