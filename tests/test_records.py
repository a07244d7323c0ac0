import struct
import zlib

from pyspark.sql import functions as F

from spoolframe.functions import flash
from spoolframe.operators import metadata
from spoolframe.sources.containers import image_info


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_flash_pictures(spark):
    pixels = bytes([0, 10, 20, 30] * 6)
    palette = bytes([1]) + zlib.compress(bytes([1, 2, 3, 4, 5, 6]) + bytes([0, 1, 0, 0] * 2))
    bodies = [(struct.pack("<BHH", 5, 3, 2) + zlib.compress(pixels), False), (struct.pack("<BHH", 3, 3, 2) + palette, False), (struct.pack("<BHH", 4, 2, 1) + zlib.compress(struct.pack(">HH", 0x7FFF, 0)), False), (b"x", False), (struct.pack("<BHH", 5, 300, 200) + zlib.compress(pixels), True), (None, False)]
    assert flash.raster(*bodies[0])[0, 0].tolist() == [10, 20, 30, 255] and flash.raster(*bodies[1])[0, 1].tolist() == [4, 5, 6, 255]
    assert flash.raster(*bodies[2])[0].tolist() == [[255, 255, 255, 255], [0, 0, 0, 255]]
    made = spark.createDataFrame(bodies, "b binary, a boolean").select(flash.lossless_png("b", "a").alias("p")).collect()
    assert [m.p is None for m in made] == [False, False, False, True, True, True] and image_info(bytes(made[0].p))[0]["width"] == 3


def test_flash_bytes(spark):
    lit = lambda b: F.unhex(F.lit(b.hex()))
    assert bytes(value(spark, flash.with_tables(lit(b"\xff\xd9\xff\xd8\xff\xd8TT\xff\xd9"), lit(b"\xff\xd8SS")))) == b"\xff\xd8TTSS"
    assert value(spark, flash.payload_kind(lit(b"RIFF0000WAVE"))) == "wav" and value(spark, flash.payload_kind(lit(b"?"))) == "unknown"
    assert tuple(value(spark, flash.sound_header(F.lit(0b00101011)))) == (2, 22050, 16, 2)
    assert value(spark, flash.route(F.lit("http://h/a.MP4?x=1"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("boolean"))) == "direct"


def test_still_record(spark):
    m = F.create_map(*(F.lit(x) for x in ["gps.Latitude", "12.5", "gps.LatitudeRef", "S", "tiff.Artist", "t", "iptc.Byline", "i", "iptc.ObjectName", "", "tiff.DocumentName", "d"]))
    r = value(spark, metadata.still_record(m))
    assert (r.latitude, r.artist, r.title, r.longitude) == (-12.5, "t", "d", None)


def test_items(spark):
    items = spark.createDataFrame([("itunes.gps", "x"), (None, "y"), ("exif.MakerApple.17", "z")], "key string, value string")
    group = metadata.audio_class(F.lit(None).cast("string"), F.col("key"))
    assert [r.value for r in metadata.filter_items(items, group, strip=["gps"]).collect()] == ["y", "z"]
    assert [r.value for r in metadata.filter_items(items, group, allow=["itunes.gps"]).collect()] == ["x", "z"]
    rows = spark.createDataFrame([("a", "title", "itunes"), ("b", "title", "id3"), ("c", "mood", "id3")], "key string, common string, key_space string")
    assert [r.to_key for r in metadata.audio_items_for(rows, True).collect()] == ["a", "song name"] and metadata.audio_items_for(rows, False).count() == 0
    rec = spark.range(1).select(F.struct(F.lit("a").alias("title")).alias("r"))
    assert metadata.edit(rec, "r", {"title": F.upper("r.title")}).first().r.title == "A"
    old, new = spark.createDataFrame([("f", "en"), ("f", "de")], "file string, language string"), spark.createDataFrame([("f", "en")], "file string, language string")
    assert [metadata.track_changes(old, new, r).count() for r in ("keep", "replace", "remove")] == [3, 2, 1]
