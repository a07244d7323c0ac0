import pytest
from pyspark.sql import functions as F

from spoolframe.operators import library as L


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_capabilities(spark):
    probed = F.array(F.lit("public.heif"), F.lit("public.png"))
    assert value(spark, L.format_of_type(F.lit("Public.JXL"))) == "jpegXL" and value(spark, L.format_of_type(F.lit("x"))) is None
    assert value(spark, L.writable_type(F.lit("heic"), probed)) == "public.heif" and value(spark, L.writable_type(F.lit("gif"), probed)) is None
    assert value(spark, L.capabilities(F.array(F.lit("png")), ["webp", "png"])) == ["png", "webp"]
    assert value(spark, L.chapters_supported(F.lit("M4B"))) is None and value(spark, L.chapters_supported(F.lit("wav")))
    assert value(spark, L.release_year(F.lit("2024.05.01"))) == 2024 and value(spark, L.release_year(F.lit("v1"))) is None


def test_canvas(spark):
    frames = spark.createDataFrame([("a", 1, 9, 9), ("a", 0, 4, 3), ("b", 0, 2, 2), ("b", 1, 2, 2)], "k string, pos int, width int, height int")
    first = {r.k: (r.width, r.height) for r in L.canvas(frames, "k").collect()}
    assert first == {"a": (4, 3), "b": (2, 2)}
    assert {r.k: r.reason is None for r in L.canvas(frames, "k", "uniform").collect()} == {"a": False, "b": True}
    assert L.canvas(frames, "k", "fixed", 0, 5).first().reason and L.canvas(frames, "k", "fixed", 7, 5).first().width == 7
    with pytest.raises(ValueError):
        L.canvas(frames, "k", "odd")


def test_rows(spark):
    refs = spark.createDataFrame([("d", "s", 5), ("d", "s", 5), ("d", "t", 7)], "k string, source string, size long")
    assert L.distinct_bytes(refs, "k", "source", "size").first().bytes == 12
    items = spark.createDataFrame([("q", "finished"), ("q", "running"), ("q", None)], "k string, state string")
    assert L.download_states(items, "k", "state").first()[1:] == (1, 1) and L.pending(items, "state").count() == 2
    paths = spark.createDataFrame([("a",), ("a/b/c",), ("a/b",)], "p string")
    assert [r.p for r in L.removal_order(paths, "p").orderBy("removal_key").collect()] == ["a/b/c", "a/b", "a"]
    c = spark.createDataFrame([("p", 1, ["<2", ">=1"]), ("p", 0, [">=1"])], "k string, pos int, clauses array<string>")
    assert L.merged_clauses(c, "k", "clauses", "pos").first().clauses == [">=1", "<2"]
    urls = spark.createDataFrame([("https://a.x/v",), ("https://b/",)], "url string")
    assert [r.extractor for r in L.extractor_of(urls, [("a", r"//a\."), ("any", "^ftp")]).collect()] == ["a", None]
    m = spark.createDataFrame([("z", "p.jpg"), ("z", "x.xml"), ("z", "a.txt")], "k string, name string")
    assert L.left_over(m, "k", "name", F.col("name").endswith(".jpg")).first().dropped == ["a.txt", "x.xml"]
    g = spark.createDataFrame([("f", 0, []), ("f", 1, ["one"]), ("f", 2, ["two"])], "k string, pos int, rows array<string>")
    assert L.first_locale(g, "k", "pos", "rows").first().rows == ["one"]
    assert value(spark, L.rendition_json({"format_id": F.lit("1"), "vcodec": F.coalesce(F.lit(None).cast("string"), F.lit("none"))})) == '{"format_id":"1","vcodec":"none"}'
