import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoolframe.operators import formats, kernels, matching, packages, pages, planned, signals, summary, timeline

LISTING = [
    {"format_id": "sd", "ext": "mp4", "url": "u", "height": 360, "vcodec": "avc1", "acodec": "mp4a", "protocol": "https"},
    {"format_id": "hd", "ext": "mp4", "url": "u", "height": 1080, "vcodec": "avc1", "acodec": "mp4a", "protocol": "https"},
    {"format_id": "v-4k", "ext": "mp4", "url": "u", "height": "2160", "vcodec": "av01", "acodec": "none", "protocol": "https"},
    {"format_id": "a-hi", "ext": "m4a", "url": "u", "vcodec": "none", "acodec": "mp4a", "abr": 128, "protocol": "https"},
]


def chosen(spark, items, **policy):
    rows = formats.renditions(spark.createDataFrame([("x", json.dumps({"formats": items}))], "listing_id string, json string"))
    return formats.select_formats(rows, formats.Policy(**policy)).first()


def test_pair_and_cap(spark):
    assert chosen(spark, LISTING)[1:5] == ("pair", "v-4k", "a-hi", 2160)
    assert chosen(spark, LISTING, max_height=1080)[1:5] == ("single", "hd", None, 1080)
    assert chosen(spark, LISTING, intent="audio")["video_id"] == "a-hi"


def test_refusals(spark):
    webm = [{"format_id": "v", "url": "u", "vcodec": "vp9", "acodec": "none"}, {"format_id": "a", "url": "u", "vcodec": "none", "acodec": "opus"}]
    assert chosen(spark, webm)["reason"] == "no muxable video codec"
    assert chosen(spark, [LISTING[0] | {"has_drm": True}])["reason"] == "all protected"
    assert chosen(spark, LISTING[2:], muxing=False)["reason"] == "needs muxing"
    assert chosen(spark, [LISTING[0]], max_height=100)["reason"] == "height over 100, least 360"
    assert chosen(spark, [{"format_id": "m", "url": "u", "vcodec": "none", "acodec": "mp3"}])[1:3] == ("single", "m")


def test_awkward_types(spark):
    odd = {"format_id": 42, "height": "720", "width": 1280.0, "fps": "29.97", "filesize": "1048576", "url": "u"}
    rows = formats.renditions(spark.createDataFrame([("x", json.dumps({"formats": [odd, {"ext": "mp4"}]})), ("y", "not json")], "listing_id string, json string"))
    r = rows.collect()
    assert len(r) == 1 and (r[0].format_id, r[0].height, r[0].width, r[0].fps, r[0].filesize) == ("42", 720, 1280, 29.97, 1048576)


def test_chapters(spark):
    rows = [("a", 0, 0.0, 100.0), ("a", 1, 60.0, 60.0), ("b", 0, -1.0, 5.0), ("b", 1, 3.0, 0.0), ("c", 0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "file_id string, pos int, start double, duration double").withColumn("total", F.when(F.col("file_id") == "b", 10.0))
    got = {(r.file_id, r.pos): r.duration for r in timeline.normalise_chapters(df, total="total").collect()}
    assert got == {("a", 0): 60.0, ("a", 1): 60.0, ("b", 1): 7.0}


def test_cues(spark):
    df = spark.createDataFrame([("d", 0, 0.0, 10.0, "a"), ("d", 1, 5.0, 15.0, "b"), ("d", 2, 15.0, 20.0, "b"), ("d", 3, 9.0, 9.0, "x"), ("d", 4, 30.0, 31.0, "")], "doc_id string, pos int, start double, end double, text string")
    flat = timeline.flatten_cues(df)
    assert [tuple(r)[1:] for r in flat.orderBy("start").collect()] == [(0.0, 5.0, "a"), (5.0, 10.0, "a\nb"), (10.0, 20.0, "b")]
    tiles = timeline.tile_cues(flat.withColumn("total", F.lit(25000).cast("long")).withColumn("start", F.col("start") + 1), "doc_id", "total")
    assert [tuple(r)[1:3] for r in tiles.orderBy("start_ms").collect()] == [(0, 1000), (1000, 4000), (5000, 1000), (6000, 4000), (10000, 1000), (11000, 9000), (20000, 5000)]
    assert tiles.agg(F.sum("length_ms")).first()[0] == 25000


def test_signals(spark):
    df = spark.createDataFrame([("s", i, 0.0) for i in range(100)] + [("t", i, 0.2 if 40 <= i < 48 else 0.0) for i in range(100)], "file_id string, frame long, sample double")
    heard = {r.file_id: r.audible for r in signals.audibility(df, rate=20).collect()}
    assert heard == {"s": False, "t": True}
    assert {r.file_id: r.state for r in signals.mean_volume(df).collect()} == {"s": "silence", "t": "measured"}
    scores = spark.createDataFrame([("k", q / 100, q >= 37) for q in range(0, 101)], "k string, q double, ok boolean")
    assert 0.37 <= signals.bisect_quality(scores, "k", "q", "ok").first().quality <= 0.40
    assert signals.bisect_quality(scores.withColumn("ok", F.lit(False)), "k", "q", "ok").first().quality is None


def test_pages(spark):
    p = spark.createDataFrame([("d", i) for i in range(4)], "doc string, pos int")
    assert pages.emptied(p, p, "doc").count() == 1 and pages.emptied(p, p.where("pos = 0"), "doc").count() == 0
    assert [(r.old_pos, r.pos) for r in pages.remove(p, p.where("pos = 1"), "doc").orderBy("pos").collect()] == [(0, 0), (2, 1), (3, 2)]
    assert pages.bad_orders(p, p.withColumn("new_pos", 3 - F.col("pos")), "doc").isEmpty() and not pages.bad_orders(p, p.withColumn("new_pos", F.lit(0)), "doc").isEmpty()
    n = spark.createDataFrame([(0, "x"), (1, "X"), (2, "x-2"), (3, "x")], "i int, name string")
    names = [r.unique_name for r in pages.unique_names(n, "name", ["i"], folded=True).orderBy("i").collect()]
    assert names == ["x", "X--2", "x-2", "x-3"] and len({x.lower() for x in names}) == 4
    missing = pages.assemble(spark.createDataFrame([("d", 0, "s", 0), ("d", 1, "s", 9)], "document string, pos int, source string, index int"), spark.createDataFrame([("s", 0)], "source string, index int"))
    assert [r.found for r in missing.orderBy("pos").collect()] == [True, None]
    got = pages.limited(spark.createDataFrame([("k", i) for i in range(5)], "k string, i int"), "k", ["i"], 3).collect()
    assert len(got) == 3 and all(r.truncated for r in got)


def test_reports(spark):
    items = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "i int, n int")
    got = summary.outcomes(items, "i", F.col("n"), F.col("n").isNull(), F.col("i") == 3, F.lit("no value"))
    assert [(r.status, r.value, r.error) for r in got.orderBy("i").collect()] == [("succeeded", 5, None), ("failed", None, "no value"), ("cancelled", None, None)]
    assert summary.report(got, "value").first()[:5] == (1, 1, 1, False, 5)
    assert summary.report(got.limit(0)).first().all_succeeded


def test_matching(spark):
    m = F.create_map(F.lit("gps.Lat"), F.lit("1"), F.lit("tiff.Make"), F.lit("m"), F.lit("tiff.Orientation"), F.lit("6"))
    keys = lambda c: sorted(spark.range(1).select(c.alias("c")).first()["c"])
    assert keys(matching.apply_policy(m, "classes", ["gps"], forced=["gps.Lat"])) == ["gps.Lat", "tiff.Make", "tiff.Orientation"]
    assert keys(matching.apply_policy(m, "strip", forced=["tiff.Orientation"])) == ["tiff.Orientation"]
    a = spark.createDataFrame([("The Long Name",), ("short",)], "a string")
    b = spark.createDataFrame([("the.long.name.1080p",), ("short",), ("another one here",)], "b string")
    assert [tuple(r) for r in matching.release_matches(a, b, "a", "b").collect()] == [("The Long Name", "the.long.name.1080p")]


def test_kernels(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (40, 50, 4), dtype=np.uint8)
    a[..., 3] = 255
    b = a.copy()
    b[:32, :32, :3] = 255 - b[:32, :32, :3]
    rows = [("same", a.tobytes(), a.tobytes()), ("tile", a.tobytes(), b.tobytes()), ("cut", a.tobytes(), b"1")]
    df = spark.createDataFrame(rows, "k string, a binary, b binary").withColumns({"w": F.lit(50), "h": F.lit(40)})
    got = {r.k: r.s for r in df.select("k", kernels.similarity("a", "b", "w", "h").alias("s")).collect()}
    assert got["same"].overall == pytest.approx(1, abs=1e-4) and got["same"].worst == pytest.approx(1, abs=1e-4)
    assert got["tile"].worst < got["tile"].overall < 0.9 and got["cut"].overall is None
    flat = spark.createDataFrame([(bytes([1, 2, 3, 4] * 9),), (a.tobytes(),)], "a binary").select(kernels.detail("a").alias("d"), kernels.is_flat("a").alias("f")).collect()
    assert (flat[0].d, flat[0].f) == (0.0, True) and flat[1].d > 0.9 and not flat[1].f
    out = kernels.guarded(spark.createDataFrame([(1,), (0,)], "x int"), lambda v: 1.0 / v, F.col("x"), "double").orderBy("x").collect()
    assert [(r.status, r.value) for r in out] == [("failed", None), ("succeeded", 1.0)] and "ZeroDivisionError" in out[0].error


def test_resolution(spark):
    releases = spark.createDataFrame(
        [("app", "1.0", None, True), ("lib", "1.0", None, True), ("lib", "1.5", None, True), ("lib", "2.0", None, True), ("lib", "3.0rc1", None, True), ("old", "1.0", "<3", True), ("dep", "1.0", None, True), ("dep", "2.0", None, False)],
        "project string, version string, requires_python string, is_pure boolean",
    )
    needs = spark.createDataFrame([("app", "1.0", 0, "lib>=1"), ("app", "1.0", 1, "lib<2"), ("app", "1.0", 2, "extra1; extra == 'x'"), ("lib", "2.0", 0, "dep"), ("lib", "1.5", 0, "dep; python_version >= '3'")], "project string, version string, pos int, text string")
    plan = packages.resolve(spark, releases, needs, ["App"], "3.11")
    assert plan.steps == [("dep", "1.0"), ("lib", "1.5"), ("app", "1.0")] and plan.excluded == [("app", "extra1; extra == 'x'", "extra not requested")]
    assert packages.resolve(spark, releases, needs, ["lib==1.0"], "3.11", installed={"lib": "1.0"}).satisfied == [("lib", "1.0")]
    with pytest.raises(ValueError):
        packages.resolve(spark, releases, needs, ["old"], "3.11")


def test_plans(spark):
    images = spark.createDataFrame([("png", 101, 51), ("png", 0, 5)], "format string, width int, height int")
    got = planned.still_plan(images, "avif", 50, ["avif"]).collect()
    assert (got[0].to_width, got[0].to_height, got[0].backend, got[0].reason) == (50, 24, "system", None) and got[1].reason == "picture without size"
    tracks = spark.createDataFrame([(False, 320000, 96000, 6, True), (False, 64000, 44100, 2, True), (True, None, 44100, 1, True)], "lossless boolean, bitrate long, rate int, channels int, has_layout boolean")
    assert [r.skip for r in planned.audio_plan(tracks, 0.5).collect()] == [None, "saves too little", None]
    with pytest.raises(ValueError):
        planned.native_plan(images, "magic")


def test_release_matches_broadcast_nothing(spark, tmp_path):
    """Pieces and pairs are many more rows than the estimate says; a plan that broadcasts them fails in the driver."""
    spark.createDataFrame([("Some.Long.Film",), ("Another.Long.Film",)], "name string").write.parquet(f"{tmp_path}/names")
    names = spark.read.parquet(f"{tmp_path}/names")
    longer = names.select(F.concat(F.lit("x."), "name", F.lit(".1080p")).alias("release"))
    got = matching.release_matches(names, longer, "name", "release")
    assert {r["name"] for r in got.collect()} == {"Some.Long.Film", "Another.Long.Film"} and got.count() == 2
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()


def test_releases_do_not_carry_their_index(spark):
    """A row that keeps its project's whole index makes a project of many releases cost the square of them."""
    file = {"filename": "a-1-py3-none-any.whl", "packagetype": "bdist_wheel", "url": "u", "digests": {"sha256": "AB"}}
    text = json.dumps({"info": {"name": "a"}, "releases": {f"1.{i}": [file] for i in range(3000)}})
    got = packages.releases_of(spark.createDataFrame([("a", text), ("b", "no JSON"), ("c", '{"releases": null}')], "id string, json string"), "id")
    carried = re.search(r"Generate explode\([^)]*\), \[([^\]]*)\]", got._jdf.queryExecution().sparkPlan().toString())[1]
    assert {c.split("#")[0] for c in carried.split(", ")} == {"id", "project"}
    assert got.count() == 3000 and got.agg(F.min("project"), F.min("sha256")).first() == ("a", "ab")


def test_index_pages_are_bounded(spark, data, tmp_path):
    """A brand's index is read in pages; no text holds all of its releases."""
    from spoolframe.plans import details

    spark.range(60_000).select(F.col("id").alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), (F.col("id") % 50).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    held = []
    real = packages.releases_of
    packages.releases_of = lambda texts, *a: held.append(texts) or real(texts, *a)
    try:
        got = details.index_releases(spark, str(tmp_path))
    finally:
        packages.releases_of = real
    assert got.count() == 45_000 and got.select("version").distinct().count() == 45_000
    assert held[0].count() == 3
