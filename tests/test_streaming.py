import datetime as dt

from pyspark.sql import functions as F

from spoolframe.streaming import progress


def at(ms):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=ms)


def test_throttle(spark, tmp_path):
    rows = [("j", at(0), "read", 0.0, 0, 0), ("j", at(10), "read", 0.5, 0, 0), ("j", at(200), "read", 0.505, 0, 0), ("j", at(210), "read", 0.001, 0, 0), ("j", at(220), "write", 0.5, 0, 0), ("j", at(221), "write", 0.5, 3, 3), ("j", at(400), "write", 2.0, 0, 0)]
    schema = "job string, ts timestamp, stage string, fraction double, unit long, units long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = progress.throttle(stream).writeStream.format("memory").queryName("thin").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = [(r.stage, r.fraction) for r in spark.table("thin").orderBy("ts").collect()]
    assert got == [("read", 0.0), ("read", 0.505), ("write", 0.5), ("write", 0.5), ("write", 1.0)]


def test_rules():
    assert progress.delivers(None, 0.0, "a", None, 0, 0)
    assert not progress.delivers((0.0, 0.5, "a"), 1.0, "a", 0.505, 0, 0)
    assert progress.delivers((0.0, None, "a"), 1.0, "a", 0.1, 0, 0)
    assert not progress.delivers((0.0, 0.0, "a"), 0.05, "a", 0.9, 0, 0)


def test_newest(spark):
    rows = spark.createDataFrame([("j", 1, "a"), ("j", 3, "c"), ("k", 2, "b")], "job string, ts int, stage string")
    assert sorted(tuple(r) for r in progress.newest(rows).collect()) == [("j", 3, "c"), ("k", 2, "b")]


def test_inbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("https://h/1 word https://h/2\nhttps://h/1\nhttps://h/3 x-directive audio\n")
    query = progress.inbox(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("box").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.url: r.directive for r in spark.table("box").collect()}
    assert set(got) == {"https://h/1", "https://h/2", "https://h/3"} and got["https://h/3"] == "audio"
    assert spark.table("box").where(F.col("path").contains("a.txt")).count() == 3
