"""Readers, sinks and streaming windows."""

import json

import pytest

from pyspark.sql import functions as F

from loomspan.sources import readers, writers
from loomspan.streaming import windows

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n01,1.5\n02,\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"), "k string, v double", upper=True)
    assert df.columns == ["K", "V"] and [tuple(r) for r in df.collect()] == [("01", 1.5), ("02", None)]
    for n in "xy":
        (tmp_path / f"{n}.json").write_text(json.dumps([{"a": "1"}, {"a": "2"}]))
    assert readers.read_records(spark, str(tmp_path / "*.json"), "a string").count() == 2
    nan = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double")
    assert [r.v for r in readers.nan_to_null(nan).collect()] == [None, None, 1.0]
    got = readers.explode_items(spark.createDataFrame([("1, 2;x 2",), (None,)], "h string"), "h", "hour")
    assert sorted(r.hour for r in got.collect()) == [1, 2]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(path)
    readers.write_partitions(spark.range(10, 11).withColumn("p", F.lit(1).cast("bigint")), path, "p")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 2, 10]
    assert readers.missing_work(spark.range(5), spark.range(3), ["id"]).count() == 2
    flat = str(tmp_path / "g")
    assert readers.guarded_overwrite(spark.range(5), flat) and not readers.guarded_overwrite(spark.range(3), flat)
    report = {r.name: r.present for r in readers.artifact_report(spark, flat, ["_SUCCESS", "nothing.txt"]).collect()}
    assert report["nothing.txt"] is False
    assert readers.read_all(spark, flat, path).columns[0] == "id"


def test_streamed_days_equal_batch_days(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.read_events(spark, str(tmp_path / "in"), events.schema)
    query = windows.daily_windows(stream, "user_id", "ts", "value").writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    got = {(r.entity, r.day, r.n) for r in spark.table("days").collect()}
    want = {(r.entity, r.day, r.n) for r in windows.daily_windows(events, "user_id", "ts", "value").collect()}
    assert got == want and len(want) > 100
    assert windows.sessions(events, "user_id", "ts", "6 hours").agg(F.sum("n")).first()[0] == events.count()


def test_text_sinks_and_registry(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    csv, report, runs = (str(tmp_path / n) for n in ("csv", "report", "runs"))
    writers.write_csv(df, csv)
    writers.write_csv(df.limit(1), csv, append=True)
    assert readers.read_csv(spark, csv, "k int, v string").count() == 3
    writers.write_json_report(df, report)
    assert sorted(json.loads(x.value)["k"] for x in spark.read.text(report).collect()) == [1, 2]
    lines = spark.createDataFrame([(1, "b"), (0, "# a")], "at int, line string")
    writers.write_csv_report(lines, str(tmp_path / "lines"))
    assert [x.value for x in spark.read.text(str(tmp_path / "lines")).collect()] == ["# a", "b"]
    assert writers.file_digests(spark, report).where("length(sha256) = 64 AND length(head_md5) = 32").count() > 0
    writers.register_run(spark, runs, "one", "primary", {"b": 1, "a": 2})
    with pytest.raises(ValueError, match="primary run"):
        writers.register_run(spark, runs, "two", "primary", {"a": 2, "b": 1})
    with pytest.raises(ValueError, match="unknown role"):
        writers.register_run(spark, runs, "two", "final", {})
    writers.register_run(spark, runs, "two", "exploratory", {"a": 2, "b": 1})
    assert spark.read.parquet(runs).count() == 2
    assert writers.config_drift({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 4}) == [("b", "2", "3"), ("c", "", "4")]


def test_one_of_many_writers_claims_a_protocol(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/claims/protocol"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: writers.claim(spark, path, f"run {i}"), range(24)))
    assert sum(won) == 1 and (tmp_path / "claims/protocol").read_text() == f"run {won.index(True)}"

    def register(i):
        try:
            writers.register_run(spark, str(tmp_path / "runs"), f"run {i}", "primary", {"a": 1})
            return True
        except ValueError:
            return False

    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(register, range(2))) == [False, True]
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 1
