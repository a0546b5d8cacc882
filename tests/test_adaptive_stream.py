"""Adaptive intervals on a stream against the batch form, through a restart, and the sketch's error."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import intervals as iv
from loomspan.streaming import adaptive

SCHEMA = "series string, ts timestamp, y double, lo double, hi double, sev double"
FIELDS = ["series", "step", "alpha_t", "q", "n", "coverage"]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(2)
    import datetime

    out = []
    for year in range(2000, 2005):
        for series, spread in (("a", 1.0), ("b", 3.0)):
            for _ in range(60 if (series, year) != ("b", 2002) else 0):
                y = float(rnd.normal() * spread * (1 + (year - 2000) / 4))
                out.append((series, datetime.datetime(year, 1, 1) + datetime.timedelta(days=int(rnd.integers(365))), y, -1.0, 1.0, float(rnd.integers(8))))
    return out


def replay(spark, rows, tmp_path, make, name):
    """The stream's rows when the years come as files, half of them in a first run, the rest after a restart."""
    import datetime

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        folder, out = str(tmp_path / "in"), str(tmp_path / "out")
        for years in ((2000, 2001, 2002), (2003, 2004, 2006)):
            for year in years:
                own = [r for r in rows if r[1].year == year] or [("end", datetime.datetime(year, 6, 1), 0.0, -1.0, 1.0, 0.0)]
                spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
            query = make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", out).trigger(availableNow=True).start()
            query.awaitTermination(240)
        return spark.read.parquet(out)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def same(got, want):
    got, want = ({(r.series, r.step): r for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert [got[k][c] for c in FIELDS[2:]] == pytest.approx([w[c] for c in FIELDS[2:]], abs=1e-9), k


def test_stream_equals_batch_through_a_restart(spark, rows, tmp_path):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("step", F.year("ts"))
    got = replay(spark, rows, tmp_path, lambda s: adaptive.adaptive_stream(s, "series", "ts"), "plain")
    same(got, iv.adaptive_conformal(table, "series", "step"))


def test_severity_stream_equals_batch(spark, rows, tmp_path):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("step", F.year("ts"))
    got = replay(spark, rows, tmp_path, lambda s: adaptive.severity_adaptive_stream(s, "series", "ts", "sev"), "severity")
    same(got, iv.severity_adaptive_conformal(table, "series", "step", "sev"))


@pytest.mark.parametrize("eps", [0.1, 0.02, 0.002])
def test_sketch_keeps_ranks_within_its_error(eps):
    rnd = np.random.default_rng(4)
    parts = [rnd.normal(size=rnd.integers(1, 900)) * rnd.integers(1, 5) for _ in range(60)] + [np.repeat(1.5, 300), np.arange(500.0), np.array([np.nan])]
    sketch = adaptive.Sketch(eps=eps)
    for p in parts:
        sketch = adaptive.Sketch.read(sketch.merged(adaptive.Sketch.of(p, eps)).data(), eps)
    every = np.sort(np.concatenate(parts))
    every = every[~np.isnan(every)]
    n = len(every)
    assert sketch.n == n and len(sketch.v) < max(12 / eps, 100)
    for rank in [0, n - 1, *rnd.integers(n, size=200)]:
        low, high = np.searchsorted(every, v := sketch.at(int(rank)), "left"), np.searchsorted(every, v, "right") - 1
        assert max(low - rank, rank - high, 0) <= 2 * eps * n
    for q in rnd.normal(size=50) * 3:
        assert abs(sketch.up_to(q) - np.searchsorted(every, q, "right")) <= 2 * eps * n
