"""Views of the driver's tables in panel terms, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import timeseries as ts
from loomspan.session import table


def r(column, places: int = 6):
    """Rounded, so that the order of a sum does not show."""
    return F.round(column, places)


def dense_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, day, value): daily sums of events for every user, on every day between the first and the last event."""
    events = table(spark, sf_dir, "events")
    daily = ts.daily(events, "user_id", "ts", "value")
    return ts.densify(daily, daily)


DENSE = """
daily AS (SELECT user_id AS entity, CAST(ts AS DATE) AS day, sum(value) AS value FROM events GROUP BY 1, 2),
dense AS (
  SELECT e.entity, d.day, daily.value
  FROM (SELECT DISTINCT entity FROM daily) e
  CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(day) FROM daily), (SELECT max(day) FROM daily), INTERVAL 1 DAY)) AS DATE) AS day) d
  LEFT JOIN daily ON daily.entity = e.entity AND daily.day = d.day)"""


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, year, value, orders): customers by year of order; value is their spending in whole cents, which adds up exactly."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice") * 100).alias("value"), F.count(F.lit(1)).alias("orders"))


PANEL = """
panel AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice) * 100) AS value, count(*) AS orders FROM orders GROUP BY 1, 2)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction rows of line items: price by the supplier's mean unit price to 1997, with an interval around it."""
    li = table(spark, sf_dir, "lineitem").withColumn("test_year", F.year("l_shipdate"))
    unit = li.where("l_shipdate < DATE '1998-01-01'").groupBy("l_suppkey").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("u"))
    pred = F.col("l_quantity") * F.coalesce("u", F.lit(1000.0))
    held = li.join(unit, "l_suppkey", "left")
    return held.select(
        "test_year", F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("stratum"), F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("size"), F.col("l_extendedprice").alias("y"), pred.alias("pred"), (pred * 0.8).alias("lo"), (pred * 1.15).alias("hi"),
    )


PRED = """
unit AS (SELECT l_suppkey, avg(l_extendedprice / l_quantity) AS u FROM lineitem WHERE year(l_shipdate) <= 1997 GROUP BY 1),
pred AS (
  SELECT *, pred * 0.8 AS lo, pred * 1.15 AS hi FROM (
    SELECT CAST(year(l_shipdate) AS INTEGER) AS test_year, l_returnflag AS method, l_linestatus AS stratum, l_suppkey AS entity, l_orderkey AS okey, l_linenumber AS line,
           l_quantity AS size, l_extendedprice AS y, l_quantity * coalesce(u, 1000.0) AS pred
    FROM lineitem LEFT JOIN unit USING (l_suppkey)))"""

METRICS = """count(*) AS n, round(avg(CASE WHEN y >= lo AND y <= hi THEN 1.0 ELSE 0.0 END), 6) AS picp,
  round(avg(CASE WHEN y >= lo AND y <= hi THEN 1.0 ELSE 0.0 END) - 0.9, 6) AS ace, round(avg(hi - lo), 4) AS mpiw,
  round(avg(hi - lo + 20.0 * CASE WHEN y < lo THEN lo - y WHEN y > hi THEN y - hi ELSE 0.0 END), 4) AS winkler,
  round(avg(CASE WHEN y < lo THEN 1.0 ELSE 0.0 END), 6) AS unsafe_miss_rate, CAST(sum(CASE WHEN y < lo THEN 1 ELSE 0 END) AS BIGINT) AS n_unsafe,
  round(max(CASE WHEN y < lo THEN lo - y END), 4) AS worst_shortfall, round(avg(CASE WHEN y < lo THEN lo - y ELSE 0.0 END), 4) AS expected_shortfall,
  round(sqrt(avg((y - pred) * (y - pred))), 4) AS rmse, round(avg(abs(y - pred)), 4) AS mae, round(avg(y - pred), 4) AS bias"""
METRIC_NAMES = {"n": None, "picp": 6, "ace": 6, "mpiw": 4, "winkler": 4, "unsafe_miss_rate": 6, "n_unsafe": None, "worst_shortfall": 4, "expected_shortfall": 4, "rmse": 4, "mae": 4, "bias": 4}


def metric_columns(df: DataFrame, *keys: str) -> DataFrame:
    """The keys and the metrics of METRICS, rounded alike."""
    return df.select(*keys, *[F.col(k) if p is None else F.round(k, p).alias(k) for k, p in METRIC_NAMES.items()])
