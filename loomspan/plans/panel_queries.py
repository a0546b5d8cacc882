"""Queries over series and panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.functions import scalars
from loomspan.operators import aggregates as agg
from loomspan.operators import timeseries as ts
from loomspan.plans.base import DENSE, PANEL, dense_events, order_panel, r
from loomspan.plans.registry import query
from loomspan.session import table

_EPISODES = """
rolled AS (SELECT *, CASE WHEN count(value) OVER w = 3 THEN sum(value) OVER w END AS s FROM dense WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
flagged AS (SELECT *, coalesce(s > 600, false) AS f FROM rolled),
started AS (SELECT *, CASE WHEN f AND NOT coalesce(lag(f) OVER (PARTITION BY entity ORDER BY day), false) THEN 1 ELSE 0 END AS b FROM flagged),
runs AS (SELECT *, sum(b) OVER (PARTITION BY entity ORDER BY day) AS episode FROM started),
eps AS (SELECT entity, episode, min(day) AS start, count(*) AS days, max(s - 600) AS severity FROM runs WHERE f GROUP BY 1, 2)"""


def _episodes(spark, sf_dir):
    rolled = ts.strict_rolling_sum(dense_events(spark, sf_dir), 3, out="s")
    return ts.episodes(rolled.withColumn("flag", F.coalesce(F.col("s") > 600, F.lit(False))).withColumn("severity", F.col("s") - 600))


@query("episode_summary", f"WITH {DENSE}, {_EPISODES} SELECT entity, count(*) AS episodes, CAST(sum(days) AS BIGINT) AS total_days, max(days) AS longest, round(max(severity), 6) AS worst, min(start) AS first_start FROM eps GROUP BY 1")
def episode_summary(spark, sf_dir):
    return _episodes(spark, sf_dir).groupBy("entity").agg(
        F.count(F.lit(1)).alias("episodes"), F.sum("days").alias("total_days"), F.max("days").alias("longest"), r(F.max("severity")).alias("worst"), F.min("start").alias("first_start")
    )


@query("episode_list", f"WITH {DENSE}, {_EPISODES} SELECT entity, start, days, round(severity, 6) AS severity FROM eps")
def episode_list(spark, sf_dir):
    return _episodes(spark, sf_dir).select("entity", "start", "days", r(F.col("severity")).alias("severity"))


_BLOCK = """SELECT entity, CAST(sum(CASE WHEN inside THEN 1 ELSE 0 END) AS BIGINT) AS w_days, count(x) AS w_valid,
  CASE WHEN count(x) >= 0.8 * sum(CASE WHEN inside THEN 1 ELSE 0 END) THEN round(avg(x), 6) END AS w_mean,
  CASE WHEN count(x) >= 0.8 * sum(CASE WHEN inside THEN 1 ELSE 0 END) THEN min(x) END AS w_min,
  CASE WHEN count(x) >= 0.8 * sum(CASE WHEN inside THEN 1 ELSE 0 END) THEN max(x) END AS w_max,
  CASE WHEN count(x) >= sum(CASE WHEN inside THEN 1 ELSE 0 END) THEN round(coalesce(sum(x), 0.0), 6) END AS w_total
FROM (SELECT *, CASE WHEN inside THEN value END AS x FROM ({})) GROUP BY entity"""


@query("seasonal_coverage_aggs", f"WITH {DENSE} " + _BLOCK.format("SELECT *, day BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' AS inside FROM dense"))
def seasonal_coverage_aggs(spark, sf_dir):
    inside = F.col("day").between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-21").cast("date"))
    out = dense_events(spark, sf_dir).groupBy("entity").agg(*agg.window_block("value", inside, "w", 0.8, 1.0))
    return out.withColumns({c: r(F.col(c)) for c in ("w_mean", "w_total")})


#: Windows of the feature block, as conditions that Spark and DuckDB read alike; stages follow the running total of values.
_WINDOWS = {"ann": "true", "gs": "day BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'", "veg": "sofar < 800", "silk": "sofar >= 800 AND sofar < 1600", "grain": "sofar >= 1600"}
_FEATURES = [
    ("value", "value", ("mean", "min", "max", "total", "valid"), None), ("surplus", "greatest(value - 50, 0)", ("mean", "total"), None),
    ("root", "sqrt(abs(value))", ("mean", "max"), None), ("high", "value", ("count",), "value > 50"), ("step", "value - before", ("mean", "valid"), None),
]


def _features_sql() -> str:
    out = []
    for w, inside in _WINDOWS.items():
        n = f"count(*) FILTER ({inside})"
        out.append(f"{n} AS days_{w}")
        for name, value, stats, when in _FEATURES:
            valid = f"count({value}) FILTER ({inside})"
            some, whole = f"coalesce({valid} / nullif({n}, 0), 1.0) >= 0.8", f"coalesce({valid} / nullif({n}, 0), 1.0) >= 1.0"
            made = {
                "mean": f"CASE WHEN {some} THEN round(avg({value}) FILTER ({inside}), 6) END", "min": f"CASE WHEN {some} THEN round(min({value}) FILTER ({inside}), 6) END",
                "max": f"CASE WHEN {some} THEN round(max({value}) FILTER ({inside}), 6) END", "valid": valid, "total": f"CASE WHEN {whole} THEN round(coalesce(sum({value}) FILTER ({inside}), 0.0), 6) END",
                "count": f"CASE WHEN {whole} THEN count(*) FILTER (({inside}) AND {when}) END",
            }
            out += [f"{made[stat]} AS {name}_{stat}_{w}" for stat in stats]
    return ", ".join(out)


@query("feature_block", f"WITH {DENSE}, x AS (SELECT *, coalesce(sum(value) OVER (PARTITION BY entity ORDER BY day), 0.0) AS sofar, lag(value) OVER (PARTITION BY entity ORDER BY day) AS before FROM dense) SELECT entity, {_features_sql()} FROM x GROUP BY entity")
def feature_block(spark, sf_dir):
    w = Window.partitionBy("entity").orderBy("day")
    held = dense_events(spark, sf_dir).withColumn("before", F.lag("value").over(w)).withColumn("sofar", F.coalesce(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    features = [agg.Feature(name, F.expr(value), stats, when and F.expr(when)) for name, value, stats, when in _FEATURES]
    out = agg.feature_block(held, ["entity"], {k: F.expr(c) for k, c in _WINDOWS.items()}, features, 0.8, 1.0)
    return out.withColumns({c: r(F.col(c)) for c, kind in out.dtypes if kind == "double"})


@query("phenology_windows", f"""WITH {DENSE}, gdd AS (SELECT *, sum(value) OVER (PARTITION BY entity ORDER BY day) AS total FROM dense),
  lab AS (SELECT *, CASE WHEN coalesce(total, 0) < 800 THEN 'veg' WHEN total < 1600 THEN 'silk' ELSE 'grain' END AS stage FROM gdd)
  SELECT entity, stage, count(*) AS days, CAST(min(dayofyear(day)) AS INTEGER) AS start_doy, CAST(max(dayofyear(day)) AS INTEGER) AS end_doy, round(coalesce(sum(value), 0.0), 6) AS total FROM lab GROUP BY 1, 2""")
def phenology_windows(spark, sf_dir):
    w = Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    held = dense_events(spark, sf_dir).withColumn("total", F.coalesce(F.sum("value").over(w), F.lit(0.0)))
    stage = F.when(F.col("total") < 800, "veg").when(F.col("total") < 1600, "silk").otherwise("grain")
    return held.groupBy("entity", stage.alias("stage")).agg(F.count(F.lit(1)).alias("days"), F.min(F.dayofyear("day")).alias("start_doy"), F.max(F.dayofyear("day")).alias("end_doy"), r(F.coalesce(F.sum("value"), F.lit(0.0))).alias("total"))


for _w in (7, 30):

    @query(f"strict_rolling_sum_{_w}", f"""WITH {DENSE} SELECT entity, day, CASE WHEN count(value) OVER w = {_w} THEN round(sum(value) OVER w, 6) END AS rolled
      FROM dense WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN {_w - 1} PRECEDING AND CURRENT ROW)""")
    def strict_rolling_sum(spark, sf_dir, width=_w):
        return ts.strict_rolling_sum(dense_events(spark, sf_dir), width).select("entity", "day", r(F.col("rolled")).alias("rolled"))


@query("interpolated_gaps", f"""WITH {DENSE}, i AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day) AS i FROM dense),
  n AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS a, first_value(value IGNORE NULLS) OVER f AS z,
    last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ai, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER f AS zi FROM i
    WINDOW b AS (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
  SELECT entity, day, round(coalesce(value, CASE WHEN zi - ai - 1 <= 3 THEN a + (z - a) * (i - ai) / (zi - ai) END), 6) AS filled FROM n""")
def interpolated_gaps(spark, sf_dir):
    return ts.interpolate(dense_events(spark, sf_dir), 3).select("entity", "day", r(F.col("filled")).alias("filled"))


@query("rolling_mean_2_3", f"""WITH {PANEL} SELECT entity, year, round(avg(value) OVER (PARTITION BY entity ORDER BY year ROWS 1 PRECEDING), 4) AS mean_2,
  round(avg(value) OVER (PARTITION BY entity ORDER BY year ROWS 2 PRECEDING), 4) AS mean_3 FROM panel""")
def rolling_mean_2_3(spark, sf_dir):
    p = order_panel(spark, sf_dir)
    return p.select("entity", "year", *[r(ts.rolling_mean(p, n, "entity", "year", "value"), 4).alias(f"mean_{n}") for n in (2, 3)])


@query("exact_lag_guarded", f"""WITH {PANEL} SELECT entity, year, CASE WHEN lag(year) OVER w = year - 1 THEN round(lag(value) OVER w, 4) END AS lag_1,
  CASE WHEN lag(year, 2) OVER w = year - 2 THEN round(lag(value, 2) OVER w, 4) END AS lag_2 FROM panel WINDOW w AS (PARTITION BY entity ORDER BY year)""")
def exact_lag_guarded(spark, sf_dir):
    return order_panel(spark, sf_dir).select("entity", "year", *[r(ts.exact_lag(k, "entity", "year", "value"), 4).alias(f"lag_{k}") for k in (1, 2)])


@query("partition_safe_lag", f"""WITH {PANEL} SELECT p.entity, p.year, round(q.value, 4) AS lag_1 FROM panel p LEFT JOIN panel q ON q.entity = p.entity AND q.year = p.year - 1 AND q.year <= 1998""")
def partition_safe_lag(spark, sf_dir):
    p = ts.partition_lag(order_panel(spark, sf_dir), 1, "entity", "year", "value", F.col("year") <= 1998)
    return p.select("entity", "year", r(F.col("lag_1"), 4).alias("lag_1"))


@query("prior5_average", f"""WITH {PANEL} SELECT entity, year, CASE WHEN count(value) OVER w >= 3 THEN round(avg(value) OVER w, 4) END AS prior
  FROM panel WINDOW w AS (PARTITION BY entity ORDER BY year ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def prior5_average(spark, sf_dir):
    return order_panel(spark, sf_dir).select("entity", "year", r(ts.prior_average(5, 3, "entity", "year", "value"), 4).alias("prior"))


_SUPPLIERS = "sup AS (SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)"


@query("pct_rank_avg_ties", f"""WITH {_SUPPLIERS} SELECT entity, year, q, round((rank() OVER (PARTITION BY year ORDER BY q) + (count(*) OVER (PARTITION BY year, q) - 1) / 2.0), 6) AS avg_rank,
  round((rank() OVER (PARTITION BY year ORDER BY q) + (count(*) OVER (PARTITION BY year, q) - 1) / 2.0) / count(q) OVER (PARTITION BY year), 6) AS pct FROM sup""")
def pct_rank_avg_ties(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").cast("bigint").alias("q"))
    return s.select("entity", "year", "q", r(ts.average_rank("q", "year")).alias("avg_rank"), r(ts.percent_rank("q", "year")).alias("pct"))


@query("qcut_within_year", f"""WITH {PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY value, entity) AS rk, count(*) OVER (PARTITION BY year) AS n FROM panel)
  SELECT year, CAST(greatest(1, ceil(5.0 * (rk - 1) / nullif(n - 1, 0))) AS INTEGER) AS quintile, count(*) AS n, round(avg(value), 4) AS mean FROM k GROUP BY 1, 2""")
def qcut_within_year(spark, sf_dir):
    w = Window.partitionBy("year")
    k = order_panel(spark, sf_dir).withColumn("rk", F.row_number().over(w.orderBy("value", "entity"))).withColumn("n", F.count(F.lit(1)).over(w))
    return k.groupBy("year", ts.equal_count_bin(F.col("rk"), F.col("n"), 5).alias("quintile")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 4).alias("mean"))


@query("conditions_vs_record", f"""WITH {PANEL} SELECT entity, year, round(value - avg(value) OVER (PARTITION BY entity), 4) AS difference, round(cume_dist() OVER (PARTITION BY entity ORDER BY value), 6) AS ecdf FROM panel""")
def conditions_vs_record(spark, sf_dir):
    w = Window.partitionBy("entity")
    return order_panel(spark, sf_dir).select("entity", "year", r(F.col("value") - F.avg("value").over(w), 4).alias("difference"), r(F.cume_dist().over(w.orderBy("value"))).alias("ecdf"))


@query("daily_steps", f"""WITH {DENSE}, c AS (SELECT entity, day, sum(value) OVER (PARTITION BY entity ORDER BY day) AS total FROM dense)
  SELECT entity, day, round(greatest(total - coalesce(lag(total) OVER (PARTITION BY entity ORDER BY day), 0.0), 0.0), 6) AS step FROM c""")
def daily_steps(spark, sf_dir):
    w = Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    c = dense_events(spark, sf_dir).withColumn("total", F.sum("value").over(w))
    # a running sum of nothing is null in both engines, and so is its step
    return c.select("entity", "day", F.when(F.col("total").isNotNull(), r(ts.de_accumulate("total", "entity", "day"))).otherwise(r(F.greatest(F.col("total") - 0.0, F.lit(0.0)))).alias("step"))


@query("gdd_and_heat", f"""WITH {DENSE} SELECT entity, round(sum((least(greatest(value / 10, 10), 30) + least(greatest(value / 20, 10), 30)) / 2 - 10), 6) AS gdd,
  round(sum(CASE WHEN value IS NOT NULL THEN greatest(value / 10 - 35, 0) END), 6) AS heat, count(value) AS n FROM dense WHERE value IS NOT NULL GROUP BY 1""")
def gdd_and_heat(spark, sf_dir):
    d = dense_events(spark, sf_dir).where("value is not null")
    return d.groupBy("entity").agg(r(F.sum(scalars.degree_days(F.col("value") / 10, F.col("value") / 20))).alias("gdd"), r(F.sum(scalars.excess(F.col("value") / 10, 35.0))).alias("heat"), F.count("value").alias("n"))


@query("slot_climatology", """WITH s AS (SELECT CAST(CASE WHEN dayofyear(make_date(year(o_orderdate), 12, 31)) = 366 AND dayofyear(o_orderdate) >= 60 THEN dayofyear(o_orderdate) - 1 ELSE dayofyear(o_orderdate) END AS INTEGER) AS slot, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders),
  e AS (SELECT CAST(((slot - 1 + o + 365) % 365) + 1 AS INTEGER) AS near, v FROM s CROSS JOIN (SELECT unnest(range(-7, 8)) AS o))
  SELECT near AS slot, count(*) AS n, round(CAST(sum(v) AS BIGINT) / (count(*) * 100), 4) AS mean FROM e GROUP BY 1""")
def slot_climatology(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(ts.day_slot(F.col("o_orderdate")).alias("slot"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("v"))
    # a slot is summed first: its 15 copies then cost 15 rows, not 15 times the table; whole cents add up exactly
    sums = o.groupBy("slot").agg(F.sum("v").alias("s"), F.count("v").alias("c"))
    return ts.near_slots(sums, "slot", 7).groupBy(F.col("near").cast("int").alias("slot")).agg(F.sum("c").alias("n"), r(F.sum("s") / (F.sum("c") * 100), 4).alias("mean"))


@query("fao56_et0", """WITH b AS (SELECT l_orderkey AS k, l_linenumber AS line, 15 + l_quantity / 2 AS tmax, 5 + l_quantity / 4 AS tmin, 0.8 + l_discount * 5 AS ea, 10 + l_tax * 100 AS rs, 1 + l_discount * 10 AS u2,
    100.0 + l_linenumber AS z, 42.0 AS lat, dayofyear(l_shipdate) AS doy FROM lineitem),
  c AS (SELECT *, (tmax + tmin) / 2 AS t, (0.6108 * exp(17.27 * tmax / (tmax + 237.3)) + 0.6108 * exp(17.27 * tmin / (tmin + 237.3))) / 2 AS es, 2 * 3.141592653589793 * doy / 365 AS turn, radians(lat) AS phi FROM b),
  d AS (SELECT *, 1 + 0.033 * cos(turn) AS dr, 0.409 * sin(turn - 1.39) AS dec FROM c),
  e AS (SELECT *, acos(greatest(least(-tan(phi) * tan(dec), 1.0), -1.0)) AS ws FROM d),
  f AS (SELECT *, 24 * 60 / 3.141592653589793 * 0.0820 * dr * (ws * sin(phi) * sin(dec) + cos(phi) * cos(dec) * sin(ws)) AS ra FROM e),
  g AS (SELECT *, least(greatest(rs / ((0.75 + 2e-5 * z) * ra), 0.3), 1.0) AS ratio, 4098 * 0.6108 * exp(17.27 * t / (t + 237.3)) / pow(t + 237.3, 2) AS slope, 0.000665 * 101.3 * pow((293 - 0.0065 * z) / 293, 5.26) AS gam FROM f),
  h AS (SELECT *, 0.77 * rs - 4.903e-9 * (pow(tmax + 273.16, 4) + pow(tmin + 273.16, 4)) / 2 * (0.34 - 0.14 * sqrt(ea)) * (1.35 * ratio - 0.35) AS net FROM g)
  SELECT k, line, round(greatest((0.408 * slope * net + gam * 900 / (t + 273) * u2 * (es - ea)) / (slope + gam * (1 + 0.34 * u2)), 0.0), 6) AS et0 FROM h""")
def fao56_et0(spark, sf_dir):
    q = F.col("l_quantity")
    li = table(spark, sf_dir, "lineitem")
    et = scalars.reference_et(15 + q / 2, 5 + q / 4, 0.8 + F.col("l_discount") * 5, 10 + F.col("l_tax") * 100, 1 + F.col("l_discount") * 10, 100.0 + F.col("l_linenumber"), F.lit(42.0), F.dayofyear("l_shipdate"))
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), r(et).alias("et0"))


@query("spei_glo_fit", f"""WITH {DENSE}, x AS (SELECT entity, value AS v, row_number() OVER (PARTITION BY entity ORDER BY value, day) AS i, count(*) OVER (PARTITION BY entity) AS n FROM dense WHERE value IS NOT NULL),
  b AS (SELECT entity, max(n) AS n, avg(v) AS b0, sum((i - 1) * v / (n - 1.0)) / max(n) AS b1, sum((i - 1) * (i - 2) * v / ((n - 1.0) * (n - 2.0))) / max(n) AS b2 FROM x WHERE n >= 5 GROUP BY 1),
  l AS (SELECT entity, n, b0 AS l1, 2 * b1 - b0 AS l2, 6 * b2 - 6 * b1 + b0 AS l3 FROM b),
  k AS (SELECT *, -l3 / l2 AS k FROM l),
  a AS (SELECT *, l2 * sin(k * 3.141592653589793) / (k * 3.141592653589793) AS alpha FROM k)
  SELECT entity, n, round(k, 6) AS k, round(alpha, 6) AS alpha, round(l1 - alpha * (1 / k - 3.141592653589793 / sin(k * 3.141592653589793)), 6) AS xi FROM a""")
def spei_glo_fit(spark, sf_dir):
    from loomspan.operators import indices

    fit = indices.glo_fit(dense_events(spark, sf_dir), ["entity"], "value", "day", least=5)
    return fit.select("entity", "n", r(F.col("k")).alias("k"), r(F.col("alpha")).alias("alpha"), r(F.col("xi")).alias("xi"))


@query("spi_gamma_fit", f"""WITH {DENSE} SELECT entity, count(*) AS n, count(CASE WHEN value < 0.01 THEN 1 END) AS zeros,
  round((1 + sqrt(1 + 4 * (ln(avg(CASE WHEN value >= 0.01 THEN value END)) - avg(CASE WHEN value >= 0.01 THEN ln(value) END)) / 3)) / (4 * (ln(avg(CASE WHEN value >= 0.01 THEN value END)) - avg(CASE WHEN value >= 0.01 THEN ln(value) END))), 6) AS shape
  FROM dense WHERE value IS NOT NULL GROUP BY 1 HAVING count(CASE WHEN value >= 0.01 THEN 1 END) >= 5""")
def spi_gamma_fit(spark, sf_dir):
    from loomspan.operators import indices

    return indices.gamma_fit(dense_events(spark, sf_dir), ["entity"], "value", least=5).select("entity", "n", "zeros", r(F.col("shape")).alias("shape"))


@query("spei_index")
def spei_index(spark, sf_dir):
    from loomspan.operators import indices

    dense = dense_events(spark, sf_dir)
    fit = indices.glo_fit(dense, ["entity"], "value", "day", least=5)
    return indices.standardise(dense.join(fit, "entity"), indices.glo_cdf("value")).select("entity", "day", r(F.col("index")).alias("index"))


@query("spi_index")
def spi_index(spark, sf_dir):
    from loomspan.operators import indices

    dense = dense_events(spark, sf_dir)
    fit = indices.gamma_fit(dense, ["entity"], "value", least=5)
    return indices.standardise(dense.join(fit, "entity"), indices.gamma_cdf("value")).select("entity", "day", r(F.col("index")).alias("index"))
