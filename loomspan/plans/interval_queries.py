"""Queries over prediction rows: splits, baselines, calibration, metrics and inference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.operators import inference as inf
from loomspan.operators import intervals as iv
from loomspan.operators import timeseries as ts
from loomspan.plans.base import METRICS, PANEL, PRED, metric_columns, order_panel, predictions, r
from loomspan.plans.registry import query
from loomspan.session import table

_SCORE = "greatest(lo - y, y - hi)"


def _cal_test(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return p.where("test_year = 1999"), p.where("test_year >= 2000")


def _metrics():
    return iv.interval_metrics() + iv.point_metrics()


def _threshold(name: str, rel: str, score: str, alpha: str, group: str = "") -> str:
    """SQL for the interpolated quantile of scores at the conformal level, optionally by group."""
    over = f"PARTITION BY {group}" if group else ""
    key = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""{name}_s AS (SELECT {key}s, row_number() OVER ({over} ORDER BY s) - 1 AS rk, count(*) OVER ({over}) AS n FROM (SELECT {key}{score} AS s FROM {rel})),
  {name}_h AS (SELECT *, (n - 1) * least(ceil((1 - {alpha}) * (n + 1)) / n, 1.0) AS h FROM {name}_s),
  {name} AS (SELECT {key}max(n) AS n, sum(CASE WHEN rk = floor(h) THEN s * (1 - (h - floor(h))) WHEN rk = floor(h) + 1 THEN s * (h - floor(h)) END) AS q FROM {name}_h {by})"""


_TEST = "SELECT method, stratum, {m} FROM t GROUP BY 1, 2"


@query("metrics_grouping_sets", f"WITH {PRED} SELECT test_year, method, coalesce(stratum, 'ALL') AS stratum, {METRICS} FROM pred GROUP BY GROUPING SETS ((test_year, method), (test_year, method, stratum))")
def metrics_grouping_sets(spark, sf_dir):
    out = iv.metrics_with_all(predictions(spark, sf_dir), ["test_year", "method"], "stratum", _metrics())
    return metric_columns(out, "test_year", "method", "stratum")


@query("pooled_summary", f"WITH {PRED}, o AS (SELECT test_year, method, {METRICS} FROM pred WHERE test_year >= 1999 GROUP BY 1, 2) SELECT method, count(*) AS origins, CAST(sum(n) AS BIGINT) AS rows_pooled, round(sum(picp * n) / sum(n), 5) AS weighted_picp, round(avg(picp), 5) AS mean_picp, round(stddev_samp(picp), 5) AS sd_picp, arg_max(test_year, n) AS largest_origin FROM o GROUP BY 1")
def pooled_summary(spark, sf_dir):
    o = metric_columns(predictions(spark, sf_dir).where("test_year >= 1999").groupBy("test_year", "method").agg(*_metrics()), "test_year", "method")
    return o.groupBy("method").agg(
        F.count(F.lit(1)).alias("origins"), F.sum("n").alias("rows_pooled"), r(F.sum(F.col("picp") * F.col("n")) / F.sum("n"), 5).alias("weighted_picp"),
        r(F.avg("picp"), 5).alias("mean_picp"), r(F.stddev("picp"), 5).alias("sd_picp"), F.max_by("test_year", "n").alias("largest_origin"),
    )


@query("loo_sensitivity", f"""WITH {PRED}, o AS (SELECT test_year, method, count(*) AS n, CAST(sum(CASE WHEN y < lo THEN 1 ELSE 0 END) AS BIGINT) AS miss FROM pred WHERE test_year >= 1999 GROUP BY 1, 2),
  t AS (SELECT method, sum(n) AS n, sum(miss) AS miss FROM o GROUP BY 1)
  SELECT o.method, o.test_year AS left_out, round((t.miss - o.miss) / (t.n - o.n), 6) AS rate, round((t.miss - o.miss) / (t.n - o.n) - t.miss / t.n, 6) AS shift FROM o JOIN t USING (method)""")
def loo_sensitivity(spark, sf_dir):
    o = predictions(spark, sf_dir).where("test_year >= 1999").groupBy("test_year", "method").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") < F.col("lo")).alias("miss"))
    w = Window.partitionBy("method")
    rest = (F.sum("miss").over(w) - F.col("miss")) / (F.sum("n").over(w) - F.col("n"))
    return o.select("method", F.col("test_year").alias("left_out"), r(rest).alias("rate"), r(rest - F.sum("miss").over(w) / F.sum("n").over(w)).alias("shift"))


@query("reliability_by_class", f"WITH {PRED}, c AS (SELECT *, CASE WHEN size >= 40 THEN 'High' WHEN size >= 15 THEN 'Moderate' ELSE 'Low' END AS class FROM pred WHERE test_year >= 2000) SELECT coalesce(class, 'ALL') AS class, {METRICS} FROM c GROUP BY ROLLUP (class)")
def reliability_by_class(spark, sf_dir):
    p = predictions(spark, sf_dir).where("test_year >= 2000").withColumn("class", F.when(F.col("size") >= 40, "High").when(F.col("size") >= 15, "Moderate").otherwise("Low"))
    return metric_columns(p.rollup("class").agg(*_metrics()).withColumn("class", F.coalesce("class", F.lit("ALL"))), "class")


@query("conditional_coverage_axes", f"""WITH {PRED}, u AS (SELECT method, 'stratum' AS axis, stratum AS level, y, lo, hi FROM pred UNION ALL SELECT method, 'year', CAST(test_year AS VARCHAR), y, lo, hi FROM pred),
  c AS (SELECT axis, level, method, count(*) AS n, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS picp FROM u GROUP BY 1, 2, 3 HAVING count(*) >= 20)
  SELECT *, rank() OVER (PARTITION BY axis, level ORDER BY picp) AS rk FROM c""")
def conditional_coverage_axes(spark, sf_dir):
    p = predictions(spark, sf_dir)
    axes = F.explode(F.array(F.struct(F.lit("stratum").alias("axis"), F.col("stratum").alias("level")), F.struct(F.lit("year").alias("axis"), F.col("test_year").cast("string").alias("level")))).alias("a")
    u = p.select("method", "y", "lo", "hi", axes).select("method", "a.axis", "a.level", "y", "lo", "hi")
    c = u.groupBy("axis", "level", "method").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.when(F.col("y").between(F.col("lo"), F.col("hi")), 1.0).otherwise(0.0))).alias("picp")).where("n >= 20")
    return c.withColumn("rk", F.rank().over(Window.partitionBy("axis", "level").orderBy("picp")).cast("bigint"))


@query("conformal_static", f"WITH {PRED}, cal AS (SELECT * FROM pred WHERE test_year = 1999), {_threshold('q', 'cal', _SCORE, '0.1')}, t AS (SELECT p.* REPLACE (lo - q.q AS lo, hi + q.q AS hi) FROM pred p CROSS JOIN q WHERE test_year >= 2000) " + _TEST.format(m=METRICS))
def conformal_static(spark, sf_dir):
    return metric_columns(iv.conformal_static(*_cal_test(spark, sf_dir)).groupBy("method", "stratum").agg(*_metrics()), "method", "stratum")


@query("conformal_mondrian", f"WITH {PRED}, cal AS (SELECT * FROM pred WHERE test_year = 1999), {_threshold('g', 'cal', _SCORE, '0.1', 'entity')}, {_threshold('q', 'cal', _SCORE, '0.1')}, t AS (SELECT p.* REPLACE (lo - coalesce(g.q, q.q) AS lo, hi + coalesce(g.q, q.q) AS hi) FROM pred p LEFT JOIN (SELECT * FROM g WHERE n >= 20) g ON g.entity = p.entity CROSS JOIN q WHERE test_year >= 2000) " + _TEST.format(m=METRICS))
def conformal_mondrian(spark, sf_dir):
    cal, test = _cal_test(spark, sf_dir)
    return metric_columns(iv.conformal_by_group(cal, test, "entity").groupBy("method", "stratum").agg(*_metrics()), "method", "stratum")


@query("conformal_locally_adaptive", f"WITH {PRED}, cal AS (SELECT * FROM pred WHERE test_year = 1999), {_threshold('q', 'cal', _SCORE + ' / nullif(hi - lo, 0.0)', '0.1')}, t AS (SELECT p.* REPLACE (lo - q.q * (hi - lo) AS lo, hi + q.q * (hi - lo) AS hi) FROM pred p CROSS JOIN q WHERE test_year >= 2000) " + _TEST.format(m=METRICS))
def conformal_locally_adaptive(spark, sf_dir):
    return metric_columns(iv.conformal_adaptive_width(*_cal_test(spark, sf_dir)).groupBy("method", "stratum").agg(*_metrics()), "method", "stratum")


@query("conformal_asymmetric", f"WITH {PRED}, cal AS (SELECT * FROM pred WHERE test_year = 1999), {_threshold('a', 'cal', 'lo - y', '0.05')}, {_threshold('b', 'cal', 'y - hi', '0.05')}, t AS (SELECT p.* REPLACE (lo - a.q AS lo, hi + b.q AS hi) FROM pred p CROSS JOIN a CROSS JOIN b WHERE test_year >= 2000) " + _TEST.format(m=METRICS))
def conformal_asymmetric(spark, sf_dir):
    return metric_columns(iv.conformal_asymmetric(*_cal_test(spark, sf_dir)).groupBy("method", "stratum").agg(*_metrics()), "method", "stratum")


@query("conformal_weighted", f"""WITH {PRED}, v AS (SELECT {_SCORE} AS s, sum(size) AS w FROM pred WHERE test_year = 1999 GROUP BY 1),
  c AS (SELECT s, sum(w) OVER (ORDER BY s) AS c, sum(w) OVER () AS t FROM v) SELECT round(min(s), 4) AS q FROM c WHERE c >= 0.9 * t - 1e-9""")
def conformal_weighted(spark, sf_dir):
    cal = _cal_test(spark, sf_dir)[0].select(F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi")).alias("s"), F.col("size").alias("w"))
    return iv.weighted_quantile(cal, "s", "w").select(r(F.col("q"), 4).alias("q"))


@query("conformal_shifted")
def conformal_shifted(spark, sf_dir):
    cal, test = (p.withColumn("unit", F.col("pred") / F.col("size") / 1000) for p in _cal_test(spark, sf_dir))
    return metric_columns(iv.conformal_shifted(cal, test, ["size", "unit"]).groupBy("method", "stratum").agg(*_metrics()), "method", "stratum")


def _aci_sql(score: str, rates: list[float], windows: bool) -> str:
    """Adaptive intervals with a block of CTEs for each of five steps, by method; without a step the block is empty."""
    out = [f"sc AS (SELECT method, test_year, {score} AS s, x FROM (SELECT *, CASE WHEN line = 7 THEN size * 2.0 ELSE size / 20.0 END AS x FROM pred WHERE test_year BETWEEN 1997 AND 2001))"]
    out.append("st AS (SELECT method, test_year, avg(x) AS x, row_number() OVER (PARTITION BY method ORDER BY test_year) AS t FROM sc GROUP BY 1, 2), a1 AS (SELECT DISTINCT method, CAST(0.1 AS DOUBLE) AS a FROM sc)")
    back = "CASE WHEN st.x >= 5 THEN 2 WHEN st.x >= 1 THEN 3 ELSE 5 END" if windows else "99"
    for t in range(1, 6):
        out.append(f"""p{t} AS (SELECT st.method, st.test_year, sc.s, a, row_number() OVER (PARTITION BY st.method ORDER BY sc.s) - 1 AS rk, count(sc.s) OVER (PARTITION BY st.method) AS n FROM st JOIN a{t} USING (method)
          LEFT JOIN st old ON old.method = st.method AND old.t < st.t AND old.t >= st.t - {back} LEFT JOIN sc ON sc.method = old.method AND sc.test_year = old.test_year WHERE st.t = {t}),
        h{t} AS (SELECT *, (n - 1) * least(ceil((1 - a) * (n + 1)) / nullif(n, 0), 1.0) AS h FROM p{t}),
        q{t} AS (SELECT method, test_year, max(a) AS alpha_t, coalesce(sum(CASE WHEN rk = floor(h) THEN s * (1 - (h - floor(h))) WHEN rk = floor(h) + 1 THEN s * (h - floor(h)) END), 0.0) AS q FROM h{t} GROUP BY 1, 2),
        o{t} AS (SELECT q{t}.method, q{t}.test_year, alpha_t, q, count(*) AS n, avg(CASE WHEN s <= q THEN 1.0 ELSE 0.0 END) AS coverage FROM q{t} JOIN sc ON sc.method = q{t}.method AND sc.test_year = q{t}.test_year GROUP BY 1, 2, 3, 4),
        a{t + 1} AS (SELECT method, CASE WHEN coverage IS NULL THEN a ELSE least(greatest(a + {rates[t - 1]!r} * (0.1 - (1 - coverage)), 0.01), 0.4) END AS a FROM a{t} LEFT JOIN o{t} USING (method))""")
    return ", ".join(out)


_ACI_ROWS = " UNION ALL ".join(f"SELECT method, test_year, round(alpha_t, 6) AS alpha_t, round(q, 4) AS q, n, round(coverage, 6) AS coverage FROM o{t}" for t in range(1, 6))


@query("aci_yearly", f"WITH {PRED}, {_aci_sql('greatest(lo - y, y - hi)', [0.05] * 5, False)} {_ACI_ROWS}")
def aci_yearly(spark, sf_dir):
    p = predictions(spark, sf_dir).where("test_year BETWEEN 1997 AND 2001").select("method", "test_year", "y", "lo", "hi")
    return iv.adaptive_conformal(p, "method", "test_year").withColumns({"alpha_t": r(F.col("alpha_t")), "q": r(F.col("q"), 4), "coverage": r(F.col("coverage"))})


@query("severity_aci_yearly", f"WITH {PRED}, {_aci_sql('greatest(lo - y, y - hi) / (1 + 0.05 * ln(1 + greatest(x, 0.0)))', [0.05 / t**0.5 for t in range(1, 6)], True)} {_ACI_ROWS}")
def severity_aci_yearly(spark, sf_dir):
    x = F.when(F.col("line") == 7, F.col("size") * 2.0).otherwise(F.col("size") / 20.0)
    p = predictions(spark, sf_dir).where("test_year BETWEEN 1997 AND 2001").withColumn("x", x)
    out = iv.severity_adaptive_conformal(p, "method", "test_year", "x").drop("window")
    return out.withColumns({"alpha_t": r(F.col("alpha_t")), "q": r(F.col("q"), 4), "coverage": r(F.col("coverage"))})


@query("aci_trajectory", f"""WITH {PRED}, {_aci_sql('greatest(lo - y, y - hi)', [0.05] * 5, False)}, o AS ({" UNION ALL ".join(f"SELECT * FROM o{t}" for t in range(1, 6))})
  SELECT p.method, p.test_year, count(*) AS n, round(avg(hi - lo + 2 * q), 3) AS mean_width, round(stddev_samp(hi - lo + 2 * q), 3) AS sd_width, round(avg(CASE WHEN y >= lo - q AND y <= hi + q THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM pred p JOIN o ON o.method = p.method AND o.test_year = p.test_year GROUP BY 1, 2""")
def aci_trajectory(spark, sf_dir):
    p = predictions(spark, sf_dir).where("test_year BETWEEN 1997 AND 2001").select("method", "test_year", "y", "lo", "hi")
    q = iv.adaptive_conformal(p, "method", "test_year").select("method", "test_year", "q")
    held = p.join(F.broadcast(q), ["method", "test_year"])
    y, lo, hi = F.col("y"), F.col("lo") - F.col("q"), F.col("hi") + F.col("q")
    return held.groupBy("method", "test_year").agg(F.count(F.lit(1)).alias("n"), r(F.avg(hi - lo), 3).alias("mean_width"), r(F.stddev(hi - lo), 3).alias("sd_width"), r(F.avg(((y >= lo) & (y <= hi)).cast("int"))).alias("coverage"))


@query("temporal_split_counts", f"WITH {PANEL} SELECT CASE WHEN year <= 1997 THEN 'FIT' WHEN year <= 1998 THEN 'DEV' WHEN year <= 1999 THEN 'CAL' ELSE 'TEST' END AS split, count(*) AS n, min(year) AS first_year, max(year) AS last_year, count(DISTINCT entity) AS entities FROM panel GROUP BY 1")
def temporal_split_counts(spark, sf_dir):
    p = order_panel(spark, sf_dir)
    return p.groupBy(iv.temporal_split(F.col("year"), 1997, 1998, 1999).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("entity").alias("entities"))


@query("loso_folds", f"""WITH {PANEL}, p AS (SELECT panel.*, r_name AS region FROM panel JOIN customer ON c_custkey = entity JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
  SELECT g.r_name AS held_out, CASE WHEN region = g.r_name THEN 'TEST' WHEN year >= 2000 THEN 'CAL' WHEN year >= 1999 THEN 'DEV' ELSE 'FIT' END AS role, count(*) AS n FROM p CROSS JOIN region g GROUP BY 1, 2""")
def loso_folds(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    named = order_panel(spark, sf_dir).join(t("customer"), F.col("c_custkey") == F.col("entity")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    p = named.select("entity", "year", F.col("r_name").alias("region"))
    folds = iv.leave_one_out_folds(p, "region", F.col("year"), t("region").select(F.col("r_name").alias("region")), 1999, 2000)
    return folds.groupBy("held_out", "role").agg(F.count(F.lit(1)).alias("n"))


@query("rolling_origins", f"""WITH {PANEL}, o AS (SELECT panel.*, origin FROM panel CROSS JOIN (SELECT CAST(unnest([1999, 2000, 2001]) AS INTEGER) AS origin) WHERE year <= origin)
  SELECT origin, CASE WHEN origin = year THEN 'TEST' WHEN origin - year <= 1 THEN 'CAL' WHEN origin - year <= 2 THEN 'DEV' ELSE 'FIT' END AS role, count(*) AS n, min(year) AS first_year, max(year) AS last_year FROM o GROUP BY 1, 2""")
def rolling_origins(spark, sf_dir):
    o = iv.rolling_origins(order_panel(spark, sf_dir), "year", [1999, 2000, 2001])
    return o.groupBy("origin", "role").agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("disjointness_audit", f"""WITH {PANEL}, s AS (SELECT entity || '_' || year AS id, CASE WHEN year <= 1997 THEN 'FIT' WHEN year <= 1998 THEN 'DEV' WHEN year <= 1999 THEN 'CAL' ELSE 'TEST' END AS split FROM panel),
  b AS (SELECT id, list(DISTINCT split) AS l FROM s GROUP BY 1), k AS (SELECT unnest(['CAL', 'CAL', 'CAL', 'DEV', 'DEV', 'FIT']) AS a, unnest(['DEV', 'FIT', 'TEST', 'FIT', 'TEST', 'TEST']) AS b)
  SELECT k.a AS left_part, k.b AS right_part, count(x.id) AS shared, CASE WHEN count(x.id) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM k LEFT JOIN b x ON list_contains(x.l, k.a) AND list_contains(x.l, k.b) GROUP BY 1, 2""")
def disjointness_audit(spark, sf_dir):
    p = order_panel(spark, sf_dir)
    s = p.select(F.concat_ws("_", "entity", "year").alias("id"), iv.temporal_split(F.col("year"), 1997, 1998, 1999).alias("split"))
    parts = ["CAL", "DEV", "FIT", "TEST"]
    pairs = [(a, b) for i, a in enumerate(parts) for b in parts[i + 1 :]]
    both = s.groupBy("id").agg(F.collect_set("split").alias("l"))
    counts = both.agg(*[F.count_if(F.array_contains("l", a) & F.array_contains("l", b)).alias(f"{a} {b}") for a, b in pairs])
    long = counts.unpivot([], [f"{a} {b}" for a, b in pairs], "pair", "shared")
    return long.select(F.split("pair", " ")[0].alias("left_part"), F.split("pair", " ")[1].alias("right_part"), "shared", F.when(F.col("shared") == 0, "PASS").otherwise("FAIL").alias("verdict"))


@query("fit_only_imputation", f"""WITH {PANEL}, x AS (SELECT entity, year, entity % 7 AS grp, CASE WHEN (entity + year) % 5 = 0 THEN NULL ELSE value END AS v FROM panel),
  m AS (SELECT grp, median(v) AS m FROM x WHERE year <= 1997 GROUP BY 1), o AS (SELECT median(v) AS o FROM x WHERE year <= 1997)
  SELECT entity, year, coalesce(v, m, o) AS v FROM x LEFT JOIN m USING (grp) CROSS JOIN o""")
def fit_only_imputation(spark, sf_dir):
    x = order_panel(spark, sf_dir).select("entity", "year", (F.col("entity") % 7).alias("grp"), F.when((F.col("entity") + F.col("year")) % 5 != 0, F.col("value")).alias("v"))
    return iv.fit_only_imputation(x, "grp", ["v"], F.col("year") <= 1997).select("entity", "year", "v")


@query("detrend_baseline", f"""WITH {PANEL}, l AS (SELECT regr_slope(value, year) AS b, regr_intercept(value, year) AS a FROM panel WHERE year <= 1997),
  d AS (SELECT entity, year, value, a + b * year AS trend FROM panel CROSS JOIN l), m AS (SELECT entity, avg(value - trend) AS baseline FROM d WHERE year <= 1997 GROUP BY 1)
  SELECT d.entity, year, round(trend / 1e4, 3) AS trend, round(coalesce(baseline, 0.0) / 1e4, 3) AS baseline FROM d LEFT JOIN m ON m.entity = d.entity""")
def detrend_baseline(spark, sf_dir):
    d = iv.entity_baseline(iv.detrend(order_panel(spark, sf_dir), "year", "value", F.col("year") <= 1997), "entity", "residual", F.col("year") <= 1997)
    return d.select("entity", "year", r(F.col("trend") / 1e4, 3).alias("trend"), r(F.col("baseline") / 1e4, 3).alias("baseline"))


@query("ensemble_weight_grid", f"""WITH {PRED}, w AS (SELECT unnest(range(0, 21)) AS k), e AS (SELECT k, sqrt(avg(pow(y - (k / 20.0 * pred + (1 - k / 20.0) * size * 900.0), 2))) AS rmse FROM pred CROSS JOIN w WHERE test_year = 1998 GROUP BY 1)
  SELECT k, round(rmse, 3) AS rmse, k = (SELECT arg_min(k, rmse) FROM e) AS best FROM e""")
def ensemble_weight_grid(spark, sf_dir):
    dev = predictions(spark, sf_dir).where("test_year = 1998")
    # the squared error is a quadratic in the weight: three sums give all of the grid
    a, b = F.col("y") - F.col("size") * 900.0, F.col("pred") - F.col("size") * 900.0
    s = dev.agg(F.avg(a * a).alias("aa"), F.avg(a * b).alias("ab"), F.avg(b * b).alias("bb"))
    e = s.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(20).cast("bigint")))).withColumn("w", F.col("k") / 20.0)
    e = e.withColumn("rmse", F.sqrt(F.col("aa") - 2 * F.col("w") * F.col("ab") + F.col("w") * F.col("w") * F.col("bb")))
    return e.select("k", r(F.col("rmse"), 3).alias("rmse"), (F.col("rmse") == F.min("rmse").over(Window.partitionBy(F.lit(1)))).alias("best"))


@query("cluster_bootstrap_mean", f"""WITH {PRED}, s AS (SELECT entity AS c, count(*) AS n, CAST(sum(CASE WHEN y < lo THEN 1 ELSE 0 END) AS BIGINT) AS s FROM pred WHERE test_year >= 2000 GROUP BY 1),
  h AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS i FROM s), k AS (SELECT count(*) AS k FROM s),
  p AS (SELECT draw, ((((((42 + draw * 7919 + slot * 104729) % 2147483647) * 48271 + 11) % 2147483647) * 69621 + 7) % 2147483647) % k AS i FROM k CROSS JOIN (SELECT unnest(range(0, 200)) AS draw) CROSS JOIN (SELECT i AS slot FROM h))
  SELECT CAST(draw AS INTEGER) AS draw, round(sum(s) / sum(n), 6) AS mean FROM p JOIN h USING (i) GROUP BY 1""")
def cluster_bootstrap_mean(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("test_year >= 2000").select("entity", F.when(F.col("y") < F.col("lo"), 1).otherwise(0).alias("miss"))
    return inf.cluster_bootstrap_mean(rows, "entity", "miss", 200).select("draw", r(F.col("mean")).alias("mean"))


@query("cluster_bootstrap_summary", f"""WITH {PRED}, s AS (SELECT entity AS c, count(*) AS n, CAST(sum(CASE WHEN y < lo THEN 1 ELSE 0 END) AS BIGINT) AS s FROM pred WHERE test_year >= 2000 GROUP BY 1),
  h AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS i FROM s), k AS (SELECT count(*) AS k, sum(s) / sum(n) AS e, CAST(sum(n) AS BIGINT) AS n FROM s),
  p AS (SELECT draw, ((((((42 + draw * 7919 + slot * 104729) % 2147483647) * 48271 + 11) % 2147483647) * 69621 + 7) % 2147483647) % k AS i FROM k CROSS JOIN (SELECT unnest(range(0, 2000)) AS draw) CROSS JOIN (SELECT i AS slot FROM h)),
  b AS (SELECT sum(s) / sum(n) AS m FROM p JOIN h USING (i) GROUP BY draw),
  o AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, stddev_samp(m) AS se, least(1.0, greatest(2 * least(avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN m >= 0 THEN 1.0 ELSE 0.0 END)), 1 / 2000)) AS pv, count(*) AS d FROM b)
  SELECT round(e, 6) AS estimate, k AS n_clusters, n AS n_observations, CASE WHEN k >= 5 THEN round(lo, 6) END AS lo, CASE WHEN k >= 5 THEN round(hi, 6) END AS hi, CASE WHEN k >= 5 THEN round(se, 6) END AS se,
    CASE WHEN k >= 5 THEN round(pv, 6) END AS p_value, CASE WHEN k >= 5 THEN d ELSE 0 END AS n_draws, k >= 5 AS supported FROM k CROSS JOIN o""")
def cluster_bootstrap_summary(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("test_year >= 2000").select("entity", F.when(F.col("y") < F.col("lo"), 1).otherwise(0).alias("miss"))
    out = inf.cluster_bootstrap_summary(rows, "entity", "miss")
    return out.withColumns({c: r(F.col(c)) for c in ("estimate", "lo", "hi", "se", "p_value")})


@query("cluster_robust_ols", f"""WITH {PRED}, l AS (SELECT regr_slope(y, size) AS b, regr_intercept(y, size) AS a, avg(size) AS mx, count(*) AS n, regr_sxx(y, size) AS sxx FROM pred),
  u AS (SELECT entity, sum((size - mx) * (y - a - b * size)) AS u FROM pred CROSS JOIN l GROUP BY 1), m AS (SELECT sum(u * u) AS meat, count(*) AS g FROM u)
  SELECT round(a, 4) AS intercept, round(b, 5) AS slope, round(sqrt(g / (g - 1) * (n - 1) / (n - 2) * meat) / sxx, 5) AS slope_se, g AS clusters FROM l CROSS JOIN m""")
def cluster_robust_ols(spark, sf_dir):
    out = inf.cluster_robust_slope(predictions(spark, sf_dir), "entity", "size", "y")
    return out.select(r(F.col("intercept"), 4).alias("intercept"), r(F.col("slope"), 5).alias("slope"), r(F.col("slope_se"), 5).alias("slope_se"), "clusters")


@query("icc_ess", f"""WITH {PRED}, b AS (SELECT entity, count(y) AS n, avg(y / size) AS m, coalesce(var_samp(y / size), 0.0) AS v FROM pred GROUP BY 1),
  t AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * n) AS nn, sum(n * m) AS nm, sum(n * m * m) AS nmm, sum((n - 1) * v) AS wi FROM b),
  s AS (SELECT *, (nmm - nm * nm / n) / (k - 1) AS be, wi / (n - k) AS ww, (n - nn / n) / (k - 1) AS n0 FROM t),
  i AS (SELECT *, greatest((be - ww) / (be + (n0 - 1) * ww), 0.0) AS icc FROM s)
  SELECT n, k AS clusters, round(icc, 6) AS icc, round(1 + (n / k - 1) * icc, 5) AS design_effect, round(n / (1 + (n / k - 1) * icc), 3) AS effective_n FROM i""")
def icc_ess(spark, sf_dir):
    out = inf.intraclass(predictions(spark, sf_dir).withColumn("unit", F.col("y") / F.col("size")), "entity", "unit")
    return out.select("n", "clusters", r(F.col("icc")).alias("icc"), r(F.col("design_effect"), 5).alias("design_effect"), r(F.col("effective_n"), 3).alias("effective_n"))


@query("holm_bh", f"""WITH {PRED}, t AS (SELECT entity AS test, (count(*) % 97 + 1) / 100.0 AS p FROM pred GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p, test) AS rk, count(*) OVER () AS n FROM t)
  SELECT test, CAST(p AS DOUBLE) AS p, round(max(least(CAST(p AS DOUBLE) * (n - rk + 1), 1.0)) OVER (ORDER BY rk), 6) AS holm, round(min(least(CAST(p AS DOUBLE) * n / rk, 1.0)) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS bh FROM k""")
def holm_bh(spark, sf_dir):
    t = predictions(spark, sf_dir).groupBy(F.col("entity").alias("test")).agg(((F.count(F.lit(1)) % 97 + 1) / 100.0).alias("p"))
    out = inf.adjust_p(t)
    return out.select("test", "p", r(F.col("holm")).alias("holm"), r(F.col("bh")).alias("bh"))


@query("friedman_ranks", f"""WITH {PRED}, s AS (SELECT test_year, method, avg(abs(y - pred)) AS e FROM pred GROUP BY 1, 2), k AS (SELECT *, rank() OVER (PARTITION BY test_year ORDER BY e) + (count(*) OVER (PARTITION BY test_year, e) - 1) / 2.0 AS rk FROM s),
  m AS (SELECT method, avg(rk) AS mean_rank, count(*) AS blocks FROM k GROUP BY 1), t AS (SELECT count(*) AS k, sum(mean_rank * mean_rank) AS ss FROM m)
  SELECT method, round(mean_rank, 6) AS mean_rank, round(12.0 * blocks / (k * (k + 1)) * (ss - k * pow(k + 1, 2) / 4.0), 5) AS chi2, blocks FROM m CROSS JOIN t""")
def friedman_ranks(spark, sf_dir):
    s = predictions(spark, sf_dir).groupBy("test_year", "method").agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("e"))
    out = inf.friedman(s, "test_year", "method", "e", ts.average_rank)
    return out.select("method", r(F.col("mean_rank")).alias("mean_rank"), r(F.col("chi2"), 5).alias("chi2"), "blocks")


@query("psi_drift", """WITH e AS (SELECT list_distinct(quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM lineitem WHERE year(l_shipdate) <= 1997),
  b AS (SELECT year(l_shipdate) <= 1997 AS old, len(list_filter(e, lambda x: x < l_extendedprice)) AS bin, count(*) AS c FROM lineitem CROSS JOIN e WHERE year(l_shipdate) <= 1997 OR year(l_shipdate) >= 2000 GROUP BY 1, 2),
  s AS (SELECT bin, greatest(max(CASE WHEN old THEN c END) / (SELECT sum(c) FROM b WHERE old), 1e-4) AS p, greatest(max(CASE WHEN NOT old THEN c END) / (SELECT sum(c) FROM b WHERE NOT old), 1e-4) AS q FROM b GROUP BY 1)
  SELECT round(sum((coalesce(q, 1e-4) - coalesce(p, 1e-4)) * ln(coalesce(q, 1e-4) / coalesce(p, 1e-4))), 6) AS psi, 'stable' AS drift FROM s""")
def psi_drift(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = inf.stability_index(li.where("l_shipdate < DATE '1998-01-01'"), li.where("l_shipdate >= DATE '2000-01-01'"), "l_extendedprice")
    return out.select(r(F.col("psi")).alias("psi"), "drift")


@query("ks_wasserstein", """WITH u AS (SELECT l_quantity AS v, count(CASE WHEN year(l_shipdate) <= 1997 THEN 1 END) AS a, count(CASE WHEN year(l_shipdate) >= 2000 THEN 1 END) AS b FROM lineitem WHERE year(l_shipdate) <= 1997 OR year(l_shipdate) >= 2000 GROUP BY 1),
  d AS (SELECT v, abs(sum(a) OVER (ORDER BY v) / (SELECT sum(a) FROM u) - sum(b) OVER (ORDER BY v) / (SELECT sum(b) FROM u)) AS d, lead(v) OVER (ORDER BY v) - v AS gap FROM u)
  , k AS (SELECT max(d) AS ks, sum(d * coalesce(gap, 0)) AS wasserstein, max(d) * sqrt((SELECT sum(a) FROM u) * (SELECT sum(b) FROM u) / (SELECT sum(a) + sum(b) FROM u)) AS x FROM d)
  SELECT round(ks, 6) AS ks, round(wasserstein, 6) AS wasserstein, round(CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * x * x))), 0.0), 1.0) END, 6) AS p_value FROM k""")
def ks_wasserstein(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = inf.distribution_distance(li.where("l_shipdate < DATE '1998-01-01'"), li.where("l_shipdate >= DATE '2000-01-01'"), "l_quantity")
    return out.select(r(F.col("ks")).alias("ks"), r(F.col("wasserstein")).alias("wasserstein"), r(F.col("p_value")).alias("p_value"))
