"""Queries of evaluation tables and of inference on prediction rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.operators import inference as inf
from loomspan.operators import intervals as iv
from loomspan.operators import timeseries as ts
from loomspan.plans.base import PRED, predictions, r
from loomspan.plans.interval_queries import _threshold
from loomspan.plans.registry import query
from loomspan.plans.split_queries import draw_sql

_RECENT = f"{PRED}, recent AS (SELECT *, y >= lo AND y <= hi AS inside, y < lo AS miss FROM pred WHERE test_year >= 1999)"


def _recent(spark, sf_dir):
    y, lo, hi = F.col("y"), F.col("lo"), F.col("hi")
    return predictions(spark, sf_dir).where("test_year >= 1999").withColumns({"inside": (y >= lo) & (y <= hi), "miss": y < lo})


def _share(c):
    return F.avg(F.when(c, 1.0).otherwise(0.0))


def _all(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


@query("point_and_shortfall", f"""WITH {_RECENT} SELECT method, round(1 - sum(pow(y - pred, 2)) / (var_pop(y) * count(y)), 6) AS r2, round(avg(CASE WHEN miss THEN lo - y END), 4) AS mean_shortfall, round(avg(CASE WHEN y > hi THEN 1.0 ELSE 0.0 END), 6) AS over_rate,
  round(abs(avg(CASE WHEN inside THEN 1.0 ELSE 0.0 END) - 0.9), 6) AS abs_ace, round(100 * avg(CASE WHEN miss THEN (lo - y) / y END), 5) AS shortfall_pct FROM recent GROUP BY 1""")
def point_and_shortfall(spark, sf_dir):
    pct = F.avg(F.when(F.col("miss"), (F.col("lo") - F.col("y")) / F.col("y"))) * 100
    out = _recent(spark, sf_dir).groupBy("method").agg(*iv.interval_metrics(), *iv.point_metrics(), pct.alias("shortfall_pct"))
    return out.select("method", r(F.col("r2")).alias("r2"), r(F.col("mean_shortfall"), 4).alias("mean_shortfall"), r(F.col("over_rate")).alias("over_rate"), r(F.col("abs_ace")).alias("abs_ace"), r(F.col("shortfall_pct"), 5).alias("shortfall_pct"))


@query("year_type_evaluation", f"""WITH {_RECENT}, c AS (SELECT *, CASE WHEN size >= 40 THEN 'Extreme' WHEN size >= 20 THEN 'Moderate' ELSE 'Normal' END AS year_type, CASE test_year % 3 WHEN 0 THEN 'Warm' WHEN 1 THEN 'Cold' ELSE 'Neutral' END AS phase FROM recent)
  SELECT CASE WHEN year_type IS NULL THEN 'phase' ELSE 'year_type' END AS axis, coalesce(year_type, phase) AS class, method, count(*) AS n, round(avg(CASE WHEN inside THEN 1.0 ELSE 0.0 END), 6) AS picp, round(avg(hi - lo), 4) AS mpiw FROM c GROUP BY GROUPING SETS ((method, year_type), (method, phase))""")
def year_type_evaluation(spark, sf_dir):
    kind = F.when(F.col("size") >= 40, "Extreme").when(F.col("size") >= 20, "Moderate").otherwise("Normal")
    phase = F.when(F.col("test_year") % 3 == 0, "Warm").when(F.col("test_year") % 3 == 1, "Cold").otherwise("Neutral")
    long = _recent(spark, sf_dir).select("method", "inside", (F.col("hi") - F.col("lo")).alias("width"), kind.alias("year_type"), phase.alias("phase")).unpivot(["method", "inside", "width"], ["year_type", "phase"], "axis", "class")
    return long.groupBy("axis", "class", "method").agg(F.count(F.lit(1)).alias("n"), r(_share(F.col("inside"))).alias("picp"), r(F.avg("width"), 4).alias("mpiw"))


@query("year_weighted_miss", f"""WITH {_RECENT}, t AS (SELECT unnest([10, 20, 40]) AS threshold), y AS (SELECT method, threshold, test_year, count(*) AS n, avg(CASE WHEN miss THEN 1.0 ELSE 0.0 END) AS m FROM recent JOIN t ON size >= threshold GROUP BY 1, 2, 3)
  SELECT method, CAST(threshold AS INTEGER) AS threshold, count(*) AS years, CAST(sum(n) AS BIGINT) AS n, round(avg(m), 6) AS year_weighted, round(sum(m * n) / sum(n), 6) AS row_weighted FROM y GROUP BY 1, 2""")
def year_weighted_miss(spark, sf_dir):
    held = _recent(spark, sf_dir).withColumn("threshold", F.explode(F.array(F.lit(10), F.lit(20), F.lit(40)))).where(F.col("size") >= F.col("threshold"))
    y = held.groupBy("method", "threshold", "test_year").agg(F.count(F.lit(1)).alias("n"), _share(F.col("miss")).alias("m"))
    return y.groupBy("method", "threshold").agg(F.count(F.lit(1)).alias("years"), F.sum("n").alias("n"), r(F.avg("m")).alias("year_weighted"), r(F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("row_weighted"))


@query("bias_width_cells", f"""WITH {_RECENT}, c AS (SELECT entity % 25 AS state, test_year, avg(y - pred) AS bias, avg(hi - lo) AS width, avg(CASE WHEN miss THEN 1.0 ELSE 0.0 END) AS m FROM recent GROUP BY 1, 2)
  SELECT count(*) AS cells, round(corr(bias, width), 6) AS bias_width, round(corr(bias, m), 6) AS bias_miss, round(corr(width, m), 6) AS width_miss FROM c""")
def bias_width_cells(spark, sf_dir):
    c = _recent(spark, sf_dir).groupBy((F.col("entity") % 25).alias("state"), "test_year").agg(F.avg(F.col("y") - F.col("pred")).alias("bias"), F.avg(F.col("hi") - F.col("lo")).alias("width"), _share(F.col("miss")).alias("m"))
    return c.agg(F.count(F.lit(1)).alias("cells"), r(F.corr("bias", "width")).alias("bias_width"), r(F.corr("bias", "m")).alias("bias_miss"), r(F.corr("width", "m")).alias("width_miss"))


@query("extreme_quintile_excess", f"""WITH {_RECENT}, q AS (SELECT quantile_cont(y, 0.2) AS q FROM recent) SELECT method, count(CASE WHEN y <= q THEN 1 END) AS n_low, round(avg(CASE WHEN y <= q THEN CASE WHEN miss THEN 1.0 ELSE 0.0 END END), 6) AS low_rate,
  round(avg(CASE WHEN miss THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(CASE WHEN y <= q THEN CASE WHEN miss THEN 1.0 ELSE 0.0 END END) - avg(CASE WHEN miss THEN 1.0 ELSE 0.0 END), 6) AS excess FROM recent CROSS JOIN q GROUP BY 1""")
def extreme_quintile_excess(spark, sf_dir):
    rows = _recent(spark, sf_dir)
    q = iv.quantile_at(rows, [], "y", lambda n: F.lit(0.2)).select("q")
    low, miss = F.col("y") <= F.col("q"), F.when(F.col("miss"), 1.0).otherwise(0.0)
    return rows.crossJoin(F.broadcast(q)).groupBy("method").agg(F.count_if(low).alias("n_low"), r(F.avg(F.when(low, miss))).alias("low_rate"), r(F.avg(miss)).alias("rate"), r(F.avg(F.when(low, miss)) - F.avg(miss)).alias("excess"))


@query("within_group_ratio", f"""WITH {_RECENT}, g AS (SELECT entity, count(CASE WHEN size >= 40 THEN 1 END) AS n_x, count(CASE WHEN size < 40 THEN 1 END) AS n_o, avg(CASE WHEN size >= 40 THEN CASE WHEN miss THEN 1.0 ELSE 0.0 END END) AS x, avg(CASE WHEN size < 40 THEN CASE WHEN miss THEN 1.0 ELSE 0.0 END END) AS o FROM recent GROUP BY 1)
  SELECT entity, n_x, n_o, round(x / nullif(o, 0.0), 6) AS ratio FROM g WHERE n_x >= 10 AND n_o >= 10""")
def within_group_ratio(spark, sf_dir):
    x, miss = F.col("size") >= 40, F.when(F.col("miss"), 1.0).otherwise(0.0)
    g = _recent(spark, sf_dir).groupBy("entity").agg(F.count_if(x).alias("n_x"), F.count_if(~x).alias("n_o"), F.avg(F.when(x, miss)).alias("x"), F.avg(F.when(~x, miss)).alias("o"))
    return g.where("n_x >= 10 AND n_o >= 10").select("entity", "n_x", "n_o", r(F.try_divide("x", "o")).alias("ratio"))


@query("r2_sources", f"""WITH {_RECENT}, a AS (SELECT avg(y) AS v FROM recent GROUP BY test_year), b AS (SELECT avg(y) AS v FROM recent GROUP BY entity)
  SELECT round((SELECT var_samp(v) FROM a) / 1e4, 4) AS between_years, round((SELECT var_samp(v) FROM b) / 1e4, 4) AS between_entities, round((SELECT var_samp(y) FROM recent) / 1e4, 4) AS total""")
def r2_sources(spark, sf_dir):
    rows = _recent(spark, sf_dir)
    of = lambda key, name: rows.groupBy(key).agg(F.avg("y").alias("v")).agg(r(F.var_samp("v") / 1e4, 4).alias(name))
    return of("test_year", "between_years").crossJoin(of("entity", "between_entities")).crossJoin(rows.agg(r(F.var_samp("y") / 1e4, 4).alias("total")))


@query("residual_diagnostics", f"""WITH {_RECENT}, e AS (SELECT pred, y - pred AS e FROM recent), m AS (SELECT avg(e) AS m, stddev_pop(e) AS s FROM e), z AS (SELECT pred, e, (e - m) / s AS z FROM e CROSS JOIN m)
  SELECT count(*) AS n, round(avg(pow(z, 3)), 5) AS skew, round(avg(pow(z, 4)) - 3, 5) AS excess_kurtosis, round(count(*) / 6.0 * (pow(avg(pow(z, 3)), 2) + pow(avg(pow(z, 4)) - 3, 2) / 4) / 1000, 3) AS jarque_bera_k, round(regr_slope(z * z, pred), 8) AS variance_slope FROM z""")
def residual_diagnostics(spark, sf_dir):
    rows = _recent(spark, sf_dir).select("pred", (F.col("y") - F.col("pred")).alias("e"))
    m = rows.agg(F.avg("e").alias("m"), F.stddev_pop("e").alias("s"))
    z = rows.crossJoin(F.broadcast(m)).withColumn("z", (F.col("e") - F.col("m")) / F.col("s"))
    power = lambda k: F.avg(F.pow("z", F.lit(k)))
    n = F.count(F.lit(1))
    return z.agg(n.alias("n"), r(power(3), 5).alias("skew"), r(power(4) - 3, 5).alias("excess_kurtosis"), r(n / 6 * (power(3) * power(3) + (power(4) - 3) * (power(4) - 3) / 4) / 1000, 3).alias("jarque_bera_k"), r(F.regr_slope(F.col("z") * F.col("z"), F.col("pred")), 8).alias("variance_slope"))


_AXES = {"stratum": "stratum", "test_year": "CAST(test_year AS VARCHAR)", "size_band": "CASE WHEN size >= 40 THEN 'large' WHEN size >= 20 THEN 'middle' ELSE 'small' END", "line": "CAST(line AS VARCHAR)", "entity_band": "CAST(entity % 5 AS VARCHAR)", "order_band": "CAST(okey % 4 AS VARCHAR)", "width_band": "CASE WHEN hi - lo >= 10000 THEN 'wide' ELSE 'narrow' END", "parity": "CAST((okey + line) % 2 AS VARCHAR)"}


@query("conditional_coverage_8_axes", f"WITH {_RECENT}, l AS ({' UNION ALL '.join(f'''SELECT method, '{a}' AS axis, {e} AS stratum, CASE WHEN inside THEN 1.0 ELSE 0.0 END AS c FROM recent''' for a, e in _AXES.items())})," + """
  g AS (SELECT method, axis, stratum, count(*) AS n, avg(c) AS coverage FROM l GROUP BY 1, 2, 3 HAVING count(*) >= 20)
  SELECT method, axis, stratum, n, round(coverage, 6) AS coverage, CAST(rank() OVER (PARTITION BY axis, stratum ORDER BY coverage) AS INTEGER) AS rank, row_number() OVER (PARTITION BY method, axis ORDER BY coverage, stratum) = 1 AS worst FROM g""")
def conditional_coverage_8_axes(spark, sf_dir):
    size, width = F.col("size"), F.col("hi") - F.col("lo")
    rows = _recent(spark, sf_dir).withColumns({
        "size_band": F.when(size >= 40, "large").when(size >= 20, "middle").otherwise("small"), "entity_band": F.col("entity") % 5, "order_band": F.col("okey") % 4,
        "width_band": F.when(width >= 10000, "wide").otherwise("narrow"), "parity": (F.col("okey") + F.col("line")) % 2,
    })
    return iv.conditional_coverage(rows, list(_AXES), "method").withColumn("coverage", r(F.col("coverage")))


@query("coverage_wald", f"""WITH {_RECENT}, c AS (SELECT method, count(*) AS n, avg(CASE WHEN inside THEN 1.0 ELSE 0.0 END) AS p FROM recent GROUP BY 1)
  SELECT method, n, round(greatest(p - 1.959963984540054 * sqrt(p * (1 - p) / n), 0.0), 6) AS wald_lo, round(least(p + 1.959963984540054 * sqrt(p * (1 - p) / n), 1.0), 6) AS wald_hi FROM c""")
def coverage_wald(spark, sf_dir):
    c = _recent(spark, sf_dir).groupBy("method").agg(F.count(F.lit(1)).alias("n"), _share(F.col("inside")).alias("p"))
    return c.select("method", "n", *iv.coverage_interval(F.col("p"), F.col("n"))).withColumns({k: r(F.col(k)) for k in ("wald_lo", "wald_hi")})


@query("yearly_bias_slope", f"""WITH {PRED}, b AS (SELECT method, test_year, avg(y - pred) AS bias FROM pred GROUP BY 1, 2), s AS (SELECT method, regr_slope(bias, test_year) AS slope FROM b GROUP BY 1)
  SELECT p.method, round(max(slope), 5) AS slope, round(1 - sum(pow(y - pred - bias, 2)) / (var_pop(y) * count(*)), 6) AS debiased_r2 FROM pred p JOIN b ON b.method = p.method AND b.test_year = p.test_year JOIN s ON s.method = p.method GROUP BY 1""")
def yearly_bias_slope(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    b = rows.groupBy("method", "test_year").agg(F.avg(F.col("y") - F.col("pred")).alias("bias"))
    s = b.groupBy("method").agg(r(F.regr_slope("bias", "test_year"), 5).alias("slope"))
    e = F.col("y") - F.col("pred") - F.col("bias")
    r2 = rows.join(b, ["method", "test_year"]).groupBy("method").agg(r(1 - F.sum(e * e) / (F.var_pop("y") * F.count(F.lit(1)))).alias("debiased_r2"))
    return s.join(r2, "method")


@query("seed_robustness", f"""WITH {PRED}, s AS (SELECT method, CAST({draw_sql('0', 'okey', 'line', 5)} AS INTEGER) AS seed, sqrt(avg(CASE WHEN test_year = 1999 THEN pow(y - pred, 2) END)) AS v, sqrt(avg(CASE WHEN test_year >= 2000 THEN pow(y - pred, 2) END)) AS t FROM pred GROUP BY 1, 2),
  k AS (SELECT *, rank() OVER (ORDER BY v) AS rv, rank() OVER (ORDER BY t) AS rt FROM s)
  SELECT count(*) AS runs, round(avg(v), 4) AS mean_val, round(stddev_samp(v), 4) AS sd_val, round(avg(t), 4) AS mean_test, round(stddev_samp(t), 4) AS sd_test, round(corr(rv, rt), 6) AS spearman FROM k""")
def seed_robustness(spark, sf_dir):
    e = (F.col("y") - F.col("pred")) * (F.col("y") - F.col("pred"))
    seed = inf.draw(F.lit(0), F.col("okey"), F.col("line").cast("bigint"), F.lit(5))
    s = predictions(spark, sf_dir).groupBy("method", seed.alias("seed")).agg(F.sqrt(F.avg(F.when(F.col("test_year") == 1999, e))).alias("v"), F.sqrt(F.avg(F.when(F.col("test_year") >= 2000, e))).alias("t"))
    # one row a run: their number doesn't grow with the data
    k = s.withColumns({"rv": F.rank().over(Window.orderBy("v")), "rt": F.rank().over(Window.orderBy("t"))})
    return k.agg(F.count(F.lit(1)).alias("runs"), *[r(f(c), 4).alias(f"{n}_{m}") for c, m in (("v", "val"), ("t", "test")) for f, n in ((F.avg, "mean"), (F.stddev, "sd"))], r(F.corr("rv", "rt")).alias("spearman"))


@query("leave_out_macro", f"""WITH {_RECENT}, g AS (SELECT method, entity, avg(CASE WHEN inside THEN 1.0 ELSE 0.0 END) AS p, count(*) AS n FROM recent GROUP BY 1, 2)
  SELECT method, count(*) AS folds, round(avg(p), 6) AS macro, round(avg(p) - 1.96 * stddev_samp(p) / sqrt(count(*)), 6) AS lo, round(avg(p) + 1.96 * stddev_samp(p) / sqrt(count(*)), 6) AS hi, round(sum(p * n) / sum(n), 6) AS pooled FROM g GROUP BY 1""")
def leave_out_macro(spark, sf_dir):
    g = _recent(spark, sf_dir).groupBy("method", "entity").agg(_share(F.col("inside")).alias("p"), F.count(F.lit(1)).alias("n"))
    k, half = F.count(F.lit(1)), 1.96 * F.stddev("p") / F.sqrt(F.count(F.lit(1)))
    return g.groupBy("method").agg(k.alias("folds"), r(F.avg("p")).alias("macro"), r(F.avg("p") - half).alias("lo"), r(F.avg("p") + half).alias("hi"), r(F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("pooled"))


def _boot_sql(cluster: str, sums: dict[str, str], stats: dict[str, str], draws: int) -> str:
    agg = ", ".join(f"{v} AS {k}" for k, v in sums.items())
    total = ", ".join(f"sum({k}) AS {k}" for k in sums)
    each = " UNION ALL ".join(f"SELECT '{k}' AS stat, CAST({v} AS DOUBLE) AS b FROM d" for k, v in stats.items())
    whole = " UNION ALL ".join(f"SELECT '{k}' AS stat, CAST({v} AS DOUBLE) AS estimate FROM w" for k, v in stats.items())
    return f"""s AS (SELECT {cluster} AS c, {agg} FROM recent GROUP BY 1), h AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS i FROM s), k AS (SELECT count(*) AS k FROM s),
  p AS (SELECT draw, {draw_sql(42, 'draw', 'slot', 1).replace('% 1', '% k')} AS i FROM k CROSS JOIN (SELECT unnest(range(0, {draws})) AS draw) CROSS JOIN (SELECT i AS slot FROM h)),
  d AS (SELECT draw, {total} FROM p JOIN h USING (i) GROUP BY 1), w AS (SELECT {total} FROM s), b AS ({each}), e AS ({whole}),
  o AS (SELECT stat, quantile_cont(b, 0.025) AS lo, quantile_cont(b, 0.975) AS hi, stddev_samp(b) AS se, least(1.0, greatest(2 * least(avg(CASE WHEN b <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN b >= 0 THEN 1.0 ELSE 0.0 END)), 1 / {draws})) AS pv, count(b) AS n_draws FROM b WHERE b IS NOT NULL GROUP BY 1)
  SELECT stat, round(estimate, 4) AS estimate, CASE WHEN ok THEN round(lo, 4) END AS lo, CASE WHEN ok THEN round(hi, 4) END AS hi, CASE WHEN ok THEN round(se, 4) END AS se, CASE WHEN ok THEN round(pv, 6) END AS p_value, n_draws, ok AS supported FROM (SELECT *, k >= 5 AND n_draws >= 0.8 * {draws} AS ok FROM e JOIN o USING (stat) CROSS JOIN k)"""


_SUMS = {"n": "count(*)", "e": "sum(y - pred)", "ee": "sum(pow(y - pred, 2))", "ae": "sum(abs(y - pred))", "m": "sum(CASE WHEN miss THEN 1 ELSE 0 END)", "w": "sum(hi - lo)", "sy": "sum(y)", "yy": "sum(y * y)"}
_STATS = {"rmse": "sqrt(ee / n)", "mae": "ae / n", "bias": "e / n", "miss_rate": "m / n", "width": "w / n", "r2": "1 - ee / (yy - sy * sy / n)"}


def _boot(rows, cluster, draws):
    e = F.col("y") - F.col("pred")
    sums = {"n": F.count(F.lit(1)), "e": F.sum(e), "ee": F.sum(e * e), "ae": F.sum(F.abs(e)), "m": F.sum(F.col("miss").cast("int")), "w": F.sum(F.col("hi") - F.col("lo")), "sy": F.sum("y"), "yy": F.sum(F.col("y") * F.col("y"))}
    n = F.col("n")
    stats = {"rmse": F.sqrt(F.col("ee") / n), "mae": F.col("ae") / n, "bias": F.col("e") / n, "miss_rate": F.col("m") / n, "width": F.col("w") / n, "r2": 1 - F.col("ee") / (F.col("yy") - F.col("sy") * F.col("sy") / n)}
    out = inf.bootstrap_table(rows, cluster, sums, stats, draws)
    return out.withColumns({c: r(F.col(c), 4) for c in ("estimate", "lo", "hi", "se")} | {"p_value": r(F.col("p_value"))})


for _name, _key, _expr in (("bootstrap_by_entity", "entity", "entity"), ("bootstrap_by_year_block", "block", "test_year * 100 + entity % 3")):

    @query(_name, f"WITH {_RECENT}, " + _boot_sql(_expr, _SUMS, _STATS, 2000))
    def bootstrap(spark, sf_dir, key=_key):
        rows = _recent(spark, sf_dir).withColumn("block", F.col("test_year") * 100 + F.col("entity") % 3)
        return _boot(rows, key, 2000)


@query("paired_difference_bootstrap", f"WITH {_RECENT}, " + _boot_sql("entity", {"n": "count(*)", "d": "sum(abs(y - pred) - abs(y - size * 900.0))"}, {"mae_difference": "d / n"}, 2000))
def paired_difference_bootstrap(spark, sf_dir):
    d = F.abs(F.col("y") - F.col("pred")) - F.abs(F.col("y") - F.col("size") * 900.0)
    out = inf.bootstrap_table(_recent(spark, sf_dir), "entity", {"n": F.count(F.lit(1)), "d": F.sum(d)}, {"mae_difference": F.col("d") / F.col("n")}, 2000)
    return out.withColumns({c: r(F.col(c), 4) for c in ("estimate", "lo", "hi", "se")} | {"p_value": r(F.col("p_value"))})


def t_two_sided_sql(t: str, df: str) -> str:
    h = f"(atan(abs({t}) / sqrt({df})) / 2000)"
    area = f"list_sum(list_transform(range(0, 2001), lambda k: (CASE WHEN k = 0 OR k = 2000 THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END) * pow(cos(k * {h}), {df} - 1))) * {h} / 3"
    return f"greatest(1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * {area}, 0.0)"


def gamma_p_sql(a: str, x: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN 0.0 ELSE least(list_sum(list_transform(range(0, CAST({x} + 20 * sqrt({x}) + 61 AS BIGINT)), lambda i: exp(({a} + i) * ln({x}) - {x} - lgamma({a} + i + 1)))), 1.0) END"


def normal_two_sided_sql(z: str) -> str:
    return f"1 - {gamma_p_sql('0.5', f'(({z}) * ({z}) / 2)')}"


def binomial_sql(k: str, n: str) -> str:
    return f"least(2 * list_sum(list_transform(range(0, CAST(least({k}, {n} - {k}) AS BIGINT) + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2)))), 1.0)"


_PAIRS = f"{_RECENT}, d AS (SELECT entity, avg(abs(y - pred) - abs(y - size * 900.0)) AS d FROM recent GROUP BY 1)"


def _pairs(spark, sf_dir):
    return _recent(spark, sf_dir).select("entity", "test_year", F.abs(F.col("y") - F.col("pred")).alias("a"), F.abs(F.col("y") - F.col("size") * 900.0).alias("b"))


@query("paired_block_test", f"""WITH {_PAIRS}, o AS (SELECT count(*) AS n, avg(d) AS m, stddev_samp(d) AS s, count(CASE WHEN d > 0 THEN 1 END) AS wins, count(CASE WHEN d < 0 THEN 1 END) AS losses FROM d), t AS (SELECT *, m / s * sqrt(n) AS t FROM o)
  SELECT n, round(m, 4) AS mean_difference, round(t, 6) AS t, round({t_two_sided_sql('t', '(n - 1)')}, 6) AS p_value, round(m / s, 6) AS cohen_dz, wins, losses, round({binomial_sql('wins', '(wins + losses)')}, 6) AS sign_p FROM t""")
def paired_block_test(spark, sf_dir):
    out = inf.paired_test(_pairs(spark, sf_dir), "entity", "a", "b")
    return out.withColumns({"mean_difference": r(F.col("mean_difference"), 4)} | {c: r(F.col(c)) for c in ("t", "p_value", "cohen_dz", "sign_p")})


@query("wilcoxon_test", f"""WITH {_PAIRS}, k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk FROM d WHERE d <> 0), o AS (SELECT count(*) AS n, CAST(least(coalesce(sum(CASE WHEN d > 0 THEN rk END), 0), coalesce(sum(CASE WHEN d < 0 THEN rk END), 0)) AS DOUBLE) AS w FROM k)
  SELECT n, w, round({normal_two_sided_sql('(w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0)')}, 6) AS p_value FROM o""")
def wilcoxon_test(spark, sf_dir):
    return inf.signed_rank(_pairs(spark, sf_dir), "entity", "a", "b").withColumn("p_value", r(F.col("p_value")))


@query("kruskal_wallis", f"""WITH {_RECENT}, y AS (SELECT method, test_year, entity % 10 AS g, avg(y - pred) AS v FROM recent GROUP BY 1, 2, 3), k AS (SELECT method, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk, count(*) OVER () AS n FROM y),
  s AS (SELECT method, count(*) AS m, sum(rk) AS s, max(n) AS n FROM k GROUP BY 1), h AS (SELECT 12.0 / (max(n) * (max(n) + 1)) * sum(s * s / m) - 3 * (max(n) + 1) AS h, count(*) - 1 AS df FROM s)
  SELECT round(h, 5) AS h, df, round(1 - {gamma_p_sql('(df / 2.0)', '(h / 2)')}, 6) AS p_value FROM h""")
def kruskal_wallis(spark, sf_dir):
    y = _recent(spark, sf_dir).groupBy("method", "test_year", F.col("entity") % 10).agg(F.avg(F.col("y") - F.col("pred")).alias("v"))
    return inf.kruskal(y, "method", "v").select(r(F.col("h"), 5).alias("h"), "df", r(F.col("p_value")).alias("p_value"))


_FRIEDMAN = f"""{PRED}, s AS (SELECT test_year, method, avg(abs(y - pred)) AS e FROM pred GROUP BY 1, 2), k AS (SELECT *, rank() OVER (PARTITION BY test_year ORDER BY e) + (count(*) OVER (PARTITION BY test_year, e) - 1) / 2.0 AS rk FROM s),
  m AS (SELECT method, avg(rk) AS mean_rank, count(*) AS blocks FROM k GROUP BY 1), t AS (SELECT count(*) AS k, sum(mean_rank * mean_rank) AS ss, max(blocks) AS b FROM m), x AS (SELECT 12.0 * b / (k * (k + 1)) * (ss - k * pow(k + 1, 2) / 4.0) AS chi2, k - 1 AS df FROM t)"""


def _friedman(spark, sf_dir):
    s = predictions(spark, sf_dir).groupBy("test_year", "method").agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("e"))
    return inf.friedman(s, "test_year", "method", "e", ts.average_rank)


@query("friedman_test", f"WITH {_FRIEDMAN} SELECT round(chi2, 5) AS chi2, df, round(1 - {gamma_p_sql('(df / 2.0)', '(chi2 / 2)')}, 6) AS p_value FROM x")
def friedman_test(spark, sf_dir):
    from loomspan.functions import special

    one = _friedman(spark, sf_dir).agg(F.max("chi2").alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"))
    return one.select(r(F.col("chi2"), 5).alias("chi2"), "df", r(special.chi2_sf(F.col("chi2"), F.col("df"))).alias("p_value"))


#: 5 % point of the range of three normal variables over sqrt(2) (a fixed value).
_NEMENYI_3 = 2.3437005


@query("nemenyi_pairs", f"""WITH {_FRIEDMAN} SELECT a.method AS "left", b.method AS "right", round(abs(a.mean_rank - b.mean_rank), 6) AS difference, round({_NEMENYI_3} * sqrt(3 * 4 / (6.0 * a.blocks)), 6) AS cd, abs(a.mean_rank - b.mean_rank) > {_NEMENYI_3} * sqrt(3 * 4 / (6.0 * a.blocks)) AS significant FROM m a JOIN m b ON a.method < b.method""")
def nemenyi_pairs(spark, sf_dir):
    return inf.nemenyi(_friedman(spark, sf_dir), "method").withColumns({c: r(F.col(c)) for c in ("difference", "cd")})


@query("evaluation_driver", f"""WITH {_PAIRS}, o AS (SELECT count(*) AS n, avg(d) AS m, stddev_samp(d) AS s, count(CASE WHEN d > 0 THEN 1 END) AS wins, count(CASE WHEN d < 0 THEN 1 END) AS losses FROM d), t AS (SELECT *, m / s * sqrt(n) AS t FROM o),
  rk AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk FROM d WHERE d <> 0), w AS (SELECT count(*) AS n, least(coalesce(sum(CASE WHEN d > 0 THEN rk END), 0), coalesce(sum(CASE WHEN d < 0 THEN rk END), 0)) AS w FROM rk),
  p AS (SELECT 'paired_t' AS test, {t_two_sided_sql('t', '(n - 1)')} AS p FROM t UNION ALL SELECT 'sign', {binomial_sql('wins', '(wins + losses)')} FROM t UNION ALL SELECT 'wilcoxon', {normal_two_sided_sql('(w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0)')} FROM w),
  q AS (SELECT *, row_number() OVER (ORDER BY p, test) AS r, count(*) OVER () AS k FROM p)
  SELECT test, round(p, 6) AS p, round(max(least(p * (k - r + 1), 1.0)) OVER (ORDER BY r), 6) AS holm, round(min(least(p * k / r, 1.0)) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS bh FROM q""")
def evaluation_driver(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    one = inf.paired_test(pairs, "entity", "a", "b")
    tests = _all([
        one.select(F.lit("paired_t").alias("test"), F.col("p_value").alias("p")), one.select(F.lit("sign").alias("test"), F.col("sign_p").alias("p")),
        inf.signed_rank(pairs, "entity", "a", "b").select(F.lit("wilcoxon").alias("test"), F.col("p_value").alias("p")),
    ])
    return inf.adjust_p(tests).withColumns({c: r(F.col(c)) for c in ("p", "holm", "bh")})


_S = "greatest(lo - y, y - hi)"


@query("conformal_stratified", f"""WITH {PRED}, cal AS (SELECT *, CAST(entity % 7 AS BIGINT) AS stage FROM pred WHERE test_year = 1999 AND entity % 7 <> 3), {_threshold('g', 'cal', _S, '0.1', 'stage')}
  SELECT p.entity % 7 AS stage, count(*) AS n, round(avg(hi - lo + 2 * coalesce(g.q, 0.0)), 4) AS width, round(avg(CASE WHEN y >= lo - coalesce(g.q, 0.0) AND y <= hi + coalesce(g.q, 0.0) THEN 1.0 ELSE 0.0 END), 6) AS picp FROM pred p LEFT JOIN g ON g.stage = p.entity % 7 WHERE test_year >= 2000 GROUP BY 1""")
def conformal_stratified(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("stage", F.col("entity") % 7)
    out = iv.conformal_stratified(p.where("test_year = 1999 AND stage <> 3"), p.where("test_year >= 2000"), "stage")
    y = F.col("y")
    return out.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("hi") - F.col("lo")), 4).alias("width"), r(_share((y >= F.col("lo")) & (y <= F.col("hi")))).alias("picp"))


@query("repaired_bounds", f"""WITH {_RECENT}, c AS (SELECT method, lo + (size % 7) * 900 AS lo, hi FROM recent) SELECT method, count(CASE WHEN lo > hi THEN 1 END) AS crossed, round(avg(CASE WHEN lo > hi THEN 0.0 ELSE hi - lo END), 4) AS width FROM c GROUP BY 1""")
def repaired_bounds(spark, sf_dir):
    c = _recent(spark, sf_dir).withColumn("lo", F.col("lo") + (F.col("size") % 7) * 900).withColumn("crossed", F.col("lo") > F.col("hi"))
    return iv.repair_bounds(c).groupBy("method").agg(F.count_if("crossed").alias("crossed"), r(F.avg(F.col("hi") - F.col("lo")), 4).alias("width"))


@query("calibration_checks", f"""WITH {_RECENT}, m AS (SELECT 'a_raw' AS method, okey, line, lo, hi FROM recent UNION ALL SELECT 'b_wide', okey, line, lo - 10, hi + 10 FROM recent UNION ALL SELECT 'c_crossed', okey, line, hi + 1, lo FROM recent)
  SELECT m.method, count(*) AS rows, count(CASE WHEN m.hi < m.lo THEN 1 END) AS negative_widths, CAST(0 AS BIGINT) AS nulls, count(CASE WHEN m.lo <> b.lo OR m.hi <> b.hi THEN 1 END) AS differs, count(CASE WHEN m.hi < m.lo THEN 1 END) = 0 AS ok FROM m JOIN recent b ON b.okey = m.okey AND b.line = m.line GROUP BY 1""")
def calibration_checks(spark, sf_dir):
    rows = _recent(spark, sf_dir).select("okey", "line", "lo", "hi")
    named = lambda name, lo, hi: rows.select(F.lit(name).alias("method"), "okey", "line", lo.alias("lo"), hi.alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    return iv.calibration_checks(_all([named("a_raw", lo, hi), named("b_wide", lo - 10, hi + 10), named("c_crossed", hi + 1, lo)]), "method", ["okey", "line"])


@query("run_sensitivity", f"""WITH {_RECENT}, k AS (SELECT *, CASE WHEN size >= 40 THEN 'extreme' WHEN size >= 20 THEN 'moderate' ELSE 'normal' END AS class FROM recent), c AS (SELECT class, entity, avg(CASE WHEN inside THEN 1.0 ELSE 0.0 END) AS p, count(*) AS n FROM k GROUP BY 1, 2),
  a AS (SELECT class, CAST(sum(n) AS BIGINT) AS n, sum(p * n) / sum(n) AS picp, stddev_samp(p) / sqrt(count(*)) AS se FROM c GROUP BY 1)
  SELECT class, n, round(picp, 6) AS picp, round(picp - 1.96 * se, 6) AS lo, round(picp + 1.96 * se, 6) AS hi, round(picp - (SELECT picp FROM a WHERE class = 'normal'), 6) AS contrast FROM a""")
def run_sensitivity(spark, sf_dir):
    kind = F.when(F.col("size") >= 40, "extreme").when(F.col("size") >= 20, "moderate").otherwise("normal")
    c = _recent(spark, sf_dir).groupBy(kind.alias("class"), "entity").agg(_share(F.col("inside")).alias("p"), F.count(F.lit(1)).alias("n"))
    a = c.groupBy("class").agg(F.sum("n").alias("n"), (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("picp"), (F.stddev("p") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    base = a.where("class = 'normal'").select(F.col("picp").alias("base"))
    half = 1.96 * F.col("se")
    return a.crossJoin(F.broadcast(base)).select("class", "n", r(F.col("picp")).alias("picp"), r(F.col("picp") - half).alias("lo"), r(F.col("picp") + half).alias("hi"), r(F.col("picp") - F.col("base")).alias("contrast"))


@query("cell_fallback", f"""WITH {_RECENT}, c AS (SELECT method, test_year, entity % 5 AS cell, count(*) AS n, avg(CASE WHEN miss THEN 1.0 ELSE 0.0 END) AS m, avg(hi - lo) AS w FROM recent GROUP BY 1, 2, 3) SELECT method, count(*) AS cells, round(sum(m * n) / sum(n), 6) AS miss, round(sum(w * n) / sum(n), 4) AS width FROM c GROUP BY 1""")
def cell_fallback(spark, sf_dir):
    c = _recent(spark, sf_dir).groupBy("method", "test_year", (F.col("entity") % 5).alias("cell")).agg(F.count(F.lit(1)).alias("n"), _share(F.col("miss")).alias("m"), F.avg(F.col("hi") - F.col("lo")).alias("w"))
    mean = lambda v: F.sum(F.col(v) * F.col("n")) / F.sum("n")
    return c.groupBy("method").agg(F.count(F.lit(1)).alias("cells"), r(mean("m")).alias("miss"), r(mean("w"), 4).alias("width"))


@query("block_delta", f"""WITH {_RECENT}, a AS (SELECT test_year, sqrt(avg(pow(y - pred, 2))) AS with_block, sqrt(avg(pow(y - size * 900.0, 2))) AS without_block FROM recent GROUP BY 1)
  SELECT test_year, round(with_block, 4) AS with_block, round(without_block, 4) AS without_block, round(with_block - without_block, 4) AS delta, CASE WHEN with_block < without_block THEN 'helps' ELSE 'hurts' END AS verdict FROM a""")
def block_delta(spark, sf_dir):
    rmse = lambda p: F.sqrt(F.avg((F.col("y") - p) * (F.col("y") - p)))
    a = _recent(spark, sf_dir).groupBy("test_year").agg(rmse(F.col("pred")).alias("w"), rmse(F.col("size") * 900.0).alias("o"))
    return a.select("test_year", r(F.col("w"), 4).alias("with_block"), r(F.col("o"), 4).alias("without_block"), r(F.col("w") - F.col("o"), 4).alias("delta"), F.when(F.col("w") < F.col("o"), "helps").otherwise("hurts").alias("verdict"))


def _uniform_sql(seed: int, slot: str, draw: str, prime: int = inf.PRIME) -> tuple[str, str]:
    """Columns h and g, and the whole number made from them, of the row bootstrap's hash."""
    h = f"({seed} + {draw} * 7919 + ({slot} % {prime}) * 104729) % {prime}"
    g = f"((h * h + ({slot} % {prime})) % {prime})"
    return h, f"(((({g} * {g} + {draw} * 48271 + 11) % {prime}) * 69621 + h) % {prime})"


_H, _U = _uniform_sql(42, "slot", "draw")
_LIMITS = ", ".join(map(str, inf.poisson_limits()))


@query("row_paired_bootstrap", f"""WITH {_RECENT}, x AS (SELECT okey * 8 + line AS slot, y, pred AS a, size * 900.0 AS b FROM recent),
  d AS (SELECT *, {_H} AS h FROM x CROSS JOIN (SELECT unnest(range(0, 2000)) AS draw)), u AS (SELECT *, {_U} AS u FROM d),
  w AS (SELECT draw, {' + '.join(f'(u >= {v})::INT' for v in inf.poisson_limits())} AS w, y, a, b FROM u UNION ALL SELECT -1, 1, y, a, b FROM x),
  s AS (SELECT draw, sum(w) AS n, sum(w * abs(y - a)) AS ma, sum(w * abs(y - b)) AS mb, sum(w * pow(y - a, 2)) AS sa, sum(w * pow(y - b, 2)) AS sb, sum(w * y) AS sy, sum(w * y * y) AS syy FROM w GROUP BY 1 HAVING sum(w) > 0),
  t AS (SELECT draw, 'rmse' AS stat, sqrt(sa / n) AS a, sqrt(sb / n) AS b FROM s UNION ALL SELECT draw, 'mae', ma / n, mb / n FROM s UNION ALL SELECT draw, 'r2', 1 - sa / (syy - sy * sy / n), 1 - sb / (syy - sy * sy / n) FROM s)
  SELECT stat, round(max(a) FILTER (draw = -1), 4) AS a, round(max(b) FILTER (draw = -1), 4) AS b, round(max(b - a) FILTER (draw = -1), 4) AS delta,
         round(quantile_cont(b - a, 0.025) FILTER (draw >= 0), 4) AS lo, round(quantile_cont(b - a, 0.975) FILTER (draw >= 0), 4) AS hi FROM t GROUP BY 1""")
def row_paired_bootstrap(spark, sf_dir):
    rows = _recent(spark, sf_dir).select((F.col("okey") * 8 + F.col("line")).alias("slot"), "y", "pred", (F.col("size") * 900.0).alias("flat"))
    return inf.row_paired_bootstrap(rows, "slot", "y", "pred", "flat").withColumns({c: r(F.col(c), 4) for c in ("a", "b", "delta", "lo", "hi")})


@query("cluster_robust_panel", f"""WITH {PRED}, x AS (SELECT entity AS c, y / 1000 AS y, size - avg(size) OVER () AS p, test_year - avg(test_year) OVER () AS q, avg(size) OVER () AS mp, avg(test_year) OVER () AS mq FROM pred),
  m AS (SELECT count(*) AS n, avg(y) AS my, var_pop(y) AS vy, max(mp) AS mp, max(mq) AS mq, sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(p * y) AS py, sum(q * y) AS qy FROM x),
  b AS (SELECT *, (qq * py - pq * qy) / (pp * qq - pq * pq) AS b1, (pp * qy - pq * py) / (pp * qq - pq * pq) AS b2, pp * qq - pq * pq AS det FROM m),
  u AS (SELECT x.c, p, q, y - my - b1 * p - b2 * q AS u FROM x CROSS JOIN b), s AS (SELECT c, sum(u) AS s0, sum(p * u) AS s1, sum(q * u) AS s2, sum(u * u) AS uu FROM u GROUP BY 1),
  t AS (SELECT count(*) AS g, sum(uu) AS uu, sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s0 * s2) AS m02, sum(s1 * s1) AS m11, sum(s1 * s2) AS m12, sum(s2 * s2) AS m22 FROM s),
  v AS (SELECT *, qq / det AS i11, -pq / det AS i12, pp / det AS i22, g / (g - 1.0) * (n - 1.0) / (n - 3.0) AS f FROM b CROSS JOIN t),
  e AS (SELECT *, f * (i11 * i11 * m11 + 2 * i11 * i12 * m12 + i12 * i12 * m22) AS v11, f * (i12 * i12 * m11 + 2 * i12 * i22 * m12 + i22 * i22 * m22) AS v22, f * (i11 * i12 * m11 + (i11 * i22 + i12 * i12) * m12 + i12 * i22 * m22) AS v12,
        f * m00 / n / n AS v00, f * (i11 * m01 + i12 * m02) / n AS v01, f * (i12 * m01 + i22 * m02) / n AS v02 FROM v),
  o AS (SELECT 'size' AS term, b1 AS coefficient, sqrt(v11) AS se, g, n, uu, vy FROM e UNION ALL SELECT 'test_year', b2, sqrt(v22), g, n, uu, vy FROM e
        UNION ALL SELECT 'intercept', my - b1 * mp - b2 * mq, sqrt(v00 + mp * mp * v11 + mq * mq * v22 - 2 * mp * v01 - 2 * mq * v02 + 2 * mp * mq * v12), g, n, uu, vy FROM e)
  SELECT term, round(coefficient, 5) AS coefficient, round(se, 5) AS std_error, round(coefficient / se, 3) AS t, round({t_two_sided_sql('(coefficient / se)', '(g - 1)')}, 6) AS p_value, round(1 - uu / (n * vy), 6) AS r_squared, n, g AS clusters, true AS supported FROM o""")
def cluster_robust_panel(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("y", F.col("y") / 1000)
    out = inf.cluster_robust_ols(rows, "entity", ["size", "test_year"], "y")
    return out.select("term", r(F.col("coefficient"), 5).alias("coefficient"), r(F.col("std_error"), 5).alias("std_error"), r(F.col("t"), 3).alias("t"), r(F.col("p_value")).alias("p_value"), r(F.col("r_squared")).alias("r_squared"), "n", "clusters", "supported")


_WINKLER = "hi - lo + 20 * CASE WHEN y < lo THEN lo - y WHEN y > hi THEN y - hi ELSE 0 END"


@query("two_arm_verdict", f"""WITH {_RECENT}, x AS (SELECT min(entity) AS entity, avg({_WINKLER}) AS a, avg({_WINKLER.replace('hi', '(hi + 200)').replace('lo', '(lo - 200)')}) AS b FROM recent GROUP BY okey, line), d AS (SELECT entity, avg(a - b) AS d FROM x GROUP BY 1),
  o AS (SELECT count(*) AS n, avg(d) AS m, stddev_samp(d) AS s, count(CASE WHEN d > 0 THEN 1 END) AS wins, count(CASE WHEN d < 0 THEN 1 END) AS losses FROM d), t AS (SELECT *, m / s * sqrt(n) AS t FROM o),
  p AS (SELECT *, {t_two_sided_sql('t', '(n - 1)')} AS p FROM t), w AS (SELECT count(*) AS rows, avg(a) AS la, avg(b) AS lb FROM x)
  SELECT rows, n AS blocks, round(la, 4) AS loss_a, round(lb, 4) AS loss_b, round(m, 4) AS mean_difference, round(t, 5) AS t, round(p, 6) AS p_value, CASE WHEN p < 0.05 THEN CASE WHEN m < 0 THEN 'a' ELSE 'b' END ELSE 'tie' END AS verdict FROM p CROSS JOIN w""")
def two_arm_verdict(spark, sf_dir):
    rows = _recent(spark, sf_dir)
    wide = rows.withColumns({"lo": F.col("lo") - 200, "hi": F.col("hi") + 200})
    arms = [df.groupBy("okey", "line").agg(F.min("entity").alias("entity"), F.avg(F.expr(_WINKLER)).alias("loss")) for df in (rows, wide)]  # line numbers may repeat
    out = inf.two_arm_verdict(*arms, ["okey", "line"], "loss", "entity")
    return out.select("rows", "blocks", *[r(F.col(c), 4).alias(c) for c in ("loss_a", "loss_b", "mean_difference")], r(F.col("t"), 5).alias("t"), r(F.col("p_value")).alias("p_value"), "verdict")
