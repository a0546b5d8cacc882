"""Queries of standardised indices by calendar slot, and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import scalars
from loomspan.operators import indices
from loomspan.operators import timeseries as ts
from loomspan.operators.ordering import mean_ranks
from loomspan.plans.base import DENSE, dense_events, r
from loomspan.plans.registry import ORACLES, query
from loomspan.plans.split_queries import probit_sql
from loomspan.session import table

PI = "3.141592653589793"
_SLOT = "CAST(CASE WHEN dayofyear(make_date(year(day), 12, 31)) = 366 AND dayofyear(day) >= 60 THEN dayofyear(day) - 1 ELSE dayofyear(day) END AS INTEGER)"
#: Daily order totals (in millions) by priority, and calibration rows around each slot.
SERIES = f"""series AS (SELECT entity, day, cents / 1e8 AS value, {_SLOT} AS slot FROM (SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS day, sum(round(o_totalprice * 100)) AS cents FROM orders GROUP BY 1, 2)),
near AS (SELECT entity, day, value, CAST(((slot - 1 + o + 365) % 365) + 1 AS INTEGER) AS slot FROM series CROSS JOIN (SELECT unnest(range(-7, 8)) AS o) WHERE year(day) <= 1999)"""
_GLO = f"""x AS (SELECT entity, slot, value AS v, row_number() OVER (PARTITION BY entity, slot ORDER BY value, day) AS i, count(*) OVER (PARTITION BY entity, slot) AS n FROM near),
b AS (SELECT entity, slot, max(n) AS n, avg(v) AS b0, sum((i - 1) * v / (n - 1.0)) / max(n) AS b1, sum((i - 1) * (i - 2) * v / ((n - 1.0) * (n - 2.0))) / max(n) AS b2 FROM x WHERE n >= 5 GROUP BY 1, 2),
g AS (SELECT entity, slot, n, b0 AS l1, 2 * b1 - b0 AS l2, -(6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) AS k FROM b),
a AS (SELECT *, l2 * sin(k * {PI}) / (k * {PI}) AS alpha FROM g),
fit AS (SELECT entity, slot, n, k, alpha, l1 - alpha * (1 / k - {PI} / sin(k * {PI})) AS xi FROM a)"""
_GLO_INDEX = f"""c AS (SELECT s.entity, s.day, 1 - k * (value - xi) / alpha AS inner_, k FROM series s JOIN fit ON fit.entity = s.entity AND fit.slot = s.slot),
p AS (SELECT entity, day, least(greatest(CASE WHEN inner_ <= 0 THEN CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END ELSE 1 / (1 + exp(ln(CASE WHEN inner_ > 0 THEN inner_ END) / k)) END, 0.001), 0.999) AS p FROM c),
idx AS (SELECT entity, day, {probit_sql('p')} AS z FROM p)"""


def series(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("day")).agg(F.sum(F.round(F.col("o_totalprice") * 100)).alias("cents"))
    return o.select("entity", "day", (F.col("cents") / 1e8).alias("value"), ts.day_slot(F.col("day")).alias("slot"))


def _glo(s):
    return indices.slot_fit(s, ["entity"], "slot", 7, F.year("day") <= 1999, lambda rows, keys: indices.glo_fit(rows, keys, "value", "day", least=5))


def _glo_index(spark, sf_dir):
    s = series(spark, sf_dir)
    return indices.standardise(s.join(_glo(s), ["entity", "slot"]), indices.glo_cdf("value"))


@query("spei_slot_fit", f"WITH {SERIES}, {_GLO} SELECT entity, slot, n, round(k, 6) AS k, round(alpha, 6) AS alpha, round(xi, 6) AS xi FROM fit")
def spei_slot_fit(spark, sf_dir):
    return _glo(series(spark, sf_dir)).select("entity", "slot", "n", *[r(F.col(c)).alias(c) for c in ("k", "alpha", "xi")])


@query("spei_slot_index", f"WITH {SERIES}, {_GLO}, {_GLO_INDEX} SELECT entity, day, round(z, 5) AS z FROM idx")
def spei_slot_index(spark, sf_dir):
    return _glo_index(spark, sf_dir).select("entity", "day", r(F.col("index"), 5).alias("z"))


@query("index_calibration_check", f"WITH {SERIES}, {_GLO}, {_GLO_INDEX} SELECT entity, count(z) AS n, round(avg(z), 5) AS mean, round(stddev_samp(z), 5) AS sd, round(avg(CASE WHEN z < -1 THEN 1.0 ELSE 0.0 END), 6) AS below, count(*) - count(z) AS missing FROM idx GROUP BY 1")
def index_calibration_check(spark, sf_dir):
    return indices.calibration_check(_glo_index(spark, sf_dir), "index", "entity").select("entity", "n", r(F.col("mean"), 5).alias("mean"), r(F.col("sd"), 5).alias("sd"), r(F.col("below")).alias("below"), "missing")


def _gamma_sql(rel: str, keys: str, least: int) -> str:
    wet = "CASE WHEN value >= 0.01 THEN value END"
    return f"""m AS (SELECT {keys}, count(*) AS n, count(CASE WHEN value < 0.01 THEN 1 END) AS zeros, avg({wet}) AS m, ln(avg({wet})) - avg(ln({wet})) AS a FROM {rel} WHERE value IS NOT NULL GROUP BY {keys} HAVING count({wet}) >= {least}),
fit AS (SELECT *, (1 + sqrt(1 + 4 * a / 3)) / (4 * a) AS shape, m * (4 * a) / (1 + sqrt(1 + 4 * a / 3)) AS scale, zeros / n AS q FROM m WHERE a > 1e-12)"""


def _gamma_p(value: str) -> str:
    x, a = f"({value} / scale)", "shape"
    series_sum = f"list_sum(list_transform(range(0, CAST({x} + 20 * sqrt({x}) + 61 AS BIGINT)), lambda i: exp(({a} + i) * ln({x}) - {x} - lgamma({a} + i + 1))))"
    return f"least(greatest(CASE WHEN {value} < 0.01 THEN q / 2 ELSE q + (1 - q) * least({series_sum}, 1.0) END, 0.001), 0.999)"


@query("spi_slot_index", f"WITH {SERIES}, {_gamma_sql('near', 'entity, slot', 5)}, p AS (SELECT s.entity, s.day, {_gamma_p('value')} AS p FROM series s JOIN fit ON fit.entity = s.entity AND fit.slot = s.slot) SELECT entity, day, round({probit_sql('p')}, 4) AS z FROM p")
def spi_slot_index(spark, sf_dir):
    s = series(spark, sf_dir)
    fit = indices.slot_fit(s, ["entity"], "slot", 7, F.year("day") <= 1999, lambda rows, keys: indices.gamma_fit(rows, keys, "value", least=5)).where("shape IS NOT NULL")
    return indices.standardise(s.join(fit, ["entity", "slot"]), indices.gamma_cdf("value")).select("entity", "day", r(F.col("index"), 4).alias("z"))


ORACLES["spi_index"] = f"WITH {DENSE}, {_gamma_sql('dense', 'entity', 5)}, p AS (SELECT d.entity, d.day, CASE WHEN value IS NOT NULL THEN {_gamma_p('value')} END AS p FROM dense d JOIN fit ON fit.entity = d.entity) SELECT entity, day, CASE WHEN p IS NOT NULL THEN round({probit_sql('p')}, 6) END AS \"index\" FROM p"
ORACLES["spei_index"] = f"""WITH {DENSE}, near AS (SELECT entity, 0 AS slot, day, value FROM dense WHERE value IS NOT NULL), series AS (SELECT entity, 0 AS slot, day, value FROM dense), {_GLO}, {_GLO_INDEX.replace("AS inner_, k FROM", "AS inner_, k, value FROM").replace("AS p FROM c", "AS p, value FROM c").replace("AS z FROM p", "AS z, value FROM p")}
  SELECT entity, day, CASE WHEN value IS NOT NULL THEN round(z, 6) END AS "index" FROM idx"""


@query("log_logistic_fit", f"""WITH {SERIES}, x AS (SELECT entity, slot, value AS v, row_number() OVER (PARTITION BY entity, slot ORDER BY value DESC, day) AS i, count(*) OVER (PARTITION BY entity, slot) AS n FROM near),
  b AS (SELECT entity, slot, max(n) AS n, avg(v) AS b0, avg((n - i) / (n - 1.0) * v) AS b1, avg((n - i) / (n - 1.0) * (n - i - 1) / (n - 2.0) * v) AS b2 FROM x WHERE n >= 8 GROUP BY 1, 2),
  s AS (SELECT *, (2 * b1 - b0) / (6 * b1 - b0 - 6 * b2) AS shape FROM b), g AS (SELECT *, {PI} / shape / sin({PI} / shape) AS gg FROM s)
  SELECT entity, slot, n, round((b0 - 2 * b1) * shape / gg, 5) AS scale, round(1 / shape, 5) AS inverse_shape, round(b0 - (b0 - 2 * b1) * shape / gg * gg, 5) AS origin FROM g WHERE abs(1 / shape) BETWEEN 0.001 AND 0.9""")
def log_logistic_fit(spark, sf_dir):
    fit = indices.slot_fit(series(spark, sf_dir), ["entity"], "slot", 7, F.year("day") <= 1999, lambda rows, keys: indices.log_logistic_fit(rows, keys, "value", "day", least=8))
    fit = fit.where(F.abs(1 / F.col("shape")).between(0.001, 0.9))
    return fit.select("entity", "slot", "n", r(F.col("scale"), 5).alias("scale"), r(1 / F.col("shape"), 5).alias("inverse_shape"), r(F.col("origin"), 5).alias("origin"))


@query("gdd_candidates", f"""WITH {DENSE}, d AS (SELECT entity, sum(least(greatest(value / 10, 10), 30) - 10) AS base, sum(greatest(value / 10 - 10, 0)) AS simple, sum((least(greatest(value / 10, 10), 30) + least(greatest(value / 20, 10), 30)) / 2 - 10) AS capped FROM dense WHERE value IS NOT NULL GROUP BY 1)
  SELECT 'simple' AS candidate, round(avg(simple - base), 6) AS bias, round(avg(abs(simple - base)), 6) AS mae, round(corr(simple, base), 6) AS r FROM d UNION ALL SELECT 'capped', round(avg(capped - base), 6), round(avg(abs(capped - base)), 6), round(corr(capped, base), 6) FROM d""")
def gdd_candidates(spark, sf_dir):
    t = F.col("value") / 10
    held = lambda x: F.least(F.greatest(x, F.lit(10.0)), F.lit(30.0))
    d = dense_events(spark, sf_dir).where("value is not null").groupBy("entity").agg(
        F.sum(held(t) - 10).alias("base"), F.sum(F.greatest(t - 10, F.lit(0.0))).alias("simple"), F.sum(scalars.degree_days(t, F.col("value") / 20)).alias("capped")
    )
    long = d.unpivot(["base"], ["simple", "capped"], "candidate", "v")
    e = F.col("v") - F.col("base")
    return long.groupBy("candidate").agg(r(F.avg(e)).alias("bias"), r(F.avg(F.abs(e))).alias("mae"), r(F.corr("v", "base")).alias("r"))


@query("rank_correlation", """WITH k AS (SELECT l_returnflag AS grp, (rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0) AS a, (rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0) AS b, l_quantity, l_extendedprice FROM lineitem)
  SELECT grp, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(corr(a, b), 6) AS spearman, corr(l_quantity, l_extendedprice) >= 0.5 AS passes FROM k GROUP BY 1""")
def rank_correlation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_quantity", "l_extendedprice")
    k = mean_ranks(mean_ranks(li, ["grp"], "l_quantity", "a"), ["grp"], "l_extendedprice", "b")
    one = k.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.corr("l_quantity", "l_extendedprice").alias("pearson"), r(F.corr("a", "b")).alias("spearman"))
    return one.select("grp", "n", r(F.col("pearson")).alias("pearson"), "spearman", (F.col("pearson") >= 0.5).alias("passes"))
