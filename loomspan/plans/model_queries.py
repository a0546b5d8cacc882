"""Queries of baselines, diagnostics and serving views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.functions import special
from loomspan.operators import boosting, models
from loomspan.operators import timeseries as ts
from loomspan.plans.base import PANEL, order_panel, r
from loomspan.plans.inference_queries import binomial_sql
from loomspan.plans.registry import query
from loomspan.session import table


@query("fixed_effects_panel", f"""WITH {PANEL}, m AS (SELECT entity, avg(orders) AS mx, avg(value) AS my, count(*) AS n FROM panel WHERE year <= 1998 GROUP BY 1),
  b AS (SELECT sum((orders - mx) * (value - my)) / sum((orders - mx) * (orders - mx)) AS b FROM panel JOIN m USING (entity) WHERE year <= 1998),
  l AS (SELECT entity, n, my - b * mx AS level FROM m CROSS JOIN b), p AS (SELECT sum(level * n) / sum(n) AS pooled FROM l)
  SELECT panel.entity, year, round((coalesce(level, pooled) + b * orders) / 1e4, 3) AS pred FROM panel LEFT JOIN l ON l.entity = panel.entity CROSS JOIN p CROSS JOIN b""")
def fixed_effects_panel(spark, sf_dir):
    out = models.fixed_effects(order_panel(spark, sf_dir), "entity", "orders", "value", F.col("year") <= 1998)
    return out.select("entity", "year", r(F.col("pred") / 1e4, 3).alias("pred"))


@query("quadratic_effects", f"""WITH {PANEL}, s AS (SELECT entity, year * 1.0 - 1995 AS a, orders * 1.0 AS b, orders * orders * 1.0 AS c, value / 1e6 AS y FROM panel WHERE year <= 1998),
  d AS (SELECT CAST(a - avg(a) OVER w AS DOUBLE) AS a, CAST(b - avg(b) OVER w AS DOUBLE) AS b, CAST(c - avg(c) OVER w AS DOUBLE) AS c, y - avg(y) OVER w AS y FROM s WINDOW w AS (PARTITION BY entity)),
  t AS (SELECT count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc, sum(a * y) AS ay, sum(b * y) AS by_, sum(c * y) AS cy FROM d),
  e AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM t)
  SELECT n, round((ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det, 5) AS slope, round((aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det, 5) AS linear,
    round((aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det, 5) AS quadratic FROM e""")
def quadratic_effects(spark, sf_dir):
    p = order_panel(spark, sf_dir).withColumns({"step": F.col("year") - 1995.0, "target": F.col("value") / 1e6})
    out = models.quadratic_effects(p, "entity", "step", "orders", "target", F.col("year") <= 1998)
    return out.select("n", *[r(F.col(c), 5).alias(c) for c in ("slope", "linear", "quadratic")])


_SIMILAR = {"q": "l_quantity", "q2": "l_quantity * 2 + l_linenumber * 0.001", "p": "l_extendedprice", "d": "l_discount"}
_NEAR = ", ".join(f"abs(corr({a}, {b})) >= 0.98 AS {n}" for n, a, b in (("x1", "l_quantity", _SIMILAR["q2"]), ("x2", "l_quantity", "l_extendedprice"), ("x3", _SIMILAR["q2"], "l_extendedprice")))


def _similar(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), (F.col("l_quantity") * 2 + F.col("l_linenumber") * 0.001).alias("q2"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"), F.col("l_shipdate").alias("day"))


@query("near_duplicate_columns", f"""WITH c AS (SELECT {_NEAR} FROM lineitem WHERE l_shipdate < DATE '1998-01-01'), k AS (SELECT *, CASE WHEN x2 THEN 'q' WHEN NOT x1 AND x3 THEN 'q2' END AS p_twin FROM c)
  SELECT 'q' AS "column", true AS kept, NULL AS twin UNION ALL SELECT 'q2', NOT x1, CASE WHEN x1 THEN 'q' END FROM k UNION ALL SELECT 'p', p_twin IS NULL, p_twin FROM k UNION ALL SELECT 'd', true, NULL""")
def near_duplicate_columns(spark, sf_dir):
    return models.near_duplicate_columns(_similar(spark, sf_dir), ["q", "q2", "p", "d"], F.expr("day < DATE '1998-01-01'"))


@query("pruned_columns")
def pruned_columns(spark, sf_dir):
    return models.prune_columns(_similar(spark, sf_dir), ["q", "q2", "d"], "p", F.expr("day < DATE '1998-01-01'"))


_FEATURES = ["orders", "step", "bucket"]


def _modelled(spark, sf_dir):
    return order_panel(spark, sf_dir).select("entity", "year", "orders", (F.col("year") - 1995.0).alias("step"), (F.col("entity") % 7).cast("double").alias("bucket"), (F.col("value") / 1e6).alias("y"))


_FIT, _DEV, _TEST = "year <= 1997", "year = 1998", "year >= 1999"


@query("forest_baseline")
def forest_baseline(spark, sf_dir):
    out = models.tree_predictions(_modelled(spark, sf_dir), _FEATURES, "y", F.expr(_FIT), kind="forest")
    return out.where(_TEST).groupBy("year").agg(r(F.sqrt(F.avg(F.pow(F.col("y") - F.col("pred"), F.lit(2)))), 4).alias("rmse"), F.count(F.lit(1)).alias("n"))


@query("boosted_intervals")
def boosted_intervals(spark, sf_dir):
    out = models.tree_intervals(_modelled(spark, sf_dir), _FEATURES, "y", F.expr(_FIT), F.expr(_DEV))
    inside = ((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("int")
    return out.where(_TEST).groupBy("year").agg(F.count(F.lit(1)).alias("n"), r(F.avg(inside)).alias("picp"), r(F.avg(F.col("hi") - F.col("lo")), 4).alias("mpiw"))


@query("quantile_boosting")
def quantile_boosting(spark, sf_dir):
    out = boosting.quantile_intervals(_modelled(spark, sf_dir), _FEATURES, "y", F.expr(_FIT), rounds=10, rate=0.3)
    y = F.col("y")
    inside = ((y >= F.col("lo")) & (y <= F.col("hi"))).cast("int")
    losses = [r(F.avg(boosting.pinball(y, F.col(c), q)), 4).alias(f"loss_{c}") for c, q in (("lo", 0.05), ("pred", 0.5), ("hi", 0.95))]
    return out.where(_TEST).groupBy("year").agg(F.count(F.lit(1)).alias("n"), r(F.avg(inside)).alias("picp"), r(F.avg(F.col("hi") - F.col("lo")), 4).alias("mpiw"), *losses)


@query("boosted_grid")
def boosted_grid(spark, sf_dir):
    return models.grid_search(_modelled(spark, sf_dir), _FEATURES, "y", F.expr(_FIT), F.expr(_DEV), [{"depth": d, "trees": t} for d in (2, 4) for t in (5, 10)]).withColumn("rmse", r(F.col("rmse"), 4))


@query("group_ablation")
def group_ablation(spark, sf_dir):
    return models.ablation(_modelled(spark, sf_dir), {"orders": ["orders"], "time": ["step"], "place": ["bucket"]}, "y", F.expr(_FIT), F.expr(_TEST)).withColumns({c: r(F.col(c), 4) for c in ("rmse", "change")})


@query("consensus_selection")
def consensus_selection(spark, sf_dir):
    return models.consensus_selection(_modelled(spark, sf_dir), _FEATURES, "y", F.expr(_FIT))


@query("ridge_panel")
def ridge_panel(spark, sf_dir):
    out = models.ridge(order_panel(spark, sf_dir).withColumn("step", F.col("year") - 1995.0), ["orders", "step"], "value", 0.1, F.col("year") <= 1998)
    return out.groupBy("year").agg(r(F.avg("pred") / 1e4, 2).alias("pred"), r(F.avg("value") / 1e4, 2).alias("value"))


@query("variance_inflation")
def variance_inflation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return models.variance_inflation(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).withColumn("vif", r(F.col("vif"), 4))


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :]]


@query("high_correlations", " UNION ALL ".join(f"""SELECT '{a}' AS "left", '{b}' AS "right", round(corr({a}, {b}), 6) AS r FROM lineitem HAVING abs(corr({a}, {b})) > 0.001""" for a, b in _PAIRS))
def high_correlations(spark, sf_dir):
    return models.high_correlations(table(spark, sf_dir, "lineitem"), _COLUMNS, 0.001).withColumn("r", r(F.col("r")))


@query("serial_dependence", f"""WITH {PANEL}, y AS (SELECT year, avg(value) / 1e6 AS v FROM panel GROUP BY 1), z AS (SELECT year, v - (SELECT avg(v) FROM y) AS v FROM y), p AS (SELECT v, lag(v) OVER (ORDER BY year) AS p FROM z)
  SELECT round(corr(v, p), 6) AS lag1, round(sum((v - p) * (v - p)) / sum(v * v), 6) AS durbin_watson FROM p""")
def serial_dependence(spark, sf_dir):
    y = order_panel(spark, sf_dir).groupBy("year").agg((F.avg("value") / 1e6).alias("v"))
    z = y.crossJoin(F.broadcast(y.agg(F.avg("v").alias("m")))).select("year", (F.col("v") - F.col("m")).alias("v"))
    out = models.serial_dependence(z, "year", "v")
    return out.select(r(F.col("lag1")).alias("lag1"), r(F.col("durbin_watson")).alias("durbin_watson"))


@query("morans_i", """WITH v AS (SELECT n_nationkey AS k, n_nationkey % 5 * 1.0 AS x, floor(n_nationkey / 5) AS y, avg(c_acctbal) AS v FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
  z AS (SELECT k, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, v - (SELECT avg(v) FROM v) AS z FROM v), p AS (SELECT sum(a.z * b.z / sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS zz, sum(1 / sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS w FROM z a JOIN z b ON a.k < b.k)
  SELECT round((SELECT count(*) FROM z) * zz / w / (SELECT sum(z * z) FROM z), 6) AS morans_i FROM p""")
def morans_i(spark, sf_dir):
    v = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("v"))
    v = v.withColumn("x", (F.col("k") % 5).cast("double")).withColumn("y", F.floor(F.col("k") / 5).cast("double"))
    return models.morans_i(v, "k", "x", "y", "v").select(r(F.col("morans_i")).alias("morans_i"))


@query("alert_rules", f"""WITH {PANEL}, c AS (SELECT entity, year, orders, 100.0 * (value - lag(value) OVER w) / lag(value) OVER w AS ch, lag(year) OVER w = year - 1 AS near FROM panel WINDOW w AS (PARTITION BY entity ORDER BY year)),
  a AS (SELECT entity, year, unnest(list_filter([CASE WHEN orders >= 3 THEN 'many_days:high' END, CASE WHEN orders >= 1 AND orders < 3 THEN 'some_days:medium' END, CASE WHEN near AND ch <= -10 THEN 'large_drop:high' END, CASE WHEN near AND ch >= 10 THEN 'large_rise:info' END], lambda x: x IS NOT NULL)) AS rule FROM c)
  SELECT rule, count(*) AS n, count(DISTINCT entity) AS entities FROM a GROUP BY 1""")
def alert_rules(spark, sf_dir):
    w = Window.partitionBy("entity").orderBy("year")
    before = F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("value").over(w))
    p = order_panel(spark, sf_dir).withColumn("change", 100.0 * (F.col("value") - before) / before)
    a = p.select("entity", F.explode(models.alerts(F.col("orders"), F.col("change"))).alias("a"))
    return a.groupBy(F.concat_ws(":", "a.rule", "a.severity").alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("entities"))


@query("entity_profile", f"""WITH {PANEL}, k AS (SELECT *, (rank() OVER (PARTITION BY entity ORDER BY orders) + (count(*) OVER (PARTITION BY entity, orders) - 1) / 2.0) / count(*) OVER (PARTITION BY entity) AS pct,
    CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END AS prior, row_number() OVER (PARTITION BY entity ORDER BY year DESC) AS back FROM panel WINDOW w AS (PARTITION BY entity ORDER BY year ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
  SELECT entity, c_name AS name, n_name AS state, year AS last_year, value, round(100.0 * (value - prior) / prior, 5) AS vs_prior, CASE WHEN orders = 0 THEN 'Low' WHEN pct >= 0.9 THEN 'Very High' WHEN pct >= 0.75 THEN 'High' WHEN pct >= 0.5 THEN 'Moderate' ELSE 'Low' END AS risk
  FROM k JOIN customer ON c_custkey = entity JOIN nation ON n_nationkey = c_nationkey WHERE back = 1""")
def entity_profile(spark, sf_dir):
    p = order_panel(spark, sf_dir)
    p = p.withColumn("pct", ts.percent_rank("orders", "entity")).withColumn("prior", ts.prior_average(5, 3, "entity", "year", "value"))
    last = p.groupBy("entity").agg(F.max_by(F.struct("year", "value", "orders", "pct", "prior"), "year").alias("l")).select("entity", "l.*")
    named = last.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("entity")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return named.select("entity", F.col("c_name").alias("name"), F.col("n_name").alias("state"), F.col("year").alias("last_year"), "value", r(100.0 * (F.col("value") - F.col("prior")) / F.col("prior"), 5).alias("vs_prior"), models.relative_class(F.col("orders"), F.col("pct")).alias("risk"))


@query("name_search", "SELECT c_custkey AS entity, c_name AS name FROM customer WHERE starts_with(lower(c_name), lower('Customer#00000001')) ORDER BY c_name, c_custkey LIMIT 20")
def name_search(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where(F.startswith(F.lower("c_name"), F.lit("customer#00000001")))
    return c.orderBy("c_name", "c_custkey").limit(20).select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"))


@query("sign_test", f"""WITH {PANEL}, d AS (SELECT entity, value - lag(value) OVER (PARTITION BY entity ORDER BY year) AS d FROM panel), k AS (SELECT count(CASE WHEN d > 0 THEN 1 END) AS ups, count(CASE WHEN d < 0 THEN 1 END) AS downs, count(CASE WHEN d = 0 THEN 1 END) AS ties FROM d)
  SELECT ups, downs, ties, round({binomial_sql('ups', '(ups + downs)')}, 6) AS p_value FROM k""")
def sign_test(spark, sf_dir):
    d = order_panel(spark, sf_dir).select((F.col("value") - F.lag("value").over(Window.partitionBy("entity").orderBy("year"))).alias("d"))
    k = d.agg(F.count_if(F.col("d") > 0).alias("ups"), F.count_if(F.col("d") < 0).alias("downs"), F.count_if(F.col("d") == 0).alias("ties"))
    return k.withColumn("p_value", r(special.binomial_two_sided(F.col("ups"), F.col("ups") + F.col("downs"))))
