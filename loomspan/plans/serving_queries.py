"""Queries of the serving views: suppliers by year of shipment are the entities, nations their states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.operators import serving
from loomspan.plans.base import PRED, predictions, r
from loomspan.plans.registry import query
from loomspan.session import table

YEAR = 1998
STORE = f"""{PRED}, base AS (SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS weight, sum(l_extendedprice) / sum(l_quantity) AS value, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS dry,
    count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS hot, count(CASE WHEN l_linenumber = 7 THEN 1 END) AS compound, count(CASE WHEN l_discount = 0 THEN 1 END) AS hail, round(sum(l_tax), 6) AS excess, round(sum(l_discount), 6) AS rain FROM lineitem GROUP BY 1, 2),
  panel AS (SELECT b.*, s_name AS name, n_name AS state, CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END AS prior FROM base b JOIN supplier ON s_suppkey = entity JOIN nation ON n_nationkey = s_nationkey WINDOW w AS (PARTITION BY entity ORDER BY year ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
  preds AS (SELECT method, entity, test_year AS year, avg(pred / size) AS pred, avg(lo / size) AS lo, avg(hi / size) AS hi FROM pred GROUP BY 1, 2, 3),
  m AS (SELECT panel.*, p.pred, p.lo, p.hi FROM panel LEFT JOIN preds p ON p.entity = panel.entity AND p.year = panel.year AND p.method = 'N'),
  t AS (SELECT *, pred AS estimate, value AS observed, 100 * (pred - prior) / prior AS estimate_to_prior, 100 * (value - prior) / prior AS observed_to_prior, hi - lo AS spread, pred * weight AS production, compound * excess AS severity, hail + compound AS storms FROM m WHERE year = {YEAR})"""


def store(spark, sf_dir):
    """The panel, the predictions and the columns that never change."""
    t = lambda n: table(spark, sf_dir, n)
    of = lambda c: F.count_if(c)
    base = t("lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("year")).agg(
        F.sum("l_quantity").alias("weight"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("value"), of(F.col("l_returnflag") == "R").alias("dry"), of(F.col("l_returnflag") == "A").alias("hot"),
        of(F.col("l_linenumber") == 7).alias("compound"), of(F.col("l_discount") == 0).alias("hail"), r(F.sum("l_tax")).alias("excess"), r(F.sum("l_discount")).alias("rain"),
    )
    names = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"), F.col("n_name").alias("state"), F.col("s_acctbal").alias("credit"), F.col("n_regionkey").alias("size"), (F.col("s_acctbal") / 100).alias("share"))
    w = Window.partitionBy("entity").orderBy("year").rowsBetween(-5, -1)
    panel = base.withColumn("prior", F.when(F.count("value").over(w) >= 3, F.avg("value").over(w))).join(names.select("entity", "name", "state"), "entity")
    unit = lambda c: F.avg(F.col(c) / F.col("size")).alias(c)
    preds = predictions(spark, sf_dir).groupBy("method", "entity", F.col("test_year").alias("year")).agg(unit("pred"), unit("lo"), unit("hi"))
    return panel, preds, names


def _all(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def _year(spark, sf_dir):
    panel, preds, names = store(spark, sf_dir)
    return serving.entity_table(panel, preds, YEAR, "N"), names


_TABLE = ["weight", "estimate", "observed", "prior", "estimate_to_prior", "observed_to_prior", "spread", "production"]


@query("serving_entity_table", f"WITH {STORE} SELECT entity, name, state, {', '.join(f'round({c}, 3) AS {c}' for c in _TABLE)}, dry, hot, compound, hail FROM t")
def serving_entity_table(spark, sf_dir):
    return _year(spark, sf_dir)[0].select("entity", "name", "state", *[r(F.col(c), 3).alias(c) for c in _TABLE], "dry", "hot", "compound", "hail")


@query("serving_rankings", f"WITH {STORE}, k AS ({' UNION ALL '.join(f'''SELECT '{m}' AS metric, row_number() OVER (ORDER BY {m} DESC, entity) AS rank, entity, name, state, CAST({m} AS DOUBLE) AS v FROM t WHERE {m} IS NOT NULL''' for m in serving.METRICS)}) SELECT metric, CAST(rank AS INTEGER) AS rank, entity, name, state, round(v, 3) AS metric_value FROM k WHERE rank <= 25")
def serving_rankings(spark, sf_dir):
    held, _ = _year(spark, sf_dir)
    return _all([serving.rankings(held, m) for m in serving.METRICS]).withColumn("metric_value", r(F.col("metric_value"), 3))


_STATIC = {"credit": "s_acctbal", "size": "n_regionkey", "share": "s_acctbal / 100"}


@query("serving_map_layers", f"WITH {STORE}, k AS (SELECT s_suppkey AS entity, {', '.join(f'{e} AS {c}' for c, e in _STATIC.items())} FROM supplier JOIN nation ON n_nationkey = s_nationkey) " + " UNION ALL ".join(f"SELECT '{layer}' AS layer, entity, round(CAST({c} AS DOUBLE), 3) AS layer_value FROM {'t' if seasonal else 'k'} WHERE {c} IS NOT NULL" for layer, (c, seasonal) in serving.LAYERS.items()))
def serving_map_layers(spark, sf_dir):
    held, names = _year(spark, sf_dir)
    return _all([serving.layer_values(held, names, layer) for layer in serving.LAYERS]).withColumn("layer_value", r(F.col("layer_value"), 3))


def _w(value: str, more: str = "true") -> str:
    return f"round(sum(CASE WHEN {value} IS NOT NULL AND weight > 0 AND {more} THEN {value} * weight END) / sum(CASE WHEN {value} IS NOT NULL AND weight > 0 AND {more} THEN weight END), 4)"


@query("serving_state_summary", f"""WITH {STORE} SELECT state, count(DISTINCT entity) AS entities, count(value) AS with_value, count(pred) AS with_estimate, {_w('value')} AS observed_weighted, {_w('prior')} AS prior_weighted, {_w('pred')} AS estimate_weighted, {_w('lo')} AS lower_weighted, {_w('hi')} AS upper_weighted,
  round(sum(value * weight), 2) AS production_observed, round(sum(pred * weight), 2) AS production_estimated, sum(weight) AS weight, count(CASE WHEN compound >= 3 THEN 1 END) AS compound_high, count(CASE WHEN compound BETWEEN 1 AND 2 THEN 1 END) AS compound_moderate, round(avg(dry), 4) AS mean_dry, round(avg(hot), 4) AS mean_hot, {YEAR} AS season FROM t GROUP BY 1""")
def serving_state_summary(spark, sf_dir):
    panel, preds, _ = store(spark, sf_dir)
    out = serving.state_summary(panel, preds, YEAR, "N")
    four = ["observed_weighted", "prior_weighted", "estimate_weighted", "lower_weighted", "upper_weighted", "mean_dry", "mean_hot"]
    return out.withColumns({c: r(F.col(c), 4) for c in four} | {c: r(F.col(c), 2) for c in ("production_observed", "production_estimated")})


@query("serving_state_series", f"WITH {STORE} SELECT state, year, {_w('value')} AS observed, {_w('pred')} AS estimate, round(sum(value * weight), 2) AS production, round(avg(compound), 4) AS compound FROM m GROUP BY 1, 2")
def serving_state_series(spark, sf_dir):
    panel, preds, _ = store(spark, sf_dir)
    return serving.state_series(panel, preds, "N").withColumns({"observed": r(F.col("observed"), 4), "estimate": r(F.col("estimate"), 4), "production": r(F.col("production"), 2), "compound": r(F.col("compound"), 4)})


for _name, _ids in (("serving_entity_series", [3]), ("serving_compare", [1, 2, 5, 7])):

    @query(_name, f"WITH {STORE} SELECT entity, year, name, round(value, 3) AS value, round(prior, 3) AS prior, round(pred, 3) AS pred, round(lo, 3) AS lo, round(hi, 3) AS hi, dry, hot, compound FROM m WHERE entity IN ({', '.join(map(str, _ids))})")
    def series_view(spark, sf_dir, ids=_ids):
        panel, preds, _ = store(spark, sf_dir)
        return serving.entity_series(panel, preds, ids, "N").select("entity", "year", "name", *[r(F.col(c), 3).alias(c) for c in ("value", "prior", "pred", "lo", "hi")], "dry", "hot", "compound")


@query("serving_point_lookup", f"WITH {STORE} SELECT entity, year, round(value, 3) AS value, round(pred, 3) AS pred, round(lo, 3) AS lo, round(hi, 3) AS hi FROM m WHERE entity = 4 AND year = {YEAR}")
def serving_point_lookup(spark, sf_dir):
    panel, preds, _ = store(spark, sf_dir)
    return serving.lookup("point", panel, preds, entity=4, year=YEAR).select("entity", "year", *[r(F.col(c), 3).alias(c) for c in ("value", "pred", "lo", "hi")])


@query("serving_manifest", f"WITH {STORE} SELECT (SELECT count(*) FROM panel) AS rows, (SELECT count(DISTINCT entity) FROM panel) AS entities, (SELECT min(year) FROM panel) AS first_year, (SELECT max(year) FROM panel) AS last_year, count(DISTINCT method) AS methods, min(year) AS first_estimate, max(year) AS last_estimate FROM preds")
def serving_manifest(spark, sf_dir):
    panel, preds, _ = store(spark, sf_dir)
    return serving.manifest(panel, preds)


@query("serving_search", "SELECT s_suppkey AS entity, s_name AS name, n_name AS state FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE lower(s_name) LIKE 'supp%' AND lower(n_name) LIKE 'n%' ORDER BY name, entity LIMIT 10")
def serving_search(spark, sf_dir):
    return serving.search(store(spark, sf_dir)[2], "Supp, n")


@query("serving_csv_report", f"WITH {STORE}, k AS (SELECT row_number() OVER (ORDER BY estimate DESC, entity) AS rank, entity, CAST(round(estimate * 100) AS BIGINT) AS hundredths FROM t WHERE estimate IS NOT NULL) SELECT 0 AS at, '# source: line items' AS line UNION ALL SELECT 1, '# season: {YEAR}' UNION ALL SELECT 2, 'rank,entity,hundredths' UNION ALL SELECT CAST(rank + 2 AS INTEGER), rank || ',' || entity || ',' || hundredths FROM k WHERE rank <= 25")
def serving_csv_report(spark, sf_dir):
    top = serving.rankings(_year(spark, sf_dir)[0], "estimate").select("rank", "entity", F.round(F.col("metric_value") * 100).cast("bigint").alias("hundredths"))
    return serving.csv_report(top, ["rank"], {"source": "line items", "season": str(YEAR)})


@query("prediction_exposure_join", f"WITH {STORE}, x AS (SELECT entity AS fips, year AS season, compound AS days FROM panel) SELECT method, CASE WHEN days >= 3 THEN 'high' WHEN days >= 1 THEN 'some' WHEN days IS NULL THEN 'unknown' ELSE 'none' END AS exposure, count(*) AS n, round(avg(hi - lo), 4) AS width FROM preds LEFT JOIN x ON fips = entity AND season = year GROUP BY 1, 2")
def prediction_exposure_join(spark, sf_dir):
    panel, preds, _ = store(spark, sf_dir)
    x = panel.select(F.col("entity").alias("fips"), F.col("year").alias("season"), F.col("compound").alias("days"))
    held = preds.join(x, (F.col("fips") == F.col("entity")) & (F.col("season") == F.col("year")), "left")
    exposure = F.when(F.col("days") >= 3, "high").when(F.col("days") >= 1, "some").when(F.col("days").isNull(), "unknown").otherwise("none")
    return held.groupBy("method", exposure.alias("exposure")).agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("hi") - F.col("lo")), 4).alias("width"))


@query("benchmark_merge", f"WITH {STORE} SELECT a.entity, a.year, round(a.pred, 3) AS first_model, round(b.pred, 3) AS second_model, round(p.prior, 3) AS benchmark, round(abs(p.value - a.pred), 3) AS first_error, round(abs(p.value - p.prior), 3) AS benchmark_error FROM preds a JOIN preds b ON b.method = 'R' AND b.entity = a.entity AND b.year = a.year JOIN panel p ON p.entity = a.entity AND p.year = a.year WHERE a.method = 'N' AND p.prior IS NOT NULL")
def benchmark_merge(spark, sf_dir):
    panel, preds, _ = store(spark, sf_dir)
    of = lambda m, name: preds.where(F.col("method") == m).select("entity", "year", F.col("pred").alias(name))
    held = of("N", "first_model").join(of("R", "second_model"), ["entity", "year"]).join(panel.where("prior IS NOT NULL").select("entity", "year", F.col("prior").alias("benchmark"), "value"), ["entity", "year"])
    return held.select("entity", "year", *[r(F.col(c), 3).alias(c) for c in ("first_model", "second_model", "benchmark")], r(F.abs(F.col("value") - F.col("first_model")), 3).alias("first_error"), r(F.abs(F.col("value") - F.col("benchmark")), 3).alias("benchmark_error"))
