"""Queries of row rules: codes, units, indices, flags and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import scalars as sc
from loomspan.operators import audits, joins, ordering
from loomspan.operators import timeseries as ts
from loomspan.plans.base import DENSE, PANEL, PRED, dense_events, order_panel, predictions, r
from loomspan.plans.registry import query
from loomspan.session import table

_KINDS = ["error", "purchase", "view"]


@query("one_hot_types", "SELECT user_id AS entity, " + ", ".join(f"CAST(sum(CASE WHEN event_type = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS event_type_{k}" for k in _KINDS) + " FROM events GROUP BY 1")
def one_hot_types(spark, sf_dir):
    hot = table(spark, sf_dir, "events").select("user_id", *sc.one_hot("event_type", _KINDS))
    return hot.groupBy(F.col("user_id").alias("entity")).agg(*[F.sum(f"event_type_{k}").alias(f"event_type_{k}") for k in _KINDS])


@query("padded_codes", "SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, substring(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), 1, 3) AS prefix, upper(trim(c_mktsegment)) AS segment FROM customer")
def padded_codes(spark, sf_dir):
    code = sc.padded_code(F.col("c_custkey"), 6)
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(sc.padded_code(F.col("c_nationkey"), 2), code).alias("code"), F.substring(code, 1, 3).alias("prefix"), F.upper(F.trim("c_mktsegment")).alias("segment"))


@query("title_names", "SELECT r_regionkey, upper(substring(lower(trim(r_name)), 1, 1)) || substring(lower(trim(r_name)), 2) AS title FROM region WHERE r_name NOT LIKE '% %'")
def title_names(spark, sf_dir):
    return table(spark, sf_dir, "region").where(~F.col("r_name").contains(" ")).select("r_regionkey", F.initcap(F.trim("r_name")).alias("title"))


@query("event_duration_hours", "SELECT o_orderkey, round(greatest(((o_orderkey % 7) * 3600 - 3600 + (o_orderkey % 5) * 60) / 3600.0, 0.0), 6) AS hours FROM orders")
def event_duration_hours(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    begin = F.to_timestamp(F.to_date("o_orderdate"))
    shift = ((F.col("o_orderkey") % 7) * 3600 - 3600 + (F.col("o_orderkey") % 5) * 60).cast("int")
    end = F.timestamp_seconds(F.unix_timestamp(begin) + shift)
    text = lambda c: F.date_format(c, "dd-MMM-yyyy HH:mm")
    return o.select("o_orderkey", r(sc.event_hours(text(begin), text(end))).alias("hours"))


@query("unit_conversions", """SELECT l_linenumber AS line, round(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 1.15078 ELSE l_quantity END), 6) AS mph, round(sum(l_quantity * 0.0627), 6) AS t_ha FROM lineitem GROUP BY 1""")
def unit_conversions(spark, sf_dir):
    unit = F.when(F.col("l_linenumber") % 2 == 0, "EG kt").otherwise("mph")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("line")).agg(r(F.sum(sc.miles_an_hour(F.col("l_quantity"), unit))).alias("mph"), r(F.sum(sc.tonnes_per_hectare(F.col("l_quantity")))).alias("t_ha"))


_FLAGS = {"has_error": ("error",), "has_purchase": ("purchase",), "has_trouble": ("error", "refund"), "has_visit": ("view", "click"), "has_money": ("purchase", "refund")}


@query("category_flags", "SELECT user_id AS entity, CAST(ts AS DATE) AS day, " + ", ".join(f"CAST(max(CASE WHEN event_type IN ({', '.join(repr(k) for k in v)}) THEN 1 ELSE 0 END) AS INTEGER) AS {n}" for n, v in _FLAGS.items()) + " FROM events GROUP BY 1, 2")
def category_flags(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("day")).agg(*[F.max(F.col("event_type").isin(*v).cast("int")).alias(n) for n, v in _FLAGS.items()])


@query("interaction_features", """SELECT l_orderkey, l_linenumber, round_even(l_quantity * l_discount, 4) AS l_quantity_x_l_discount, round_even(l_quantity * l_tax, 4) AS l_quantity_x_l_tax, round(1.5 * l_discount + 2.5 * l_tax, 6) AS weighted FROM lineitem""")
def interaction_features(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", *sc.interactions([("l_quantity", "l_discount"), ("l_quantity", "l_tax")]), r(sc.weighted_stages({"l_discount": 1.5, "l_tax": 2.5})).alias("weighted"))


@query("heat_and_drought", f"""WITH {DENSE} SELECT entity, day, round(greatest(value / 10 - 30, 0.0), 6) AS kdd, round(CASE WHEN value / 100 - 2 < -1 THEN 2 - value / 100 WHEN value IS NOT NULL THEN 0.0 END, 6) AS drought FROM dense WHERE value IS NOT NULL""")
def heat_and_drought(spark, sf_dir):
    d = dense_events(spark, sf_dir).where("value is not null")
    return d.select("entity", "day", r(sc.killing_degree_days(F.col("value") / 10)).alias("kdd"), r(sc.drought_severity(F.col("value") / 100 - 2)).alias("drought"))


@query("humidity_and_wind", """SELECT l_orderkey, l_linenumber, round(0.748 * sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber), 6) AS u2, round(l_discount * 101300 / (0.622 + 0.378 * l_discount) / 1000, 6) AS ea, round(l_extendedprice * 0.0864, 6) AS rs FROM lineitem""")
def humidity_and_wind(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", r(sc.wind_at_two_metres(F.col("l_quantity"), F.col("l_linenumber").cast("double"))).alias("u2"), r(sc.vapour_pressure(F.col("l_discount"), F.lit(101300))).alias("ea"), r(sc.radiation_mj(F.col("l_extendedprice"))).alias("rs"))


@query("plausibility_flags", """SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_quantity < 2 OR l_quantity > 45 THEN 'l_quantity' END, CASE WHEN l_discount < 0.01 OR l_discount > 0.09 THEN 'l_discount' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem) GROUP BY 1
  UNION ALL SELECT 'none', count(*) FROM lineitem WHERE l_quantity BETWEEN 2 AND 45 AND l_discount BETWEEN 0.01 AND 0.09""")
def plausibility_flags(spark, sf_dir):
    flagged = table(spark, sf_dir, "lineitem").select(sc.implausible({"l_quantity": (2, 45), "l_discount": (0.01, 0.09)}).alias("why"))
    why = F.explode(F.when(F.size("why") > 0, F.col("why")).otherwise(F.array(F.lit("none"))))
    return flagged.select(why.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("doy_dates", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(o_orderdate AS DATE) AS day FROM orders")
def doy_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("doy")).distinct()
    return o.withColumn("day", sc.day_of_year_date(F.col("year"), F.col("doy")))


@query("quality_flag_codes", """WITH f AS (SELECT event_type || ',' || (user_id % 6) || ',x' AS flags FROM events) SELECT string_split(flags, ',')[2] AS code, count(*) AS n, count(CASE WHEN string_split(flags, ',')[2] IN ('1', '5') THEN 1 END) AS good FROM f GROUP BY 1""")
def quality_flag_codes(spark, sf_dir):
    f = table(spark, sf_dir, "events").select(F.concat_ws(",", "event_type", (F.col("user_id") % 6).cast("string"), F.lit("x")).alias("flags"))
    return f.groupBy(F.element_at(F.split("flags", ","), 2).alias("code")).agg(F.count(F.lit(1)).alias("n"), F.count_if(sc.quality_flag_ok(F.col("flags"), ("1", "5"))).alias("good"))


@query("compound_severity", f"""WITH {DENSE}, i AS (SELECT entity, day, value / 100 - 3 AS spei, value / 5 AS t FROM dense) SELECT entity, day, spei < -1 AND t > 35 AS compound, round(CASE WHEN spei < -1 AND t > 35 THEN abs(spei) * (t - 35) WHEN (spei < -1 AND t > 35) IS NOT NULL THEN 0.0 END, 6) AS severity FROM i""")
def compound_severity(spark, sf_dir):
    flag, severity = sc.compound(F.col("value") / 100 - 3, F.col("value") / 5)
    return dense_events(spark, sf_dir).select("entity", "day", flag, severity).withColumn("severity", r(F.col("severity")))


@query("most_stressed_stage", f"""WITH {PANEL}, y AS (SELECT entity, sum(CASE WHEN year = 1996 THEN value END) AS y1996, sum(CASE WHEN year = 1997 THEN value END) AS y1997, sum(CASE WHEN year = 1998 THEN value END) AS y1998 FROM panel GROUP BY 1)
  SELECT entity, CASE WHEN y1996 IS NULL AND y1997 IS NULL AND y1998 IS NULL THEN NULL WHEN coalesce(y1996, -1) >= coalesce(y1997, -1) AND coalesce(y1996, -1) >= coalesce(y1998, -1) THEN 'y1996' WHEN coalesce(y1997, -1) >= coalesce(y1998, -1) THEN 'y1997' ELSE 'y1998' END AS stage,
    CASE WHEN coalesce(y1996, y1997, y1998) IS NOT NULL THEN coalesce(y1996, 0.0) + coalesce(y1997, 0.0) + coalesce(y1998, 0.0) END AS total FROM y""")
def most_stressed_stage(spark, sf_dir):
    years = ["y1996", "y1997", "y1998"]
    y = order_panel(spark, sf_dir).groupBy("entity").agg(*[F.sum(F.when(F.col("year") == int(c[1:]), F.col("value"))).alias(c) for c in years])
    return y.select("entity", sc.highest_of(years).alias("stage"), sc.row_sum(years).alias("total"))


@query("quantile_losses", f"""WITH {PRED} SELECT method, round(avg(greatest(0.05 * (y - lo), -0.95 * (y - lo))), 4) AS pinball_05, round(avg(greatest(0.95 * (y - hi), -0.05 * (y - hi))), 4) AS pinball_95,
  round(avg(CASE WHEN abs(y - pred) <= 500 THEN 0.5 * pow(y - pred, 2) ELSE 500 * (abs(y - pred) - 250) END), 2) AS huber FROM pred GROUP BY 1""")
def quantile_losses(spark, sf_dir):
    y = F.col("y")
    return predictions(spark, sf_dir).groupBy("method").agg(r(F.avg(sc.pinball(y, F.col("lo"), 0.05)), 4).alias("pinball_05"), r(F.avg(sc.pinball(y, F.col("hi"), 0.95)), 4).alias("pinball_95"), r(F.avg(sc.huber(y, F.col("pred"), 500.0)), 2).alias("huber"))


@query("variable_catalog", """SELECT v.*, n.rows AS filled FROM (VALUES ('l_orderkey', 'key', '', ''), ('l_extendedprice', 'money', 'usd', ''), ('l_quantity', 'other', '', ''), ('tmax_gs', 'temperature', 'degC', 'gs'), ('ppt_ann', 'moisture', 'mm', 'ann')) v(name, kind, unit, "window")
  JOIN (SELECT unnest(['l_orderkey', 'l_extendedprice', 'l_quantity', 'tmax_gs', 'ppt_ann']) AS name, unnest([count(l_orderkey), count(l_extendedprice), count(l_quantity), count(l_tax), count(l_tax)]) AS rows FROM lineitem) n USING (name)""")
def variable_catalog(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", F.col("l_tax").alias("tmax_gs"), F.col("l_tax").alias("ppt_ann"))
    names = spark.createDataFrame([(c,) for c in li.columns], "name string")
    described = names.withColumn("_m", sc.variable_metadata(F.col("name"))).select("name", "_m.kind", "_m.unit", "_m.window")
    return audits.with_filled(described, li, "name")


@query("claim_scan", r"""SELECT source, count(*) AS documents, count(CASE WHEN regexp_matches(text, '[0-9]+ ?%|[0-9]+\.[0-9]+') THEN 1 END) AS with_numbers, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[0-9]+\.[0-9]+'))) AS BIGINT) AS decimals FROM documents GROUP BY 1""")
def claim_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("text").rlike(r"[0-9]+ ?%|[0-9]+\.[0-9]+")).alias("with_numbers"), F.sum(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[0-9]+\.[0-9]+"), 0))).alias("decimals"))


@query("global_quintile", f"""WITH {PANEL}, e AS (SELECT quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS e FROM panel), b AS (SELECT value, 1 + len(list_filter(e, lambda x: x < value)) AS quintile FROM panel CROSS JOIN e)
  SELECT CAST(quintile AS INTEGER) AS quintile, count(*) AS n, min(value) AS low, max(value) AS high FROM b GROUP BY 1""")
def global_quintile(spark, sf_dir):
    p = order_panel(spark, sf_dir)
    edges = ordering.edges(p, "value", [0.2, 0.4, 0.6, 0.8])
    held = p.crossJoin(F.broadcast(edges)).withColumn("quintile", 1 + F.size(F.filter("e", lambda x: x < F.col("value"))))
    return held.groupBy("quintile").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("neighbour_fill", f"""WITH {DENSE}, w AS (SELECT a.entity, a.day, sum(b.value / pow(a.entity - b.entity, 2)) / sum(1.0 / pow(a.entity - b.entity, 2)) AS idw FROM dense a JOIN dense b ON b.day = a.day AND b.entity <> a.entity AND abs(a.entity - b.entity) <= 2 AND b.value IS NOT NULL WHERE a.value IS NULL GROUP BY 1, 2),
  c AS (SELECT entity, CAST(dayofweek(day) + 1 AS INTEGER) AS slot, avg(value) AS mean FROM dense GROUP BY 1, 2)
  SELECT d.entity, d.day, round(coalesce(value, idw, mean), 6) AS filled, CASE WHEN value IS NOT NULL THEN 'own' WHEN idw IS NOT NULL THEN 'neighbours' WHEN mean IS NOT NULL THEN 'climatology' ELSE 'none' END AS how FROM dense d LEFT JOIN w ON w.entity = d.entity AND w.day = d.day JOIN c ON c.entity = d.entity AND c.slot = dayofweek(d.day) + 1""")
def neighbour_fill(spark, sf_dir):
    d = dense_events(spark, sf_dir)
    offsets = spark.createDataFrame([(-2,), (-1,), (1,), (2,)], "o bigint")
    neighbours = d.select("entity").distinct().crossJoin(F.broadcast(offsets)).select("entity", (F.col("entity") + F.col("o")).alias("neighbour"), F.abs("o").cast("double").alias("distance"))
    return ts.fill_gaps(d, neighbours, F.dayofweek("day")).withColumn("filled", r(F.col("filled")))


@query("nearest_neighbours", """WITH p AS (SELECT s_suppkey AS site, (s_suppkey * 6101 % 1000) / 10.0 AS x FROM supplier), k AS (SELECT a.site, b.site AS neighbour, abs(a.x - b.x) AS d, row_number() OVER (PARTITION BY a.site ORDER BY abs(a.x - b.x), b.site) AS rank FROM p a JOIN p b ON a.site <> b.site AND abs(a.x - b.x) <= 40)
  SELECT site, neighbour, CAST(rank AS INTEGER) AS rank, round(d, 6) AS d FROM k WHERE rank <= 3""")
def nearest_neighbours(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), (F.col("s_suppkey") * 6101 % 1000 / 10.0).alias("x"))
    return joins.nearest_on_line(p, 40, 3).withColumn("d", r(F.col("d")))
