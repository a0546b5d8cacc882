"""Queries of audits, coverage and joins on the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from loomspan.operators import audits, ordering
from loomspan.operators import timeseries as ts
from loomspan.plans.base import PANEL, order_panel, r
from loomspan.plans.registry import query
from loomspan.session import table
from loomspan.sources import readers, writers


def _all(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


_COLS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("constant_columns", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS kinds, round(stddev_samp({c}), 6) AS sd, CASE WHEN count(DISTINCT {c}) <= 1 THEN 'constant' WHEN stddev_samp({c}) < 0.03 THEN 'near_constant' ELSE 'varies' END AS verdict FROM t""" for c in [*_COLS, "one"]).replace("FROM t", "FROM (SELECT *, 1 AS one FROM lineitem)"))
def constant_columns(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1))
    return audits.constant_columns(df, [*_COLS, "one"], 0.03).withColumn("sd", r(F.col("sd")))


@query("constant_by_partition", " UNION ALL ".join(f"""SELECT l_returnflag, '{c}' AS "column", round(stddev_pop({c}), 6) AS sd, stddev_pop({c}) <= 0.03 AS constant FROM lineitem GROUP BY 1""" for c in _COLS))
def constant_by_partition(spark, sf_dir):
    return audits.constant_by_part(table(spark, sf_dir, "lineitem"), "l_returnflag", _COLS, 0.03).withColumn("sd", r(F.col("sd")))


_LAGGED = f"{PANEL}, g AS (SELECT *, CASE WHEN year <= 1997 THEN 'FIT' ELSE 'TEST' END AS part, lag(value) OVER w AS lag_1, lag(value, 2) OVER w AS lag_2 FROM panel WINDOW w AS (PARTITION BY entity ORDER BY year))"


@query("lag_null_fractions", f"WITH {_LAGGED} " + " UNION ALL ".join(f"""SELECT coalesce(part, 'ALL') AS part, coalesce(CAST(year AS VARCHAR), 'ALL') AS year, '{c}' AS "column", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM g GROUP BY GROUPING SETS ((part), (year), ())""" for c in ("lag_1", "lag_2")))
def lag_null_fractions(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("entity").orderBy("year")
    g = order_panel(spark, sf_dir).withColumns({"part": F.when(F.col("year") <= 1997, "FIT").otherwise("TEST"), "lag_1": F.lag("value").over(w), "lag_2": F.lag("value", 2).over(w)})
    return audits.null_fractions(g, ["lag_1", "lag_2"], ["part", "year"]).withColumn("fraction", r(F.col("fraction")))


@query("static_or_varying", "WITH o AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS a, count(DISTINCT o_orderpriority) AS b, count(DISTINCT c_mktsegment) AS c FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) " + " UNION ALL ".join(f"""SELECT '{n}' AS "column", max({c}) AS most_values, CASE WHEN max({c}) <= 1 THEN 'static' ELSE 'time_varying' END AS kind FROM o""" for n, c in (("o_orderstatus", "a"), ("o_orderpriority", "b"), ("c_mktsegment", "c"))))
def static_or_varying(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return audits.varying_columns(o, "o_custkey", ["o_orderstatus", "o_orderpriority", "c_mktsegment"])


@query("source_inventory", """SELECT 'orders' AS source, count(*) AS rows, count(DISTINCT o_custkey) AS entities, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) - count(o_totalprice) AS nulls,
    (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) AS repeated FROM orders
  UNION ALL SELECT 'events', count(*), count(DISTINCT user_id), CAST(min(year(ts)) AS INTEGER), CAST(max(year(ts)) AS INTEGER), min(value), max(value), count(*) - count(value), (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) > 1)) FROM events""")
def source_inventory(spark, sf_dir):
    o, e = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    return _all([audits.inventory(o, "orders", ["o_orderkey"], "o_custkey", F.year("o_orderdate"), "o_totalprice"), audits.inventory(e, "events", ["user_id", "event_type"], "user_id", F.year("ts"), "value")])


_GROUPS = {"key": ["o_orderkey", "o_custkey"], "target": ["o_totalprice"], "planned": ["o_weight"]}


@query("column_registry", """WITH n AS (SELECT count(o_orderkey) AS k, count(o_custkey) AS c, count(o_totalprice) AS p FROM orders)
  SELECT 'key' AS "group", 'o_orderkey' AS "column", true AS present, k AS filled FROM n UNION ALL SELECT 'key', 'o_custkey', true, c FROM n UNION ALL SELECT 'target', 'o_totalprice', true, p FROM n UNION ALL SELECT 'planned', 'o_weight', false, NULL FROM n""")
def column_registry(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return audits.with_filled(audits.schema_registry(orders, _GROUPS), orders)


@query("column_lineage", f"""WITH {PANEL}, n AS (SELECT count(entity) AS e, count(value) AS v, count(CASE WHEN year > 1995 THEN value END) AS l FROM panel)
  SELECT 'entity' AS "column", 'bigint' AS type, 'orders' AS source, 'none' AS timing, e AS filled FROM n UNION ALL SELECT 'rain_gs', 'double', 'weather', 'within season', v FROM n UNION ALL SELECT 'rain_ann', 'double', 'weather', 'whole year', v FROM n UNION ALL SELECT 'value_lag1', 'double', 'derived', 'earlier years', l FROM n""")
def column_lineage(spark, sf_dir):
    p = order_panel(spark, sf_dir).select("entity", F.col("value").alias("rain_gs"), F.col("value").alias("rain_ann"), F.when(F.col("year") > 1995, F.col("value")).alias("value_lag1"))
    return audits.with_filled(audits.lineage(p, {"orders": ["entity"], "weather": ["rain_gs", "rain_ann"]}), p)


@query("predictor_audit", " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(corr({c}, l_extendedprice), 6) AS r, abs(corr({c}, l_extendedprice)) > 0.5 AS suspicious FROM lineitem WHERE l_shipdate < DATE '1998-01-01'""" for c in ("l_quantity", "l_discount", "l_tax")))
def predictor_audit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return audits.predictor_audit(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp"), 0.5).withColumn("r", r(F.col("r")))


@query("recount_validation", """WITH a AS (SELECT user_id, count(*) AS events, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events GROUP BY 1), b AS (SELECT user_id, count(*) AS events, count(CASE WHEN event_type = 'error' AND user_id % 4 <> 0 THEN 1 END) AS errors FROM events GROUP BY 1)
  SELECT 'events' AS "count", count(*) AS compared, count(CASE WHEN a.events <> b.events THEN 1 END) AS different FROM a JOIN b USING (user_id) UNION ALL SELECT 'errors', count(*), count(CASE WHEN a.errors <> b.errors THEN 1 END) FROM a JOIN b USING (user_id)""")
def recount_validation(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    own = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(error).alias("errors"))
    published = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(error & (F.col("user_id") % 4 != 0)).alias("errors"))
    return audits.recount(own, published, "user_id", ["events", "errors"])


@query("positional_join", """WITH a AS (SELECT o_custkey AS k, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS at FROM orders), b AS (SELECT o_custkey AS k, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS at FROM orders)
  SELECT a.k % 10 AS bucket, count(*) AS n, count(CASE WHEN a.id = b.id THEN 1 END) AS matching FROM a LEFT JOIN b ON a.k = b.k AND a.at = b.at GROUP BY 1""")
def positional_join(spark, sf_dir):
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("day"))
    a = o.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy("day", "id"))).select("k", "id", "at")
    b = o.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy("id"))).select("k", "id", "at")
    return audits.positional_join(a, b, ["k", "at"], "id").groupBy((F.col("k") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if("matches").alias("matching"))


@query("join_chain", f"""WITH {PANEL}, e AS (SELECT user_id AS entity, count(*) AS events FROM events GROUP BY 1), s AS (SELECT c_custkey AS entity, c_nationkey, c_acctbal AS orders_credit FROM customer)
  SELECT p.entity, p.year, p.orders, c_nationkey AS nation, n_name AS nation_name, round(orders_credit, 2) AS orders_credit, events FROM panel p LEFT JOIN s ON s.entity = p.entity LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN e ON e.entity = p.entity""")
def join_chain(spark, sf_dir):
    out, _ = _chain(spark, sf_dir)
    return out.select("entity", "year", "orders", "nation", "nation_name", r(F.col("orders_credit"), 2).alias("orders_credit"), "events")


@query("join_chain_audit", f"""WITH {PANEL}, e AS (SELECT user_id AS entity, count(*) AS events FROM events GROUP BY 1), j AS (SELECT p.entity, c_custkey, c_nationkey, c_acctbal, n_nationkey, n_name, events FROM panel p LEFT JOIN customer ON c_custkey = p.entity LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN e ON e.entity = p.entity),
  s AS (SELECT 'credit' AS step, 4 AS before, 2 AS added, (SELECT count(*) FROM customer) AS theirs, count(*) AS n, count(*) FILTER (c_custkey IS NULL) AS un, count(*) FILTER (c_nationkey IS NULL) + count(*) FILTER (c_acctbal IS NULL) AS miss FROM j
        UNION ALL SELECT 'nation', 6, 1, (SELECT count(*) FROM nation), count(*), count(*) FILTER (n_nationkey IS NULL), count(*) FILTER (n_name IS NULL) FROM j
        UNION ALL SELECT 'events', 7, 1, (SELECT count(*) FROM e), count(*), count(*) FILTER (events IS NULL), count(*) FILTER (events IS NULL) FROM j)
  SELECT step, n AS rows_before, n AS rows_after, CAST(before AS INTEGER) AS columns_before, CAST(before + added AS INTEGER) AS columns_after, CAST(added AS INTEGER) AS columns_added, theirs AS right_rows, CAST(0 AS BIGINT) AS duplicate_keys, un AS rows_unmatched, miss AS new_missing FROM s""")
def join_chain_audit(spark, sf_dir):
    return _chain(spark, sf_dir)[1]


def _chain(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    steps = [
        ("credit", t("customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("orders")), ["entity"]),
        ("nation", t("nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("nation_name")), ["nation"]),
        ("events", t("events").groupBy(F.col("user_id").alias("entity")).agg(F.count(F.lit(1)).alias("events")), ["entity"]),
    ]
    return audits.join_chain(order_panel(spark, sf_dir), steps)


@query("value_counts", "SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n, count(DISTINCT o_custkey) AS entities FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), count(DISTINCT o_custkey) FROM orders GROUP BY 2")
def value_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").unpivot(["o_custkey"], ["o_orderstatus", "o_orderpriority"], "column", "value")
    return o.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("entities"))


@query("repeated_key_flags", "SELECT l_suppkey, l_partkey, count(*) > 1 AS repeated, count(*) AS n FROM lineitem GROUP BY 1, 2")
def repeated_key_flags(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select("l_suppkey", "l_partkey", (F.col("n") > 1).alias("repeated"), "n")


@query("source_overlap", f"""WITH {PANEL}, e AS (SELECT user_id AS entity, count(*) AS n FROM events GROUP BY 1), c AS (SELECT c_custkey AS entity, EXISTS (SELECT 1 FROM panel WHERE panel.entity = c_custkey AND year = 1996) AS in_1996, EXISTS (SELECT 1 FROM panel WHERE panel.entity = c_custkey AND year = 1999) AS in_1999, EXISTS (SELECT 1 FROM e WHERE e.entity = c_custkey) AS in_events FROM customer)
  SELECT count(CASE WHEN in_1996 THEN 1 END) AS s_1996, count(CASE WHEN in_1999 THEN 1 END) AS s_1999, count(CASE WHEN in_events THEN 1 END) AS s_events, count(CASE WHEN in_1996 AND NOT in_1999 AND NOT in_events THEN 1 END) AS only_1996, count(CASE WHEN in_1996 AND in_1999 AND in_events THEN 1 END) AS in_all FROM c""")
def source_overlap(spark, sf_dir):
    p = order_panel(spark, sf_dir)
    mark = lambda df, name: df.select(F.col("entity")).distinct().withColumn(name, F.lit(True))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"))
    for df, name in ((p.where("year = 1996"), "in_1996"), (p.where("year = 1999"), "in_1999"), (events, "in_events")):
        c = c.join(mark(df, name), "entity", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    a, b, e = F.col("in_1996"), F.col("in_1999"), F.col("in_events")
    return c.agg(F.count_if(a).alias("s_1996"), F.count_if(b).alias("s_1999"), F.count_if(e).alias("s_events"), F.count_if(a & ~b & ~e).alias("only_1996"), F.count_if(a & b & e).alias("in_all"))


@query("completeness_by_year", f"""WITH {PANEL}, g AS (SELECT c_custkey AS entity, y AS year FROM customer CROSS JOIN (SELECT CAST(unnest(range(1995, 2001)) AS INTEGER) AS y)),
  h AS (SELECT g.year, CASE WHEN p.orders IS NULL THEN 'missing' WHEN p.orders >= 2 THEN 'full' ELSE 'partial' END AS state FROM g LEFT JOIN panel p ON p.entity = g.entity AND p.year = g.year)
  SELECT year, count(CASE WHEN state = 'full' THEN 1 END) AS "full", count(CASE WHEN state = 'partial' THEN 1 END) AS "partial", count(CASE WHEN state = 'missing' THEN 1 END) AS missing FROM h GROUP BY 1""")
def completeness_by_year(spark, sf_dir):
    grid = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.explode(F.sequence(F.lit(1995), F.lit(2000))).alias("year"))
    held = grid.join(order_panel(spark, sf_dir), ["entity", "year"], "left")
    n = F.col("orders")
    return held.groupBy("year").agg(F.count_if(n >= 2).alias("full"), F.count_if(n < 2).alias("partial"), F.count_if(n.isNull()).alias("missing"))


@query("event_taxonomy_coverage", """SELECT CAST(ts AS DATE) AS day, count(*) AS events, count(DISTINCT event_type) AS kinds, count(CASE WHEN value IS NULL THEN 1 END) AS null_values, count(CASE WHEN props IS NULL OR props = '' THEN 1 END) AS without_props, round(count(DISTINCT event_type) / 5.0, 6) AS covered FROM events GROUP BY 1""")
def event_taxonomy_coverage(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("event_type").alias("kinds"), F.count_if(F.col("value").isNull()).alias("null_values"),
        F.count_if(F.col("props").isNull() | (F.col("props") == "")).alias("without_props"), r(F.countDistinct("event_type") / F.lit(5.0)).alias("covered"),
    )


@query("season_type_counts", """WITH g AS (SELECT u.user_id AS entity, w.w AS week FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT CAST(date_trunc('week', ts) AS DATE) AS w FROM events) w),
  c AS (SELECT user_id AS entity, CAST(date_trunc('week', ts) AS DATE) AS week, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchases FROM events WHERE dayofmonth(ts) BETWEEN 4 AND 25 GROUP BY 1, 2)
  SELECT g.entity, g.week, CASE WHEN g.week >= DATE '2024-01-08' THEN coalesce(errors, 0) END AS errors, CASE WHEN g.week >= DATE '2024-01-08' THEN coalesce(purchases, 0) END AS purchases FROM g LEFT JOIN c ON c.entity = g.entity AND c.week = g.week""")
def season_type_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("week", F.to_date(F.date_trunc("week", "ts"))).withColumn("entity", F.col("user_id"))
    grid = e.select("entity").distinct().crossJoin(F.broadcast(e.select("week").distinct()))  # weeks are few
    counts = e.where(F.dayofmonth("ts").between(4, 25)).groupBy("entity", "week").agg(*[F.count_if(F.col("event_type") == k).alias(n) for k, n in (("error", "errors"), ("purchase", "purchases"))])
    known = F.col("week") >= F.lit("2024-01-08").cast("date")  # earlier weeks were not recorded by type
    held = grid.join(counts, ["entity", "week"], "left")
    return held.select("entity", "week", *[F.when(known, F.coalesce(n, F.lit(0))).alias(n) for n in ("errors", "purchases")])


@query("hourly_to_daily", """WITH h AS (SELECT user_id % 2 AS cell, date_trunc('hour', ts) AS hour, avg(value) AS v FROM events GROUP BY 1, 2)
  SELECT cell, CAST(hour AS DATE) AS day, round(avg(v), 6) AS mean, round(min(v), 6) AS low, round(max(v), 6) AS high, round(sum(v), 6) AS total FROM h GROUP BY 1, 2 HAVING count(*) >= 8""")
def hourly_to_daily(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 2).alias("cell"), F.date_trunc("hour", "ts").alias("hour"), "value")
    hourly = e.groupBy("cell", "hour").agg(F.avg("value").alias("v"))
    out = ts.hourly_to_daily(hourly, "cell", "hour", "v", 8)
    return out.select("cell", "day", *[r(F.col(c)).alias(c) for c in ("mean", "low", "high", "total")])


@query("identity_ratio", """WITH s AS (SELECT l_suppkey AS entity, sum(l_quantity) AS q, sum(l_extendedprice) AS p, avg(l_extendedprice / l_quantity) AS u FROM lineitem GROUP BY 1) SELECT entity, round(p / (q * u), 6) AS ratio, round((p - q * u) / (q * u), 6) AS difference FROM s""")
def identity_ratio(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("u"))
    expected = F.col("q") * F.col("u")
    return s.select("entity", r(F.try_divide("p", expected)).alias("ratio"), r(F.try_divide(F.col("p") - expected, expected)).alias("difference"))


@query("reference_median_scaling", """WITH m AS (SELECT median(p_retailprice) AS m FROM part), b AS (SELECT p_brand, median(p_retailprice) AS bm FROM part GROUP BY 1) SELECT p_partkey, round(p_retailprice * m / bm, 4) AS corrected FROM part JOIN b USING (p_brand) CROSS JOIN m""")
def reference_median_scaling(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    own, whole = ordering.quantiles_with_pool(p, "p_brand", "p_retailprice", lambda n: F.lit(0.5))
    own, whole = own.select("p_brand", F.col("q").alias("bm")), whole.select(F.col("q").alias("m"))
    return p.join(own, "p_brand").crossJoin(F.broadcast(whole)).select("p_partkey", r(F.col("p_retailprice") * F.col("m") / F.col("bm"), 4).alias("corrected"))


@query("target_profile", """SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS low, max(o_totalprice) AS high, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(median(o_totalprice), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75,
  count(CASE WHEN o_orderpriority IS NULL THEN 1 END) AS null_priority FROM orders""")
def target_profile(spark, sf_dir):
    v = "o_totalprice"
    o = table(spark, sf_dir, "orders")
    one = o.agg(F.count(v).alias("n"), r(F.avg(v), 4).alias("mean"), r(F.stddev(v), 4).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"), F.count_if(F.col("o_orderpriority").isNull()).alias("null_priority"))
    one = one.crossJoin(F.broadcast(ordering.edges(o, v, [0.25, 0.5, 0.75], "q")))
    return one.select("n", "mean", "sd", "low", "high", *[r(F.col("q")[i], 4).alias(f"q{k}") for i, k in enumerate((25, 50, 75))], "null_priority")


@query("field_inspection", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS rows, 'o_weight' AS missing_fields, min(o_orderstatus) AS sample_status, count(DISTINCT o_orderstatus) AS statuses FROM orders GROUP BY 1""")
def field_inspection(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    missing = ",".join(c for c in ("o_orderkey", "o_totalprice", "o_weight") if c not in o.columns)
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("rows"), F.lit(missing).alias("missing_fields"), F.min("o_orderstatus").alias("sample_status"), F.countDistinct("o_orderstatus").alias("statuses"))


@query("source_precedence", """WITH a AS (SELECT l_suppkey AS k, l_partkey AS p, max(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), b AS (SELECT l_suppkey AS k, l_partkey AS p, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)
  SELECT b.k, b.p, CASE WHEN a.k IS NOT NULL THEN 1 ELSE 2 END AS source_rank, coalesce(a.v, b.v) AS v FROM b LEFT JOIN a ON a.k = b.k AND a.p = b.p""")
def source_precedence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("p"), "l_quantity", "l_extendedprice", "l_returnflag")
    of = lambda df, c: df.groupBy("k", "p").agg(F.max(c).alias("v"))
    return readers.by_precedence([of(li.where("l_returnflag = 'R'"), "l_quantity"), of(li, "l_extendedprice")], ["k", "p"])


@query("typed_records", """SELECT DISTINCT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 50 END AS v FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1997""")
def typed_records(spark, sf_dir):
    text = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("string").alias("year"), F.when(F.col("o_orderkey") % 3 == 0, "(D)").otherwise((F.col("o_orderkey") % 50).cast("string")).alias("v"))
    return readers.typed_records(text, {"year": "int", "v": "bigint"}, "year", 1996, 1997)


@query("crosswalk_codes", """SELECT DISTINCT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS zone, lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS code, substring(lpad(CAST(s_nationkey AS VARCHAR), 3, '0'), 1, 2) AS state FROM supplier""")
def crosswalk_codes(spark, sf_dir):
    from loomspan.functions.scalars import padded_code

    code = padded_code(F.col("s_nationkey"), 3)
    return table(spark, sf_dir, "supplier").select(padded_code(F.col("s_suppkey"), 6).alias("zone"), code.alias("code"), F.substring(code, 1, 2).alias("state")).distinct()


@query("run_comparison", """WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS v, count(*) AS n FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1), b AS (SELECT o_custkey AS k, sum(o_totalprice) AS v, count(*) AS n FROM orders WHERE o_custkey % 7 <> 0 AND o_orderkey % 10 <> 0 GROUP BY 1), j AS (SELECT a.k AS ak, b.k AS bk, a.v AS av, b.v AS bv, a.n AS an, b.n AS bn FROM a FULL JOIN b ON a.k = b.k)
  SELECT 'v' AS value, count(CASE WHEN ak IS NOT NULL AND bk IS NOT NULL THEN 1 END) AS "both", count(CASE WHEN bk IS NULL THEN 1 END) AS only_a, count(CASE WHEN ak IS NULL THEN 1 END) AS only_b, count(CASE WHEN abs(av - bv) > 0.001 THEN 1 END) AS different, round(max(abs(av - bv)), 2) AS largest FROM j
  UNION ALL SELECT 'n', count(CASE WHEN ak IS NOT NULL AND bk IS NOT NULL THEN 1 END), count(CASE WHEN bk IS NULL THEN 1 END), count(CASE WHEN ak IS NULL THEN 1 END), count(CASE WHEN abs(an - bn) > 0.001 THEN 1 END), round(CAST(max(abs(an - bn)) AS DOUBLE), 2) FROM j""")
def run_comparison(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    of = lambda df: df.groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))
    out = writers.compare_runs(of(o.where("o_custkey % 5 <> 0")), of(o.where("o_custkey % 7 <> 0 AND o_orderkey % 10 <> 0")), ["k"], ["v", "n"], 0.001)
    return out.withColumn("largest", r(F.col("largest"), 2))


_PARTS = """CASE WHEN year <= 1996 THEN 'train' WHEN year = 1997 THEN 'es' WHEN year = 1998 THEN 'dev' WHEN year = 1999 THEN 'cal' ELSE 'test' END"""


@query("disjoint_parts", f"""WITH {PANEL}, s AS (SELECT entity || '_' || CASE WHEN year = 1998 AND entity % 50 = 1 THEN 1999 ELSE year END AS id, {_PARTS} AS part FROM panel), m AS (SELECT DISTINCT id, part FROM s),
  k AS (SELECT unnest(['train', 'dev', 'cal', 'train', 'train', 'dev', 'es', 'es', 'es']) AS a, unnest(['test', 'test', 'test', 'dev', 'cal', 'cal', 'dev', 'cal', 'test']) AS b,
        unnest(['train_test', 'validation_test', 'calibration_test', 'train_validation', 'train_calibration', 'validation_calibration', 'earlystop_validation', 'earlystop_calibration', 'earlystop_test']) || '_overlap' AS label),
  c AS (SELECT label, a, b, (SELECT count(*) FROM m WHERE part = a) AS l, (SELECT count(*) FROM m WHERE part = b) AS r, (SELECT count(*) FROM m x JOIN m y ON x.id = y.id WHERE x.part = a AND y.part = b) AS shared FROM k)
  SELECT label, a AS left_part, b AS right_part, l AS left_rows, r AS right_rows, shared, CASE WHEN shared = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c""")
def disjoint_parts(spark, sf_dir):
    p = order_panel(spark, sf_dir)
    moved = F.when((F.col("year") == 1998) & (F.col("entity") % 50 == 1), 1999).otherwise(F.col("year"))  # a planted leak: these share their key with the next year
    return audits.disjoint_parts(p.select(F.concat_ws("_", "entity", moved).alias("id"), F.expr(_PARTS).alias("part")), "id", "part")


@query("agreement_gate", """SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS price FROM lineitem WHERE (SELECT corr(l_extendedprice, l_extendedprice * (1 - l_discount)) FROM lineitem) >= 0.95 GROUP BY 1""")
def agreement_gate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    return audits.agreement_gate(li, "l_extendedprice", "net").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_extendedprice"), 4).alias("price"))


@query("method_gate", f"""WITH {PANEL}, s AS (SELECT *, {_PARTS} AS part FROM panel) SELECT part, count(*) AS n, 'orders' AS index_column FROM s GROUP BY 1""")
def method_gate(spark, sf_dir):
    p = order_panel(spark, sf_dir).withColumn("part", F.expr(_PARTS))
    held, index = audits.method_gate(p, "part", ["train", "dev", "cal", "test"], "severity", "orders", ["value", "year"])
    return held.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.lit(index).alias("index_column"))
