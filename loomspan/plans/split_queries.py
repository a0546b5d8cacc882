"""Queries of splits, split-aware features and preprocessing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from loomspan.operators import preprocess as pre
from loomspan.operators import splits
from loomspan.plans.base import PANEL, order_panel, r
from loomspan.plans.registry import query
from loomspan.session import table


def draw_sql(seed: int, key: str, other: str, n: int) -> str:
    return f"(((((({seed} + ({key}) * 7919 + ({other}) * 104729) % 2147483647) * 48271 + 11) % 2147483647) * 69621 + 7) % 2147483647) % {n}"


def part_sql(key: str, other: str) -> str:
    u = draw_sql(42, key, other, 1_000_000)
    return f"CASE WHEN {u} < 700000 THEN 'TRAIN' WHEN {u} < 799999 THEN 'VAL' ELSE 'TEST' END"


PARTED = f"""{PANEL}, parted AS (SELECT *, {part_sql('entity', 'year')} AS by_row, {part_sql('entity', '0')} AS by_entity, CASE WHEN year <= 1997 THEN 'TRAIN' WHEN year <= 1998 THEN 'VAL' ELSE 'TEST' END AS by_year,
  CASE WHEN entity % 6 = 0 THEN 'TEST' WHEN year >= 1998 THEN 'VAL' ELSE 'TRAIN' END AS by_group FROM panel)"""


def parted(spark, sf_dir):
    p = order_panel(spark, sf_dir)
    e, y = F.col("entity"), F.col("year").cast("bigint")
    return p.withColumns({
        "by_row": splits.random_part(e, y), "by_entity": splits.random_part(e, F.lit(0)), "by_year": F.when(y <= 1997, "TRAIN").when(y <= 1998, "VAL").otherwise("TEST"),
        "by_group": F.when(e % 6 == 0, "TEST").when(y >= 1998, "VAL").otherwise("TRAIN"),
    })


for _name, _part in (("random_row_split", "by_row"), ("random_entity_split", "by_entity")):

    @query(_name, f"WITH {PARTED} SELECT {_part} AS part, count(*) AS n, count(DISTINCT entity) AS entities, CAST(sum(orders) AS BIGINT) AS orders FROM parted GROUP BY 1")
    def random_split(spark, sf_dir, part=_part):
        return parted(spark, sf_dir).groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("entities"), F.sum("orders").alias("orders"))


#: Split mode, the column of its parts, and what each part may see.
MODES = {"temporal": ("by_year", splits.ALL), "random": ("by_row", splits.OWN_AND_TRAIN), "grouped": ("by_entity", splits.OWN), "loso": ("by_group", {"TRAIN": ("TRAIN", "VAL"), "VAL": ("TRAIN", "VAL"), "TEST": ("TEST",)})}


def _see_sql(part: str, source: str, scopes: dict) -> str:
    return "(" + " OR ".join(f"{part} = '{own}' AND {source} IN ({', '.join(repr(s) for s in seen)})" for own, seen in scopes.items()) + ")"


_LAGS = " UNION ALL ".join(f"""SELECT '{m}' AS mode, p.entity, p.year, p.{c} AS part, CASE WHEN {_see_sql(f'p.{c}', f'q.{c}', s)} THEN q.value END AS lag_1
  FROM parted p LEFT JOIN parted q ON q.entity = p.entity AND q.year = p.year - 1""" for m, (c, s) in MODES.items())


@query("split_aware_lags", f"WITH {PARTED} {_LAGS}")
def split_aware_lags(spark, sf_dir):
    held = splits.scoped_lags(parted(spark, sf_dir), 1, "entity", "year", "value", MODES)
    each = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(c).alias("part"), F.col(f"lag_{m}").alias("lag_1")) for m, (c, _) in MODES.items()])
    return held.select("entity", "year", F.explode(each).alias("_m")).select("_m.mode", "entity", "year", "_m.part", "_m.lag_1")


_ROLLS = " UNION ALL ".join(f"""SELECT '{m}' AS mode, entity, year, {c} AS part, round(roll / 1e4, 6) AS roll_3 FROM (SELECT p.*, s.own, avg(value) OVER (PARTITION BY s.own, entity ORDER BY year ROWS 2 PRECEDING) AS roll
  FROM parted p JOIN (VALUES {', '.join(f"('{own}', '{x}')" for own, seen in s.items() for x in seen)}) s(own, seen) ON p.{c} = s.seen) WHERE own = {c}""" for m, (c, s) in MODES.items())


@query("split_aware_rolling", f"WITH {PARTED} {_ROLLS}")
def split_aware_rolling(spark, sf_dir):
    p = parted(spark, sf_dir)
    each = [splits.scoped_rolling(p, 3, "entity", "year", "value", c, s).select(F.lit(m).alias("mode"), "entity", "year", F.col(c).alias("part"), r(F.col("roll_3") / 1e4, 6).alias("roll_3")) for m, (c, s) in MODES.items()]
    return reduce(lambda a, b: a.unionByName(b), each)


_AUDIT = [("TRAIN", "VAL"), ("TRAIN", "TEST"), ("VAL", "TEST")]


@query("split_audit", f"""WITH {PARTED}, k AS (SELECT entity, list(DISTINCT by_year) AS l FROM parted GROUP BY 1), y AS (SELECT by_year AS part, min(year) AS a, max(year) AS z FROM parted GROUP BY 1),
  v AS (SELECT * FROM (VALUES ('TRAIN', 'VAL'), ('TRAIN', 'TEST'), ('VAL', 'TEST')) v(left_part, right_part)), s AS (SELECT left_part, right_part, count(k.entity) AS shared FROM v LEFT JOIN k ON list_contains(l, left_part) AND list_contains(l, right_part) GROUP BY 1, 2)
  SELECT left_part, right_part, shared, p.z < q.a AS in_order, CASE WHEN shared = 0 AND p.z < q.a THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s JOIN y p ON p.part = left_part JOIN y q ON q.part = right_part""")
def split_audit(spark, sf_dir):
    return splits.split_audit(parted(spark, sf_dir), "entity", "year", "by_year", _AUDIT)


@query("lag_leakage_audit", f"""WITH {PARTED}, g AS (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY year) AS v FROM parted)
  SELECT g.by_row, count(*) AS rows, count(CASE WHEN v IS NOT NULL AND v IS DISTINCT FROM q.value THEN 1 END) AS wrong_value, count(CASE WHEN v IS NOT NULL AND q.by_row <> g.by_row AND q.by_row <> 'TRAIN' THEN 1 END) AS from_other_part
  FROM g LEFT JOIN parted q ON q.entity = g.entity AND q.year = g.year - 1 GROUP BY 1""")
def lag_leakage_audit(spark, sf_dir):
    from pyspark.sql import Window

    g = parted(spark, sf_dir).withColumn("v", F.lag("value").over(Window.partitionBy("entity").orderBy("year")))
    return splits.lag_leakage(g, "entity", "year", "value", "v", 1, "by_row")


@query("audit_collector", f"""WITH {PARTED}, c AS (SELECT 'rows' AS name, count(*) > 0 AS passed FROM parted UNION ALL SELECT 'unique_keys', count(*) = count(DISTINCT (entity, year)) FROM parted UNION ALL SELECT 'three_parts', count(DISTINCT by_year) = 3 FROM parted)
  SELECT name, passed, (SELECT bool_and(passed) FROM c) AS all_passed FROM c""")
def audit_collector(spark, sf_dir):
    p = parted(spark, sf_dir)
    one = p.agg((F.count(F.lit(1)) > 0).alias("rows"), (F.count(F.lit(1)) == F.countDistinct("entity", "year")).alias("unique_keys"), (F.countDistinct("by_year") == 3).alias("three_parts"))
    names = one.columns
    return one.withColumn("all_passed", reduce(lambda a, b: a & b, map(F.col, names))).unpivot(["all_passed"], names, "name", "passed")


@query("normals_and_anomalies", f"""WITH {PANEL}, n AS (SELECT entity, avg(value) AS n FROM panel WHERE year <= 1997 GROUP BY 1), o AS (SELECT avg(value) AS o FROM panel WHERE year <= 1997)
  SELECT panel.entity, year, round(coalesce(n, o) / 1e4, 6) AS normal, round((value - coalesce(n, o)) / 1e4, 6) AS anomaly FROM panel LEFT JOIN n ON n.entity = panel.entity CROSS JOIN o""")
def normals_and_anomalies(spark, sf_dir):
    p = pre.normals_and_anomalies(order_panel(spark, sf_dir), "entity", ["value"], F.col("year") <= 1997)
    return p.select("entity", "year", r(F.col("value_normal") / 1e4, 6).alias("normal"), r(F.col("value_anomaly") / 1e4, 6).alias("anomaly"))


@query("robust_scaling", f"""WITH {PANEL}, q AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS v, quantile_cont(orders, [0.25, 0.5, 0.75]) AS o FROM panel WHERE year <= 1997)
  SELECT entity, year, round((value - v[2]) / (CASE WHEN v[3] = v[1] THEN 1 ELSE v[3] - v[1] END), 6) AS value, round((orders - o[2]) / (CASE WHEN o[3] = o[1] THEN 1 ELSE o[3] - o[1] END), 6) AS orders FROM panel CROSS JOIN q""")
def robust_scaling(spark, sf_dir):
    p = pre.robust_scale(order_panel(spark, sf_dir), ["value", "orders"], F.col("year") <= 1997)
    return p.select("entity", "year", r(F.col("value")).alias("value"), r(F.col("orders")).alias("orders"))


@query("standard_scaling", f"""WITH {PANEL}, m AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(orders) AS mo, stddev_pop(orders) AS so FROM panel WHERE year <= 1997)
  SELECT entity, year, round((value - mv) / sv, 6) AS value, round((orders - mo) / so, 6) AS orders FROM panel CROSS JOIN m""")
def standard_scaling(spark, sf_dir):
    p = pre.standard_scale(order_panel(spark, sf_dir), ["value", "orders"], F.col("year") <= 1997)
    return p.select("entity", "year", r(F.col("value")).alias("value"), r(F.col("orders")).alias("orders"))


def probit_sql(p: str) -> str:
    """Acklam's approximation in SQL (fixed values of the approximation)."""
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    q, low, high = f"({p} - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return f"CASE WHEN {p} < 0.02425 THEN {_horner(c, low)} / {_horner(d, low)} WHEN {p} > 0.97575 THEN -{_horner(c, high)} / {_horner(d, high)} ELSE {_horner(a, f'({q} * {q})')} * {q} / {_horner(b, f'({q} * {q})')} END"


def _horner(ks: tuple[float, ...], x: str) -> str:
    out = f"CAST({ks[0]!r} AS DOUBLE)"
    for k in ks[1:]:
        out = f"({out} * {x} + ({k!r}))"
    return out


@query("normal_scores", f"""WITH {PANEL}, e AS (SELECT quantile_cont(value, list_transform(range(0, 101), lambda i: i / 100.0)) AS e FROM panel WHERE year <= 1997),
  k AS (SELECT entity, year, value, e, len(list_filter(e, lambda x: x <= value)) AS k FROM panel CROSS JOIN e),
  p AS (SELECT entity, year, least(greatest(CASE WHEN k = 0 THEN 0.0 WHEN k > 100 THEN 1.0 ELSE (k - 1 + (value - e[k]) / (e[k + 1] - e[k])) / 100 END, 1e-7), 1 - 1e-7) AS p FROM k)
  SELECT entity, year, round({probit_sql('p')}, 6) AS z FROM p""")
def normal_scores(spark, sf_dir):
    return pre.normal_scores(order_panel(spark, sf_dir), "value", F.col("year") <= 1997).select("entity", "year", r(F.col("value_z")).alias("z"))


@query("structural_zero_fill", f"""WITH {PANEL}, g AS (SELECT c_custkey AS entity, y AS year FROM customer CROSS JOIN (SELECT CAST(unnest(range(1996, 2001)) AS INTEGER) AS y)),
  h AS (SELECT g.entity, g.year, g.year >= 1997 AS covered, value FROM g LEFT JOIN panel p ON p.entity = g.entity AND p.year = g.year)
  SELECT year, count(*) AS n, count(value) AS had, count(CASE WHEN value IS NULL AND covered THEN 0.0 ELSE value END) AS has FROM h GROUP BY 1""")
def structural_zero_fill(spark, sf_dir):
    grid = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.explode(F.sequence(F.lit(1996), F.lit(2000))).alias("year"))
    held = grid.join(order_panel(spark, sf_dir), ["entity", "year"], "left").withColumn("filled", pre.structural_zero("value", F.col("year") >= 1997))
    return held.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("had"), F.count("filled").alias("has"))


_HOLES = f"{PANEL}, holes AS (SELECT entity, year, CASE WHEN (entity + year) % 5 <> 0 THEN value END AS a, CASE WHEN entity % 9 = 0 THEN 'NaN'::DOUBLE ELSE orders END AS b, orders * 1.0 AS c FROM panel)"


def _holes(spark, sf_dir):
    e, y = F.col("entity"), F.col("year")
    return order_panel(spark, sf_dir).select("entity", "year", F.when((e + y) % 5 != 0, F.col("value")).alias("a"), F.when(e % 9 == 0, F.lit(float("nan"))).otherwise(F.col("orders")).alias("b"), (F.col("orders") * 1.0).cast("double").alias("c"))


@query("incomplete_rows", f"WITH {_HOLES} " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(CASE WHEN {c} IS NULL OR isnan({c}) THEN 1 END) AS bad, min(CASE WHEN {c} IS NULL OR isnan({c}) THEN entity || '/' || year END) AS first_key FROM holes""" for c in "abc"))
def incomplete_rows(spark, sf_dir):
    return pre.incomplete(_holes(spark, sf_dir), ["entity", "year"], ["a", "b", "c"])


@query("missing_before_after", f"WITH {_HOLES} " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_before, CAST(0 AS BIGINT) AS missing_after, count(*) - count({c}) AS filled FROM holes""" for c in "ac"))
def missing_before_after(spark, sf_dir):
    h = _holes(spark, sf_dir)
    return pre.missing_before_after(h, h.fillna(0.0, ["a", "c"]), ["a", "c"])
