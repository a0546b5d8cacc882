"""Views that an application serves from an entity-year panel and its predictions.

A panel holds (entity, name, state, year, weight, value, prior, dry, hot, compound, hail), predictions hold (method,
entity, year, pred, lo, hi, stratum). Every view is a filter, a join on (entity, year) and at most one aggregate.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

class Measure(NamedTuple):
    """A column of the entity table: its unit, whether entities are ranked by it and mapped by it, and whether it has a value a year."""

    name: str
    unit: str
    ranked: bool = True
    mapped: bool = True
    yearly: bool = True


MEASURES = [
    Measure("compound", "days"), Measure("credit", "money", ranked=False, yearly=False), Measure("dry", "days"), Measure("estimate", "per unit"), Measure("estimate_to_prior", "%"),
    Measure("excess", "degree days", mapped=False), Measure("hail", "reports", mapped=False), Measure("hot", "days"), Measure("observed", "per unit"), Measure("observed_to_prior", "%"),
    Measure("production", "units", mapped=False), Measure("rain", "mm"), Measure("severity", "degree days", ranked=False), Measure("share", "%", ranked=False, yearly=False),
    Measure("size", "class", ranked=False, yearly=False), Measure("spread", "per unit"), Measure("storms", "reports", ranked=False),
]
#: What entities are ranked by, and what a map shows: (column, whether it has a value a year).
METRICS = {m.name: m.unit for m in MEASURES if m.ranked}
LAYERS = {m.name: (m.name, m.yearly) for m in MEASURES if m.mapped}


def joined(panel: DataFrame, preds: DataFrame, method: str) -> DataFrame:
    """The panel with a method's predictions on the left."""
    return panel.join(preds.where(F.col("method") == method).drop("method"), ["entity", "year"], "left")


def entity_table(panel: DataFrame, preds: DataFrame, year: int, method: str) -> DataFrame:
    """One row an entity for a year, with every ranking metric."""
    m = joined(panel.where(F.col("year") == year), preds, method)
    against = lambda c: F.try_divide(100 * (F.col(c) - F.col("prior")), F.col("prior"))
    return m.withColumns({
        "estimate": F.col("pred"), "observed": F.col("value"), "estimate_to_prior": against("pred"), "observed_to_prior": against("value"), "spread": F.col("hi") - F.col("lo"), "production": F.col("pred") * F.col("weight"),
        "severity": F.col("compound") * F.col("excess"), "storms": F.when(F.coalesce("hail", "compound").isNotNull(), F.coalesce("hail", F.lit(0)) + F.coalesce("compound", F.lit(0))),
    })


def rankings(table: DataFrame, metric: str, state: str | None = None, ascending: bool = False, limit: int = 25) -> DataFrame:
    """(metric, rank, entity, name, state, metric_value) of the first `limit` entities; entities without the metric are left out."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric; choose one of {', '.join(METRICS)}")
    held = table.where(F.col(metric).isNotNull()) if state is None else table.where(F.col(metric).isNotNull() & (F.col("state") == state))
    order = [F.col(metric).asc() if ascending else F.col(metric).desc(), F.col("entity")]
    top = held.orderBy(*order).limit(limit)
    return top.select(F.lit(metric).alias("metric"), F.row_number().over(Window.orderBy(*order)).alias("rank"), "entity", "name", "state", F.col(metric).cast("double").alias("metric_value"))


def layer_values(table: DataFrame, statics: DataFrame, layer: str) -> DataFrame:
    """(layer, entity, layer_value) of a map layer, from the year's table or from columns that never change."""
    if layer not in LAYERS:
        raise ValueError(f"unknown layer; choose one of {', '.join(LAYERS)}")
    column, seasonal = LAYERS[layer]
    value = F.col(column).cast("double")
    return (table if seasonal else statics).where(value.isNotNull()).select(F.lit(layer).alias("layer"), "entity", value.alias("layer_value"))


def _weighted(value: str) -> Column:
    use = F.col(value).isNotNull() & (F.col("weight") > 0)
    return F.try_divide(F.sum(F.when(use, F.col(value) * F.col("weight"))), F.sum(F.when(use, F.col("weight"))))


def state_summary(panel: DataFrame, preds: DataFrame, year: int, method: str) -> DataFrame:
    """One row a state for a year: counts, weighted means of values and estimates, totals and stress."""
    m = joined(panel.where(F.col("year") == year), preds, method)
    estimate = lambda v: F.try_divide(F.sum(F.when(F.col("pred").isNotNull() & (F.col("weight") > 0), F.col(v) * F.col("weight"))), F.sum(F.when(F.col("pred").isNotNull() & (F.col("weight") > 0), F.col("weight"))))
    return m.groupBy("state").agg(
        F.countDistinct("entity").alias("entities"), F.count("value").alias("with_value"), F.count("pred").alias("with_estimate"), _weighted("value").alias("observed_weighted"), _weighted("prior").alias("prior_weighted"),
        estimate("pred").alias("estimate_weighted"), estimate("lo").alias("lower_weighted"), estimate("hi").alias("upper_weighted"), F.sum(F.col("value") * F.col("weight")).alias("production_observed"),
        F.sum(F.col("pred") * F.col("weight")).alias("production_estimated"), F.sum("weight").alias("weight"), F.count_if(F.col("compound") >= 3).alias("compound_high"), F.count_if(F.col("compound").between(1, 2)).alias("compound_moderate"),
        F.avg("dry").alias("mean_dry"), F.avg("hot").alias("mean_hot"),
    ).withColumn("season", F.lit(year))


def state_series(panel: DataFrame, preds: DataFrame, method: str) -> DataFrame:
    """(state, year, observed, estimate, production, compound) over all years."""
    m = joined(panel, preds, method)
    return m.groupBy("state", "year").agg(_weighted("value").alias("observed"), _weighted("pred").alias("estimate"), F.sum(F.col("value") * F.col("weight")).alias("production"), F.avg("compound").alias("compound"))


def entity_series(panel: DataFrame, preds: DataFrame, entities: list[int], method: str) -> DataFrame:
    """Rows of up to six entities over all years with estimates where there are any: one for a profile, more to compare."""
    if not 1 <= len(entities) <= 6:
        raise ValueError("name one to six entities")
    return joined(panel.where(F.col("entity").isin(*entities)), preds.where(F.col("entity").isin(*entities)), method)


def manifest(panel: DataFrame, preds: DataFrame) -> DataFrame:
    """One row about the store: rows, entities and years of the panel; methods and years of the predictions."""
    a = panel.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("entity").alias("entities"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    b = preds.agg(F.countDistinct("method").alias("methods"), F.min("year").alias("first_estimate"), F.max("year").alias("last_estimate"))
    return a.crossJoin(b)


def search(names: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """(entity, name, state) of names that start with the text; "name, state" also fixes how the state begins."""
    prefix, _, state = (x.strip().lower() for x in text.partition(","))
    held = names.where(F.lower("name").startswith(prefix))
    held = held.where(F.lower("state").startswith(state)) if state else held
    return held.select("entity", "name", "state").orderBy("name", "entity").limit(limit)


def lookup(tool: str, panel: DataFrame, preds: DataFrame, **given) -> DataFrame:
    """A view by name and arguments, for callers that choose it at run time."""
    method = given.get("method", "N")
    tools = {
        "manifest": lambda: manifest(panel, preds), "search": lambda: search(panel.select("entity", "name", "state").distinct(), given["text"]), "profile": lambda: entity_series(panel, preds, [given["entity"]], method),
        "compare": lambda: entity_series(panel, preds, given["entities"], method), "table": lambda: entity_table(panel, preds, given["year"], method), "states": lambda: state_summary(panel, preds, given["year"], method),
        "state_series": lambda: state_series(panel, preds, method), "rankings": lambda: rankings(entity_table(panel, preds, given["year"], method), given["metric"], given.get("state")), "point": lambda: joined(panel.where((F.col("entity") == given["entity"]) & (F.col("year") == given["year"])), preds, method),
    }
    if tool not in tools:
        raise ValueError(f"unknown tool; choose one of {', '.join(tools)}")
    return tools[tool]()


def csv_report(rows: DataFrame, order: list[str], notes: dict[str, str]) -> DataFrame:
    """(at, line): a report's text with comment lines first, then the header, then a CSV line a row in order.

    Reports are short: the rows are numbered in one task.
    """
    head = [f"# {k}: {v}" for k, v in notes.items()] + [",".join(rows.columns)]
    start = rows.sparkSession.createDataFrame(list(enumerate(head)), "at int, line string")
    body = rows.select((F.row_number().over(Window.orderBy(*order)) + len(head) - 1).alias("at"), F.to_csv(F.struct(*rows.columns)).alias("line"))
    return start.union(body)
