"""Audits of tables and columns: each is one or two aggregates, and gives a row for every column or check."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomspan import scratch


def constant_columns(df: DataFrame, columns: list[str], tiny: float = 1e-4) -> DataFrame:
    """(column, kinds, sd, verdict): constant with one distinct value at most, near_constant with a deviation below `tiny`."""
    one = df.agg(*[F.struct(F.countDistinct(c).alias("kinds"), F.stddev_samp(F.col(c).cast("double")).alias("sd")).alias(c) for c in columns])
    long = one.unpivot([], columns, "column", "_s").select("column", "_s.kinds", "_s.sd")
    return long.withColumn("verdict", F.when(F.col("kinds") <= 1, "constant").when(F.col("sd") < tiny, "near_constant").otherwise("varies"))


def constant_by_part(df: DataFrame, part: str, columns: list[str], tiny: float = 1e-9) -> DataFrame:
    """(part, column, sd, constant) of each column within each part."""
    wide = df.groupBy(part).agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in columns])
    return wide.unpivot([part], columns, "column", "sd").withColumn("constant", F.coalesce(F.col("sd") <= tiny, F.lit(True)))


def null_fractions(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, column, fraction) of nulls by every key and over ALL, from one grouping-sets pass."""
    sets = [[F.col(k)] for k in keys] + [[]]
    nulls = [F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns]
    marks = [F.grouping(k).alias(f"_g_{k}") for k in keys]
    wide = df.groupingSets(sets, *[F.col(k) for k in keys]).agg(*marks, *nulls)
    wide = wide.withColumns({k: F.when(F.col(f"_g_{k}") == 1, "ALL").otherwise(F.col(k).cast("string")) for k in keys})
    return wide.unpivot(keys, columns, "column", "fraction")


def varying_columns(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """(column, most_values, kind): static if no entity has more than one value of the column."""
    per = df.groupBy(entity).agg(*[F.countDistinct(c).alias(c) for c in columns])
    long = per.agg(*[F.max(c).alias(c) for c in columns]).unpivot([], columns, "column", "most_values")
    return long.withColumn("kind", F.when(F.col("most_values") <= 1, "static").otherwise("time_varying"))


def inventory(df: DataFrame, name: str, key: list[str], entity: str, year: Column, value: str) -> DataFrame:
    """One row on a source: rows, entities, years, repeated keys, value range and null values."""
    keys = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("repeated"))
    one = df.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(entity).alias("entities"), F.min(year).alias("first_year"), F.max(year).alias("last_year"),
        F.min(value).alias("low"), F.max(value).alias("high"), F.count_if(F.col(value).isNull()).alias("nulls"),
    )
    return one.crossJoin(F.broadcast(keys)).select(F.lit(name).alias("source"), "*")


def schema_registry(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(group, column, present) for the columns that each group must have; the plan alone is looked at, no data."""
    have = set(df.columns)
    rows = [(g, c, c in have) for g, columns in groups.items() for c in columns]
    return df.sparkSession.createDataFrame(rows, "`group` string, `column` string, present boolean")


def require_columns(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """df itself; raises ValueError naming the columns that are missing."""
    missing = [f"{g}.{c}" for g, columns in groups.items() for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def gate(df: DataFrame, figures: dict[str, Column], holds: Column, name: str) -> DataFrame:
    """df itself, whose rows come only if `holds` is true of its figures, which are aggregates; else whatever reads them fails.

    The check is part of the plan: a write that depends on the gate stops, naming the gate and its figures.
    """
    one = df.agg(*[v.alias(f"_gate_{k}") for k, v in figures.items()])
    figure = lambda k: F.coalesce(F.col(f"_gate_{k}").cast("string"), F.lit("null"))
    told = F.concat(F.lit(f"gate {name}: "), F.concat_ws(", ", *[F.concat(F.lit(f"{k} = "), figure(k)) for k in figures]))
    state = one.select(F.assert_true(F.coalesce(holds, F.lit(False)), told).alias("_gate"))
    return df.crossJoin(F.broadcast(state)).where(F.col("_gate").isNull()).drop("_gate")


def agreement_gate(pairs: DataFrame, x: str, y: str, least: float = 0.95) -> DataFrame:
    """pairs, if their correlation is `least` at least; an empty table has none and lets no write through but an empty one."""
    return gate(pairs, {"n": F.count(F.lit(1)), "r": F.corr(x, y)}, (F.col("_gate_n") == 0) | (F.col("_gate_r") >= least), "agreement")


def method_gate(df: DataFrame, split: str, parts: list[str], preferred: str, fallback: str, needed: list[str]) -> tuple[DataFrame, str]:
    """(df, the index column to use): df must have the needed columns and one of two index columns, or ValueError; and each part of the split a row, or what reads it fails."""
    require_columns(df, {"needed": [split, *needed]})
    index = preferred if preferred in df.columns else fallback
    require_columns(df, {"index": [index]})
    figures = {p: F.count_if(F.col(split) == p) for p in parts}
    whole = F.lit(True)
    for p in parts:
        whole = whole & (F.col(f"_gate_{p}") > 0)
    return gate(df, figures, whole, "split"), index


def with_filled(described: DataFrame, df: DataFrame, name: str = "column") -> DataFrame:
    """described with `filled`, the rows of df in which the named column has a value; null for a column that is not there."""
    one = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, name, "filled")
    return described.join(one, name, "left")


def lineage(df: DataFrame, sources: dict[str, list[str]], default: str = "derived") -> DataFrame:
    """(column, type, source, timing): where each column comes from, and the window that its name's end speaks of."""
    of = {c: s for s, columns in sources.items() for c in columns}
    rows = [(f.name, f.dataType.simpleString(), of.get(f.name, default)) for f in df.schema.fields]
    out = df.sparkSession.createDataFrame(rows, "`column` string, type string, source string")
    end = F.regexp_extract("column", "_(ann|gs|veg|silk|grain|lag[0-9]+|roll[0-9]+)$", 1)
    return out.withColumn("timing", F.when(end == "", "none").when(end.startswith("lag") | end.startswith("roll"), "earlier years").when(end == "ann", "whole year").otherwise("within season"))


def predictor_audit(df: DataFrame, columns: list[str], target: str, fit: Column, limit: float = 0.9) -> DataFrame:
    """(column, r, suspicious): correlation with the target over the rows with `fit`, and whether it is beyond the limit."""
    one = df.where(fit).agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "r").withColumn("suspicious", F.coalesce(F.abs("r") > limit, F.lit(False)))


def recount(own: DataFrame, published: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """(count, compared, different) of counts worked out anew against published ones, over the keys of either."""
    theirs = published.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in counts])
    both = own.join(theirs, F.col(key) == F.col("_k"), "full_outer")
    one = both.agg(*[F.struct(F.count(F.lit(1)).alias("compared"), F.count_if(~F.coalesce(F.col(c), F.lit(0)).eqNullSafe(F.coalesce(f"_{c}", F.lit(0)))).alias("different")).alias(c) for c in counts])
    return one.unpivot([], counts, "count", "_s").select("count", "_s.compared", "_s.different")


def positional_join(left: DataFrame, right: DataFrame, order: list[str], check: str) -> DataFrame:
    """Rows of both sides by their place in an explicit order within the first key, with `matches`: whether `check` agrees.

    The first column of `order` is the key that places are counted in; the others order the rows of a key.
    """
    w = Window.partitionBy(order[0]).orderBy(*order[1:])
    b = right.withColumn("_at", F.row_number().over(w)).select(F.col(order[0]).alias("_k"), F.col("_at").alias("_r"), *[F.col(c).alias(f"right_{c}") for c in right.columns if c != order[0]])
    a = left.withColumn("_at", F.row_number().over(w))
    held = a.join(b, (F.col(order[0]) == F.col("_k")) & (F.col("_at") == F.col("_r")), "left")
    return held.withColumn("matches", F.coalesce(F.col(check) == F.col(f"right_{check}"), F.lit(False))).drop("_k", "_r", "_at")


def _figures(seen: Observation) -> dict:
    """What was observed; nothing, where one side of a join was empty and Spark has taken the other out of the plan."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def join_chain(skeleton: DataFrame, steps: list[tuple[str, DataFrame, list[str]]]) -> tuple[DataFrame, DataFrame]:
    """The skeleton with every (name, table, keys) joined on the left, and an audit with a row for each step.

    A table whose keys repeat is refused: ValueError, before anything that follows is made. So the skeleton's rows stay.
    Clashing columns get the step's name behind them. A step is written once, and its figures are taken on the way: rows
    before and after, columns before, after and added, rows of the table, its repeated keys, skeleton rows without a match,
    and nulls in the added columns. The table's rows are gathered by key for the join, which tells repeated keys without
    another shuffle. A null key is a key for that purpose, and matches nothing. Tables are not read, and so not checked, for
    an empty skeleton.
    """
    out, audit, rows = skeleton, [], None
    for name, table, keys in steps:
        clash = [c for c in table.columns if c in out.columns and c not in keys]
        table = table.withColumnsRenamed({c: f"{c}_{name}" for c in clash})
        added = [c for c in table.columns if c not in keys]
        own, met = Observation(f"{name} table"), Observation(f"{name} rows")
        by_key = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in added])
        by_key = by_key.observe(own, F.sum("_n").alias("rows"), F.count_if(F.col("_n") > 1).alias("repeated"))
        joined = out.join(by_key, keys, "left")
        joined = joined.observe(met, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_n").isNull()).alias("unmatched"), *[F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(added)])
        written = scratch.materialize(joined, f"join-{name}")
        after = met.get
        found = _figures(own)
        if found.get("repeated"):
            scratch.remove(skeleton.sparkSession, written)
            raise ValueError(f"{name}: {found['repeated']} keys of {', '.join(keys)} repeat")
        rows = after["rows"] if rows is None else rows
        audit.append((name, rows, after["rows"], len(out.columns), len(out.columns) + len(added), len(added), found.get("rows", 0 if after["rows"] else None), found.get("repeated", 0), after["unmatched"], sum(after[f"null_{i}"] for i in range(len(added)))))
        rows, out = after["rows"], written.drop("_n")
    names = "step string, rows_before bigint, rows_after bigint, columns_before int, columns_after int, columns_added int, right_rows bigint, duplicate_keys bigint, rows_unmatched bigint, new_missing bigint"
    return out, skeleton.sparkSession.createDataFrame(audit, names)


#: Parts of a split that must share no row, as (left, right, label); es is the part that stops training early.
DISJOINT = [
    ("train", "test", "train_test_overlap"), ("dev", "test", "validation_test_overlap"), ("cal", "test", "calibration_test_overlap"),
    ("train", "dev", "train_validation_overlap"), ("train", "cal", "train_calibration_overlap"), ("dev", "cal", "validation_calibration_overlap"),
    ("es", "dev", "earlystop_validation_overlap"), ("es", "cal", "earlystop_calibration_overlap"), ("es", "test", "earlystop_test_overlap"),
]


def disjoint_parts(rows: DataFrame, key: str, part: str, pairs: list[tuple[str, str, str]] = DISJOINT) -> DataFrame:
    """(label, left_part, right_part, left_rows, right_rows, shared, verdict) for pairs of parts of rows (key, part).

    Each key gets a mask with a bit for every part that it is in, and keys are counted by mask: one shuffle by key, and then
    one row for each mask that occurs. A row may name several parts in turn; unknown parts are ignored.
    """
    names = list(dict.fromkeys(n for pair in pairs for n in pair[:2]))
    bit = F.coalesce(*[F.when(F.col(part) == n, F.lit(1 << i)) for i, n in enumerate(names)], F.lit(0))
    masks = rows.groupBy(key).agg(F.bit_or(bit).alias("_m")).groupBy("_m").agg(F.count(F.lit(1)).alias("_c"))
    held = lambda *parts: F.coalesce(F.sum(F.when(F.col("_m").bitwiseAND(w := sum(1 << names.index(n) for n in parts)) == w, F.col("_c"))), F.lit(0))
    one = masks.agg(F.array(*[F.struct(F.lit(label).alias("label"), F.lit(a).alias("left_part"), F.lit(b).alias("right_part"), held(a).alias("left_rows"), held(b).alias("right_rows"), held(a, b).alias("shared")) for a, b, label in pairs]).alias("_p"))
    return one.select(F.explode("_p").alias("_p")).select("_p.*").withColumn("verdict", F.when(F.col("shared") == 0, "PASS").otherwise("FAIL"))
