"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target T and size S wants T / S copies: a whole part and a fraction. Fractions of one source
are made integral pairwise, a document against the pool of those behind it: a random transfer that conserves the pair's
expected words moves mass from one to the other until one of them is integral. Each group of documents leaves one fractional document at most; these residuals
meet in the next level of a reduction tree until one is left per source, which is rounded by itself. Every document's
expected copies stay as they were, while a source's words miss its target by less than one small document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan import scratch
from loomspan.llm import bloom
from loomspan.llm.columns import hide, show
from loomspan.llm.quality import words

#: Documents in a group of the tree's first level, and groups that meet in one above it.
GROUP, FAN_IN = 4_000, 64
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) for rows (source, size).

    Sources in order of code points, null last, get the weights in turn, again and again, and share the sum of all
    sizes. A target stops at cap times its source's size; the excess is shared by weight among the others until none is
    above. That is the one level L with sum(min(cap * size, L * weight)) = total, found in a few sums over sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    # ranks over the distinct sources alone
    per = per.withColumn("_r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_r") % len(weights) + 1).cast("int"))
    per = scratch.materialize(per.select("source", "source_size", weight.alias("weight")), "mix-sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    limit, level, capped_before = F.lit(cap) * F.col("source_size"), 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") >= limit
        capped, held, free = per.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if capped == capped_before or not free:
            break
        capped_before, level = capped, (total - held) / free
    return per.select("source", "source_size", F.least(limit, F.lit(level) * F.col("weight")).alias("target"))


def _transfer(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> int:
    """Round the fractions p in place, in order; the place of the one left fractional, or -1.

    Each document is paired with the pool of the fractional ones behind it. Either it takes words from the pool or the
    pool takes words from it, each as far as one side's first member becomes integral, with the odds that leave all
    expectations unchanged. Both moves follow one direction, p * (1 - p); a pool of equal fractions stays equal.
    """
    at = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    first, words = p[at], size[at]
    p[:] = np.round(p)
    equal = bool(len(first)) and np.ptp(first) < EPS
    behind = np.append(np.cumsum(words[::-1])[::-1][1:], 0.0)
    pool, left = (float(first[0]), -1) if equal else (first.copy(), -1)
    for k in range(len(at)):
        mine = pool if equal else float(pool[k])
        while EPS < mine < 1 - EPS:
            rest = pool if equal else pool[k + 1 :]
            direction = rest * (1 - rest)
            per = direction * behind[k] if equal else float((direction * words[k + 1 :]).sum())  # words a unit step moves
            moving = np.atleast_1d(rest)[np.atleast_1d(direction) > EPS / 2] if behind[k] else np.zeros(0)
            if not len(moving):
                break
            up = min((1 - mine) * words[k] / per, float((1 / (1 - moving)).min()))
            down = min(mine * words[k] / per, float((1 / moving).min()))
            step = up if rng.random() * (up + down) < down else -down
            mine += step * per / words[k]
            rest = np.clip(rest - step * direction, 0.0, 1.0)
            if equal:
                pool = float(rest)
            else:
                rest[(rest < EPS) | (rest > 1 - EPS)] = np.round(rest[(rest < EPS) | (rest > 1 - EPS)])
                pool[k + 1 :] = rest
            if equal and not EPS < pool < 1 - EPS:
                pool = float(round(pool))
        if EPS < mine < 1 - EPS:  # all behind it are integral now
            left = int(at[k])
            p[left] = mine
        else:
            p[at[k]] = round(mine)
    return left


def _round_group(group: pa.Table, seed: int, last: bool) -> pa.Table:
    """Rounds one group; the row left fractional keeps its fraction and goes on.

    Larger documents come first, so that the one left fractional at the end is small.
    """
    group = group.sort_by([("size", "descending"), ("doc_id", "ascending"), ("row", "ascending")])
    p, size = group["fraction"].to_numpy().copy(), group["size"].to_numpy().astype(float)
    key = group["slot"][0].as_py() * 1_000_003 + group["source_key"][0].as_py() % (1 << 40)
    rng = np.random.default_rng([seed, key % (1 << 63)])
    left = _transfer(p, size, rng)
    if left >= 0 and last:
        p[left] = float(rng.random() < p[left])
        left = -1
    group = group.set_column(group.schema.get_field_index("fraction"), "fraction", pa.array(p))
    return group.set_column(group.schema.get_field_index("open"), "open", pa.array(np.arange(len(p)) == left))


def _rounder(seed: int, last: bool):
    def one(group: pa.Table) -> pa.Table:
        return _round_group(group, seed, last)

    return one


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, row) per row of docs.

    size defaults to the number of words. Null texts and texts without a word have size 0 and are taken 0 times. Null
    doc_ids and repeated rows take part like any other; `row` tells repeated (doc_id, source, size) apart. Draws depend
    on the seed, the source and the group alone, so reruns agree whatever the partitioning. An empty table gives an empty result.
    """
    size = F.size(words(F.coalesce(F.col("text"), F.lit("")))) if size is None else size
    sized = scratch.materialize(docs.select("doc_id", "source", size.cast("bigint").alias("size")), "mix-sizes")
    targets = source_targets(sized, weights, cap)
    n = sized.count()
    groups = max(1, -(-n // GROUP))

    # rows alike in all three columns are interchangeable: they are counted, and numbered within their count
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    rows = alike.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("row"))
    rows = rows.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("want", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rows = rows.withColumn("want", F.when(F.abs(F.col("want") - F.round("want")) < EPS, F.round("want")).otherwise(F.col("want")))
    rows = rows.withColumn("whole", F.floor("want")).withColumn("fraction", F.when(F.col("size") > 0, F.col("want") - F.col("whole")).otherwise(0.0))
    rows = rows.withColumn("source_key", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("doc_id", "size", "row"), F.lit(groups)))
    kept = ["doc_id", "source", "size", "row", "source_size", "target", "whole", "fraction", "source_key", "slot"]
    rows = rows.select(*kept, F.lit(True).alias("open"))
    schema = rows.schema

    settled: list[DataFrame] = []
    while True:
        last = groups == 1
        done = scratch.materialize(rows.groupBy("source_key", "slot").applyInArrow(_rounder(seed, last), schema), "mix-level")
        settled.append(done.where(~F.col("open")))
        if last:
            break
        groups = -(-groups // FAN_IN)
        rows = done.where("open").withColumn("slot", F.pmod("slot", F.lit(groups)))
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    copies = (F.col("whole") + F.col("fraction")).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row")


def apply(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs, each as often as the mix takes it; repeated rows get their copies in the order of their texts' hashes."""
    docs, names = hide(docs, "doc_id", "text", "source")
    size = F.size(words(F.coalesce(F.col("text"), F.lit("")))).cast("bigint")
    plan = mix(docs, **options).groupBy("doc_id", "source", "size").agg(F.array_sort(F.collect_list(F.struct("row", "copies"))).alias("_plan"))
    plan = scratch.materialize(plan.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("_plan.copies").alias("_plan")), "mix-plan")

    def taken(some: DataFrame) -> DataFrame:
        on = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("_size"))
        return docs.withColumn("_n", size).join(some, on)

    both = taken(plan.where((F.size("_plan") == 1) & (F.col("_plan")[0] > 0))).withColumn("_copies", F.col("_plan")[0])
    repeated = plan.where(F.size("_plan") > 1)
    if not repeated.isEmpty():  # only their rows meet in a window
        key = bloom.of_column(repeated.select(F.xxhash64("_id", "_source", "_size")))
        docs = bloom.keep(docs.withColumn("_h", F.xxhash64("doc_id", "source", size)), "_h", key).drop("_h")
        order = Window.partitionBy("doc_id", "source", "_n").orderBy(F.xxhash64("text"))
        several = taken(repeated).withColumn("_k", F.row_number().over(order))
        both = both.unionByName(several.withColumn("_copies", F.element_at("_plan", F.col("_k"))).where("_copies > 0").drop("_k"))
    both = both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return show(both, names, "doc_id", "text", "source")
