"""Connected components of an edge table: forests within partitions, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomspan import scratch

#: Edges that one task joins by itself (16 bytes each); of more, every such run becomes a forest before the stars.
RUN = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (a, b), but for the smallest of its component, and that smallest node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[hung], nodes[root[hung]]


def _forests(edges: DataFrame, run: int, roots: bool = False) -> DataFrame:
    """Edges (u, v) with the same components: those of every run of rows of a partition become its forest.

    With `roots`, the smallest node of each tree hangs on itself.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            u, v = forest(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))
            if roots:
                root = np.unique(v)
                u, v = np.concatenate([u, root]), np.concatenate([v, root])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in (0, 1)])
            n += batch.num_rows
            if n >= run:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return edges.mapInArrow(work, "u bigint, v bigint")


def components(edges: DataFrame, run: int = RUN) -> DataFrame:
    """(node, component) for edges (a, b) of bigints: component is the smallest node that can be reached.

    Every partition first turns its edges into a forest, which has at most one edge a node. If the forests hold `run`
    edges at most, one task joins them. Otherwise rounds of stars hang neighbours on the smallest node they know of;
    the number of rounds grows with the logarithm of the longest path. Each round is written to the shared folder. Both
    ways give the same rows. Nodes without an edge to another node don't appear.
    """
    now, mark = _write(_forests(edges.where("a <> b").select("a", "b"), run))
    now = _forests(now.coalesce(1), run + 1, roots=True) if mark[0] <= run else _with_roots(_stars(now))
    return scratch.materialize(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "components")


def _with_roots(hung: DataFrame) -> DataFrame:
    """The edges (u, v), and one from each v to itself."""
    return hung.union(hung.select(F.col("v").alias("u"), "v").distinct())


def _stars(now: DataFrame) -> DataFrame:
    """Edges (u, v) from each node to the smallest one of its component."""
    spark = now.sparkSession
    first = now
    now, mark = _write(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    scratch.remove(spark, first)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join below can split a node of very many neighbours
        least = scratch.materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star-roots")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after, new = _write(small.where("u <> v").distinct())
        scratch.remove(spark, now, least)
        now = after
        if new == mark:
            break
        mark = new
    return now.groupBy("u").agg(F.min("v").alias("v"))


def _write(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and a mark that changes with them, taken on the way."""
    seen = Observation()
    table = scratch.materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("s")), "edges")
    return table, (seen.get["n"], seen.get["s"])
