"""Approximate nearest neighbours: one navigable small-world graph a shard, results of all shards merged.

Equal vectors are one node with its smallest ids. Nodes are dealt to shards by hash; a task builds a shard's graph as
flat neighbour arrays, one per level. Nearness is the inner product: nodes get one more component that makes all norms
equal, so the graph is built on distances and searched for the largest product. Nodes are inserted in growing batches and
queries searched in batches, so that a step of all searches is one numpy operation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan import scratch

#: Neighbours of a node on a level, kept candidates while building and searching, most nodes of a shard.
DEGREE, BUILD, SEARCH, SHARD = 16, 64, 96, 8192
#: Queries that a task holds at a time.
QUERIES = 1024


class SmallWorld:
    """A hierarchical navigable small-world graph over rows of float32 vectors of equal norm."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, build: int = BUILD, seed: int = 5):
        self.vectors, self.degree, self.build = vectors, degree, build
        n = len(vectors)
        levels = (-np.log(np.random.default_rng(seed).random(n).clip(1e-12)) / np.log(degree)).astype(int)
        order = np.argsort(-levels, kind="stable")  # nodes of the upper levels are inserted first
        self.vectors, self.order = vectors[order], order
        levels = levels[order]
        self.members = [int((levels >= k).sum()) for k in range(int(levels.max(initial=0)) + 1)]
        self.neighbours = [np.full((m, 2 * degree if k == 0 else degree), -1, np.int32) for k, m in enumerate(self.members)]
        for level in range(len(self.members) - 1, -1, -1):
            self._fill(level)

    def _fill(self, level: int) -> None:
        """Link all members of a level, batch by batch; every batch at most doubles the linked ones."""
        m, done = self.members[level], 1
        while done < m:
            end = min(m, done + max(1, min(done, 512)))
            batch = np.arange(done, end)
            entry = self._descend(self.vectors[batch], level, done)
            found, near = self._beam(self.vectors[batch], entry, level, self.build, done)
            inside = self.vectors[batch] @ self.vectors[batch].T  # new nodes may be each other's neighbours
            inside[np.arange(len(batch))[:, None] <= np.arange(len(batch))[None, :]] = -np.inf
            k = min(self.degree, len(batch))
            own = np.argpartition(-inside, k - 1, axis=1)[:, :k]
            found = np.concatenate([found, batch[own]], axis=1)
            near = np.concatenate([near, np.take_along_axis(inside, own, axis=1)], axis=1)
            self._link(level, batch, found, near)
            done = end

    def _link(self, level: int, batch: np.ndarray, found: np.ndarray, near: np.ndarray) -> None:
        """Give each new node diverse neighbours, and each of those the new node."""
        table = self.neighbours[level]
        chosen = self._diverse(found, near, self.degree)
        table[batch, : self.degree] = chosen
        back, to = np.repeat(batch, self.degree), chosen.ravel()
        back, to = back[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        back, to = back[order], to[order]
        at, first, times = np.unique(to, return_index=True, return_counts=True)
        more = np.full((len(at), int(times.max(initial=0))), -1, np.int32)
        more[np.repeat(np.arange(len(at)), times), np.arange(len(to)) - np.repeat(first, times)] = back
        both = np.concatenate([table[at], more], axis=1)
        product = np.einsum("nd,nkd->nk", self.vectors[at], self.vectors[both])
        product[both < 0] = -np.inf
        table[at] = self._diverse(both, product, table.shape[1])

    def _diverse(self, found: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
        """Up to k of each row, nearest first, passing over those nearer to one already chosen than to the node itself; places left are filled with the nearest passed over."""
        order = np.argsort(-near, axis=1, kind="stable")[:, : 3 * k]
        found, near = np.take_along_axis(found, order, axis=1), np.take_along_axis(near, order, axis=1)
        n, width = found.shape
        vectors = self.vectors[found]
        chosen = np.zeros((n, width), bool)
        closest = np.full((n, width), -np.inf, np.float32)
        for j in range(width):
            new = (near[:, j] > -np.inf) & (closest[:, j] < near[:, j]) & (chosen.sum(axis=1) < k)
            for i in range(j):
                new &= ~((found[:, i] == found[:, j]) & chosen[:, i])
            chosen[:, j] = new
            if new.any():
                rows = np.flatnonzero(new)
                product = np.einsum("nd,nkd->nk", vectors[rows, j], vectors[rows])
                closest[rows] = np.maximum(closest[rows], product)
        rank = np.where(chosen, 0, 1) + np.where(near > -np.inf, 0, 2)
        same = np.zeros((n, width), bool)
        for j in range(1, width):
            same[:, j] = (found[:, :j] == found[:, j : j + 1]).any(axis=1)
        rank[same] = 2
        best = np.argsort(rank, axis=1, kind="stable")[:, :k]
        out = np.where(np.take_along_axis(rank, best, axis=1) < 2, np.take_along_axis(found, best, axis=1), -1)
        return np.pad(out, ((0, 0), (0, k - out.shape[1])), constant_values=-1) if out.shape[1] < k else out

    def _descend(self, queries: np.ndarray, level: int, linked: int) -> np.ndarray:
        """The member nearest to each query by greedy steps from the top to just above a level."""
        at = np.zeros(len(queries), np.int64)
        for k in range(len(self.members) - 1, level, -1):
            at = self._beam(queries, at, k, 1, self.members[k])[0][:, 0]
        return np.minimum(at, linked - 1)

    def _beam(self, queries: np.ndarray, entry: np.ndarray, level: int, width: int, linked: int) -> tuple[np.ndarray, np.ndarray]:
        """The width best nodes found for each query, nearest first, by best-first search in step for all queries."""
        table, n = self.neighbours[level], len(queries)
        best = np.full((n, width), -1, np.int64)
        near = np.full((n, width), -np.inf, np.float32)
        open_ = np.zeros((n, width), bool)
        best[:, 0], open_[:, 0] = entry, True
        near[:, 0] = np.einsum("nd,nd->n", queries, self.vectors[entry])
        seen = np.zeros((n, linked), bool)
        seen[np.arange(n), entry] = True
        rows = np.arange(n)
        while len(rows):
            value = np.where(open_[rows], near[rows], -np.inf)
            pick = value.argmax(axis=1)
            go = value[np.arange(len(rows)), pick] > -np.inf
            rows, pick = rows[go], pick[go]
            if not len(rows):
                break
            open_[rows, pick] = False
            to = table[best[rows, pick]].astype(np.int64)
            ok = (to >= 0) & (to < linked)
            to[~ok] = 0
            ok &= ~seen[rows[:, None], to]
            seen[np.repeat(rows, ok.sum(axis=1)), to[ok]] = True
            product = np.full(to.shape, -np.inf, np.float32)
            r, c = np.nonzero(ok)
            product[r, c] = np.einsum("nd,nd->n", queries[rows[r]], self.vectors[to[r, c]])
            all_to = np.concatenate([best[rows], to], axis=1)
            all_near = np.concatenate([near[rows], product], axis=1)
            all_open = np.concatenate([open_[rows], ok], axis=1)
            top = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
            best[rows] = np.take_along_axis(all_to, top, axis=1)
            near[rows] = np.take_along_axis(all_near, top, axis=1)
            open_[rows] = np.take_along_axis(all_open, top, axis=1)
        return best, near

    def search(self, queries: np.ndarray, width: int = SEARCH) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers (as given to the constructor) and products of the best found; -1 and -inf where there are fewer."""
        width = min(width, len(self.vectors))
        best, near = self._beam(queries, self._descend(queries, 0, len(self.vectors)), 0, width, len(self.vectors))
        return np.where(near > -np.inf, self.order[best], -1), near


def _usable(vector: Column) -> Column:
    """Whether a vector is complete, finite and not zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _smallest(k: int):
    """In each batch: at most the k smallest ids of every vector of every group given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch
            order = np.lexsort((t.column("vec_id").to_numpy(), t.column("h1").to_numpy(), t.column("h2").to_numpy()))
            h1, h2 = t.column("h1").to_numpy()[order], t.column("h2").to_numpy()[order]
            new = np.ones(len(order), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            yield t.take(pa.array(order[np.arange(len(order)) - start < k]))

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, shard: int = SHARD, width: int = SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of (vec_id, embedding) with is_query, its k nearest other rows found.

    score is the inner product of the stored vectors in double precision; ties go to the smaller vec_id; where there are
    fewer than k candidates all are returned. Vectors that are null, zero, or hold a null or non-finite component take no
    part, and neither do rows without vec_id. Vectors of another length than most are only compared with their like: a
    shard holds one length. A vec_id that repeats is a row for each of its vectors; a
    query leaves out its own row, not others that bear its id. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    held = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q"))
    held = held.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(_usable(F.col("v")))
    # zeros are made plain, so that equal vectors hash alike
    held = held.withColumn("v", F.transform("v", lambda x: x + 0.0)).select("vec_id", "q", "v", F.xxhash64("v").alias("h1"), F.hash("v").cast("bigint").alias("h2"), F.size("v").alias("dim"))
    held = scratch.materialize(held, "vectors")

    # equal vectors: the k + 1 smallest ids of each, cut down batch by batch before they meet
    ids = held.select("h1", "h2", "vec_id").mapInArrow(_smallest(k + 1), "h1 bigint, h2 bigint, vec_id bigint")
    ids = ids.groupBy("h1", "h2").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    first = held.join(scratch.materialize(ids, "equal-vectors"), ["h1", "h2"]).where(F.col("vec_id") == F.col("ids")[0]).dropDuplicates(["h1", "h2"])
    nodes = first.select("ids", "v", "dim", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("norm2"), "h1")
    nodes = scratch.materialize(nodes, "nodes")
    sizes = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("most"))
    nodes = nodes.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("h1"), F.ceil(F.col("n") / shard)))
    queries = held.where("q").select(F.col("vec_id").alias("query_id"), F.monotonically_increasing_id().alias("row"), "v", "dim")
    queries = scratch.materialize(queries, "queries")  # rows that share an id are told apart, and keep their numbers
    # every query visits every shard of its length
    visits = queries.join(sizes.select("dim", F.ceil(F.col("n") / shard).alias("shards")), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)))
    schema = "query_id bigint, row bigint, vec_id bigint, score double"

    def one(key, left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(left))
        exact = _matrix(rows["v"])
        lift = np.sqrt(np.maximum(rows["most"][0].as_py() - (exact**2).sum(axis=1), 0))
        scale = np.sqrt(rows["most"][0].as_py())
        graph = SmallWorld((np.column_stack([exact, lift]) / scale).astype(np.float32))
        members = rows["ids"].to_pylist()
        for batch in right:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                q, asked = _matrix(pa.chunked_array([part.column(part.schema.get_field_index("v"))])), list(zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("query_id", "row")), strict=True))
                unit = q / np.linalg.norm(q, axis=1, keepdims=True)
                found, _ = graph.search(np.column_stack([unit, np.zeros(len(q))]).astype(np.float32), width)
                out = []
                for i, (query, row) in enumerate(asked):
                    near = found[i][found[i] >= 0]
                    score = exact[near] @ q[i]
                    left_over = 2 * k
                    for j in np.argsort(-score, kind="stable"):
                        own = members[near[j]]
                        if query in own and np.array_equal(exact[near[j]], q[i]):  # the query's own row, not others of its id
                            own = own.copy()
                            own.remove(query)
                        own = own[:k]
                        out += [(query, row, m, float(score[j])) for m in own]
                        left_over -= len(own)
                        if left_over <= 0:
                            break
                columns = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "row", "vec_id", "score"])

    def both(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.Table.from_batches(list(one(key, iter(left.to_batches()), iter(right.to_batches()))))

    grouped = nodes.select("dim", "shard", "ids", "v", "most").groupBy("dim", "shard").cogroup(visits.select("dim", "shard", "query_id", "row", "v").groupBy("dim", "shard"))
    found = grouped.applyInArrow(both, schema)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)
