"""Near-duplicate vectors by an epsilon grid order join.

Two unit vectors have cosine c exactly if their distance is sqrt(2 - 2c), and a projection never lengthens a distance. So
unit vectors are projected on their leading principal dimensions, sorted by the grid cells (of width epsilon) of these,
dimension after dimension, and cut into blocks. Intervals of the sequence are joined recursively: a pair of intervals
whose bounding boxes are further apart than epsilon is skipped, any other is taken apart into its halves' (here: parts')
pairs. The upper levels of the recursion are joins of interval tables, the lowest ones run inside a task on two blocks.
Cosines of what is left are computed on the stored vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.llm import graph

#: Principal dimensions of the grid, vectors of a block, vectors of an interval that is compared in full, parts of an interval a level (2 ** BITS).
DIMENSIONS, BLOCK, LEAF, BITS = 8, 1024, 128, 3
#: Distances are widened by this, far above what rounding can do to a projection of a unit vector.
SLACK = 1e-6


def usable(vector: Column) -> Column:
    """Whether a vector is complete, finite and not zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _measured(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by a power of two each (which changes no cosine) so that no product overflows or vanishes, and their lengths."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    return v, np.sqrt((v * v).sum(axis=1))


def principal(nodes: DataFrame, dimensions: int) -> tuple[int, np.ndarray]:
    """The most frequent length of v, and the leading principal directions of unit vectors around their label's mean, as rows."""
    size = nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if size is None:
        return 0, np.zeros((1, 0))
    unit = nodes.where(F.col("dim") == size["dim"]).select("label", array_to_vector("v").alias("v"))
    unit = Normalizer(inputCol="v", outputCol="u").transform(unit).select("label", "u")
    means = scratch.materialize(unit.groupBy("label").agg(vector_to_array(Summarizer.mean(F.col("u"))).alias("m")), "label-means")
    centred = unit.join(means, "label").select(array_to_vector(F.zip_with(vector_to_array("u"), "m", lambda x, m: x - m)).alias("x"))
    if size["count"] < 2:
        return size["dim"], np.eye(size["dim"])[:dimensions]
    fitted = PCA(k=min(dimensions, size["dim"]), inputCol="x", outputCol="p").fit(centred)
    basis = np.linalg.qr(fitted.pc.toArray())[0].T  # orthonormal to the last bit or two, whatever the fit did
    return size["dim"], basis if np.isfinite(basis).all() else np.eye(size["dim"])[:dimensions]


def _projected(nodes: DataFrame, dim: int, basis: np.ndarray, eps: float) -> DataFrame:
    """nodes with p, their place on the principal dimensions, and c, its grid cells."""
    width = len(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, size = batch.column(batch.schema.get_field_index("v")), batch.column(batch.schema.get_field_index("dim")).to_numpy()
            p, like = np.zeros((batch.num_rows, width)), size == dim
            if like.any():
                x, length = _measured(v.filter(pa.array(like)).flatten().to_numpy().reshape(-1, dim))
                p[like] = (x @ basis.T) / length[:, None]
            for i in np.flatnonzero(~like):  # other lengths: their first components, a projection like any other
                x, length = _measured(np.array([v[int(i)].as_py()]))
                p[i, : x.shape[1]] = x[0, :width] / length
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], [*batch.schema.names, "p"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    placed = nodes.mapInArrow(run, f"{kinds}, p array<double>")
    return placed.withColumn("c", F.transform("p", lambda x: F.floor(x / eps)))


def _blocks(placed: DataFrame, block: int, kind: str) -> DataFrame:
    """The sequence in grid order, cut into blocks: one row for each, with its bounding box and its vectors as bytes.

    n numbers the blocks in the order of the sequence; a block holds one label and one length.
    """
    order = ["label", "dim", "c", "h1", "h2"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    node = "struct<h1:bigint,h2:bigint,first:bigint,weight:bigint>"
    schema = f"part int, seq bigint, label binary, dim int, lo array<double>, hi array<double>, nodes array<{node}>, v binary, p binary"
    names = ["part", "seq", "label", "dim", "lo", "hi", "nodes", "v", "p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, key, held = TaskContext.get().partitionId(), 0, None, []
        entry = pa.list_(pa.struct([(c, pa.int64()) for c in ("h1", "h2", "first", "weight")]))
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), entry, pa.binary(), pa.binary()]

        def out() -> pa.RecordBatch:
            p = np.array([h[2] for h in held])
            row = [part, seq, *key, p.min(axis=0).tolist(), p.max(axis=0).tolist(), [h[0] for h in held], np.array([h[1] for h in held], kind).tobytes(), p.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for label, dim, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((label, dim) != key or len(held) == block):
                    yield out()
                    seq, held = seq + 1, []
                key = (label, dim)
                held.append(rest)
        if held:
            yield out()

    slim = ordered.select("label", "dim", F.struct("h1", "h2", "first", "weight"), "v", "p")
    blocks = scratch.materialize(slim.mapInArrow(run, schema), "blocks")
    most = blocks.agg(F.max("seq")).first()[0] or 0
    return blocks.withColumn("n", F.col("part").cast("bigint") * F.lit(1 << int(most).bit_length()) + F.col("seq"))


def _near(a: str, b: str, eps: float) -> Column:
    """Whether boxes a and b may hold points as near as eps."""
    gaps = F.arrays_zip(F.col(f"{a}lo").alias("al"), F.col(f"{a}hi").alias("ah"), F.col(f"{b}lo").alias("bl"), F.col(f"{b}hi").alias("bh"))
    square = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + F.pow(F.greatest(F.lit(0.0), g["al"] - g["bh"], g["bl"] - g["ah"]), 2))
    return square <= eps * eps


def block_pairs(blocks: DataFrame, eps: float, width: int, bits: int = BITS) -> DataFrame:
    """(x, y) with x <= y: numbers of the blocks that may hold vectors within eps of each other; column n is a block's number.

    From the top level, where each label is one interval, pairs of intervals that may be near are replaced by the pairs of
    their parts. An interval has at most 2 ** bits parts, so no step makes more than 4 ** bits rows of one.
    """
    boxes = blocks.select("n", "label", "dim", "lo", "hi")
    top = boxes.agg(F.max("n").alias("n")).first()["n"]
    if top is None:
        return boxes.select(F.col("n").alias("x"), F.col("n").alias("y"))
    heights = range(0, (int(top).bit_length() + bits - 1) // bits * bits + 1, bits)

    pairs = None
    for height in reversed(heights):
        now = boxes.withColumn("k", F.shiftright("n", height)).groupBy("label", "dim", "k").agg(*_box(width))
        if pairs is None:
            pairs = now.select("label", "dim", F.col("k").alias("x"), F.col("k").alias("y"))
        else:
            up = now.withColumn("up", F.shiftright("k", bits)).select("label", "dim", "up", "k", "lo", "hi")
            a = up.toDF("label", "dim", "x", "xk", "xlo", "xhi")
            b = up.toDF("label", "dim", "y", "yk", "ylo", "yhi")
            pairs = pairs.join(a, ["label", "dim", "x"]).join(b, ["label", "dim", "y"]).where("xk <= yk").where(_near("x", "y", eps))
            pairs = pairs.select("label", "dim", F.col("xk").alias("x"), F.col("yk").alias("y"))
        pairs = scratch.materialize(pairs, "interval-pairs")
    return pairs.select("x", "y")


def _box(width: int) -> list[Column]:
    """The box around boxes."""
    return [F.array(*[F.min(F.get("lo", F.lit(i))) for i in range(width)]).alias("lo"), F.array(*[F.max(F.get("hi", F.lit(i))) for i in range(width)]).alias("hi")]


def _leaves(a: tuple[int, int], b: tuple[int, int], pa_: np.ndarray, pb: np.ndarray, eps: float, leaf: int) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of intervals, within blocks a and b, that are compared in full."""
    todo = [(*a, *b)]
    while todo:
        i, j, k, m = todo.pop()
        x, y = pa_[i:j], pb[k:m]
        gap = np.maximum(np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)), 0)
        if (gap * gap).sum() > eps * eps:
            continue
        if j - i <= leaf and m - k <= leaf:
            yield i, j, k, m
        elif j - i >= m - k:
            h = (i + j) // 2
            todo += [(i, h, k, m), (h, j, k, m)]
        else:
            h = (k + m) // 2
            todo += [(i, j, k, h), (i, j, h, m)]


def joined(blocks: DataFrame, pairs: DataFrame, cosine: float, eps: float, block: int, leaf: int, kind: str) -> DataFrame:
    """For pairs of blocks: rows (a, null, w) for vectors with w others linked, and rows (a, b, null) that join what is linked.

    a and b number vectors: block number times block size plus place. Of a pair of blocks, a forest of its links is
    written, which has the components of them all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, dim, xw, yw, xv, yv, xp, yp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                xw, yw = np.array(xw), np.array(yw)
                (xv, xn), (yv, yn) = (_measured(np.frombuffer(v, kind).reshape(-1, dim).astype(float)) for v in (xv, yv))
                xp, yp = np.frombuffer(xp).reshape(len(xw), -1), np.frombuffer(yp).reshape(len(yw), -1)
                sums_x, sums_y, edges = np.zeros(len(xw), np.int64), np.zeros(len(yw), np.int64), []
                for i, j, k, m in _leaves((0, len(xw)), (0, len(yw)), xp, yp, eps, leaf):
                    if x == y and m <= i:
                        continue  # the mirror image of another pair
                    hit = (xv[i:j] @ yv[k:m].T) / (xn[i:j, None] * yn[None, k:m]) >= cosine
                    if x == y:
                        hit &= np.arange(i, j)[:, None] < np.arange(k, m)[None, :]
                    if not hit.any():
                        continue
                    sums_x[i:j] += hit @ yw[k:m]
                    sums_y[k:m] += hit.T @ xw[i:j]
                    r, c = np.nonzero(hit)
                    edges.append(graph.forest(x * block + i + r, y * block + k + c))
                if not edges:
                    continue
                u, v = graph.forest(*(np.concatenate([e[k] for e in edges]) for k in (0, 1)))
                linked = [(x * block + np.flatnonzero(s), s[s > 0]) for x, s in ((x, sums_x), (y, sums_y))]
                a = np.concatenate([u, *(n for n, _ in linked)])
                b = pa.array(np.concatenate([v, np.zeros(len(a) - len(u), np.int64)]), mask=np.arange(len(a)) >= len(u))
                w = pa.array(np.concatenate([np.zeros(len(u), np.int64), *(s for _, s in linked)]), mask=np.arange(len(a)) < len(u))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, w], ["a", "b", "w"])

    held = blocks.select("n", "dim", F.col("nodes.weight").alias("weight"), "v", "p")
    x, y = held.toDF("x", "dim", "xw", "xv", "xp"), held.drop("dim").toDF("y", "yw", "yv", "yp")
    both = pairs.join(x, "x").join(y, "y").select("x", "y", "dim", "xw", "yw", "xv", "yv", "xp", "yp")
    return scratch.materialize(both.mapInArrow(run, "a bigint, b bigint, w bigint"), "links")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, dimensions: int = DIMENSIONS, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label).

    Rows link if their labels are equal and not null and the cosine of their stored vectors, in double precision, is at
    least `cosine` (above 0). n_links counts the other rows linked directly; component_id is the smallest vec_id that links
    reach, itself included; kept says whether it is the row's own. Vectors that are null, empty, zero, or hold a null or
    non-finite component link with nothing, nor do vectors of different lengths. A vec_id that repeats is a row for each of
    its vectors, each counted; a row without vec_id links with nothing and has a null component_id and kept false. Equal
    vectors of a label are one node of the join, so a group of copies costs what one vector costs. Extra columns are
    ignored; an empty table gives an empty result.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"  # exact for the stored vectors
    held = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").cast("binary").alias("label"))
    joins = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))
    v = F.transform("v", lambda x: x + F.lit(0.0))  # zeros are made plain, so that equal vectors hash alike
    held = held.select("vec_id", "label", F.when(joins, v).alias("v"))
    held = held.select("*", *[F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(i), "label", "v")).alias(h) for i, h in enumerate(("h1", "h2"))])
    held = scratch.materialize(held, "vectors")

    nodes = held.where("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = scratch.materialize(nodes.withColumn("dim", F.size("v")), "vector-nodes")
    dim, basis = principal(nodes, dimensions)
    blocks = _blocks(_projected(nodes, dim, basis, eps), block, kind)
    found = joined(blocks, block_pairs(blocks, eps, len(basis)), cosine, eps, block, leaf, kind)

    places = blocks.select("n", F.posexplode("nodes").alias("place", "node")).select((F.col("n") * block + F.col("place")).alias("a"), "node.*")
    trees = graph.components(found.where("b is not null").select("a", "b")).toDF("a", "tree")
    links = found.where("w is not null").groupBy("a").agg(F.sum("w").alias("w"))
    results = scratch.materialize(places.join(trees, "a", "left").join(links, "a", "left"), "node-results")
    roots = scratch.materialize(results.where("tree is not null").groupBy("tree").agg(F.min("first").alias("root")), "component-roots")
    results = results.join(roots, "tree", "left").select("h1", "h2", (F.coalesce("w", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "first").alias("root"))
    results = scratch.materialize(results, "node-classes")
    # both sides are written tables, so the rows of a vector with very many copies can be dealt to several tasks
    out = held.select("vec_id", "h1", "h2").join(results, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: DuckDB SQL of near_vectors with cosine 0.98 over a view named embeddings.
SQL = """
    WITH RECURSIVE
    v AS (SELECT row_number() OVER () AS r, vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
    u AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
    l AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r
          AND CASE WHEN len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98 ELSE false END),
    c(r, found) AS (SELECT r, vec_id FROM v UNION SELECT l.b, c.found FROM c JOIN l ON l.a = c.r),
    m AS (SELECT r, min(found) AS component_id FROM c GROUP BY r),
    n AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY a)
    SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(v.vec_id = component_id, false) AS kept
    FROM v JOIN m USING (r) LEFT JOIN n USING (r)"""
