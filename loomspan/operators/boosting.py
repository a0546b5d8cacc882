"""Gradient boosting of quantiles: histogram trees under the pinball loss, all quantile levels in the same passes.

Features are binned once. A level of a tree costs one aggregate: rows and rows below their prediction, counted by (quantile
level, node, feature, bin), which is all that a pinball gradient sums up to. Leaves are set to the quantile of their rows'
residuals. Only counts and leaves come to the driver; their number depends on depth, features and bins, not on rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan import scratch

#: Trees after which predictions are written down, so that a pass applies no more than these.
HELD = 8
#: Rank error of the quantiles of features and residuals, as one over this share of the rows; below as many rows they are exact.
ACCURACY = 10_000


@dataclass
class Tree:
    """A full binary tree in heap order. A node without a feature (-1) sends every row left."""

    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """Node that each row reaches after `depth` steps, numbered from 0 within its level."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[node]
            right = (f >= 0) & (bins[rows, np.maximum(f, 0)] > self.bin[node])
            node = 2 * node + 1 + right
        return node - (2**depth - 1)


@dataclass
class QuantileTrees:
    """A fitted model: for each quantile level a start and a tree a round."""

    features: list[str]
    levels: list[float]
    depth: int
    edges: list[list[float]]
    start: list[float]
    rounds: list[list[Tree]] = field(default_factory=list)

    def bin(self, columns: list[np.ndarray]) -> np.ndarray:
        """Bins of rows: 0 for a missing value, else one more than the edges below it."""
        return np.stack([np.where(np.isnan(x), 0, 1 + np.searchsorted(np.array(e), x, "left")) for x, e in zip(columns, self.edges, strict=True)], axis=1)

    def add(self, f: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
        """Predictions f (rows, levels) moved by some rounds."""
        f = f.copy()
        for trees in rounds:
            for t, tree in enumerate(trees):
                f[:, t] += tree.leaf[tree.leaves(bins, self.depth)]
        return f

    def transform(self, df: DataFrame, names: list[str]) -> DataFrame:
        """df with a column of predictions for each level."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = self.bin([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(self.features))])
                f = self.add(np.tile(np.array(self.start), (len(bins), 1)), bins, self.rounds)
                own = [batch.column(i) for i in range(len(self.features), batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(f[:, t], pa.float64()) for t in range(len(names))]], [*batch.schema.names[len(self.features) :], *names])

        kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields)
        inputs = [F.col(c).cast("double").alias(f"_in_{i}") for i, c in enumerate(self.features)]
        return df.select(*inputs, *df.columns).mapInArrow(run, f"{kinds}, " + ", ".join(f"`{n}` double" for n in names))


def best_split(n: np.ndarray, below: np.ndarray, level: float, least: int) -> tuple[int, int]:
    """(feature, bin) of the split of a node that gains most, or (-1, 0). n and below are counts by (feature, bin)."""
    total, under = n[0].sum(), below[0].sum()
    left, left_under = n.cumsum(axis=1), below.cumsum(axis=1)
    right, right_under = total - left, under - left_under
    ok = (left >= least) & (right >= least)
    gradient = lambda size, low: np.divide((level * size - low) ** 2, size, out=np.zeros(size.shape), where=size > 0)
    gain = np.where(ok, gradient(left, left_under) + gradient(right, right_under) - (level * total - under) ** 2 / max(total, 1), -np.inf)
    at = int(gain.argmax())
    return divmod(at, n.shape[1]) if gain.size and gain.flat[at] > 1e-9 else (-1, 0)


def _counts(held: DataFrame, model: QuantileTrees, recent: list[list[Tree]], trees: list[Tree], depth: int, width: int) -> np.ndarray:
    """Counts of rows, and of rows below their prediction, by (level, node of the trees' level `depth`, feature, bin)."""
    shape = (2, len(model.levels), 2**depth, len(model.features), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            y, bins, f = _rows(batch, model)
            f = model.add(f, bins, recent)
            for t, tree in enumerate(trees):
                node, low = tree.leaves(bins, depth), y < f[:, t]
                for j in range(bins.shape[1]):
                    at = node * width + bins[:, j]
                    for k, weights in enumerate((None, low)):
                        total[k, t, :, j] += np.bincount(at, weights, 2**depth * width).astype(np.int64).reshape(-1, width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

    out = np.zeros(shape, np.int64)
    # a row a cell of the histogram: at most 2 * levels * nodes * features * bins, whatever the table
    for r in held.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out.flat[r["at"]] = r["n"]
    return out


def _rows(batch: pa.RecordBatch, model: QuantileTrees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, bins, f = (batch.column(batch.schema.get_field_index(c)) for c in ("y", "bins", "f"))
    return y.to_numpy(), bins.flatten().to_numpy().reshape(-1, len(model.features)), f.flatten().to_numpy().reshape(-1, len(model.levels))


def _leaves(held: DataFrame, model: QuantileTrees, recent: list[list[Tree]], trees: list[Tree]) -> dict[tuple[int, int], float]:
    """The quantile, at its level, of the residuals in each (level, leaf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, bins, f = _rows(batch, model)
            f = model.add(f, bins, recent)
            for t, tree in enumerate(trees):
                leaf = tree.leaves(bins, model.depth)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), t, np.int32)), pa.array(leaf), pa.array(y - f[:, t])], ["t", "leaf", "r"])

    each = held.mapInArrow(run, "t int, leaf bigint, r double").groupBy("t", "leaf")
    found = each.agg(F.percentile_approx("r", F.array(*map(F.lit, model.levels)), F.lit(ACCURACY)).alias("q")).collect()  # a row a leaf
    return {(r["t"], r["leaf"]): float(r["q"][r["t"]]) for r in found}


def _written(held: DataFrame, model: QuantileTrees, recent: list[list[Tree]]) -> DataFrame:
    """held with its predictions moved by the recent rounds, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, bins, f = _rows(batch, model)
            f = model.add(f, bins, recent)
            ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * f.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("bins"), pa.ListArray.from_arrays(ends, pa.array(f.ravel()))], ["y", "bins", "f"])

    return scratch.materialize(held.mapInArrow(run, "y double, bins array<bigint>, f array<double>"), "boosting")


def fit_quantiles(df: DataFrame, features: list[str], y: str, levels: list[float], rounds: int = 50, depth: int = 3, rate: float = 0.1, bins: int = 32, least: int = 20) -> QuantileTrees | None:
    """A model of the quantiles of y at some levels; None without rows.

    Rows with a null or NaN y are left out. A missing feature is a bin of its own, below all others. Splits leave `least`
    rows at least on both sides; of equal gains the first feature and lowest bin win. rate scales each tree's leaves.
    """
    rows = df.select(F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]).where(F.col("y").isNotNull() & ~F.isnan("y"))
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    one = rows.agg(F.percentile_approx("y", F.array(*map(F.lit, levels)), F.lit(ACCURACY)).alias("q"), *[F.percentile_approx(number(f"x{i}"), cuts, F.lit(ACCURACY)).alias(f"e{i}") for i in range(len(features))]).first()
    if one["q"] is None:
        return None
    model = QuantileTrees(features, list(levels), depth, [sorted(set(one[f"e{i}"] or [])) for i in range(len(features))], list(one["q"]))
    width = 2 + max(map(len, model.edges), default=0)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.bin([batch.column(1 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))])
            ends = [pa.array(np.arange(len(found) + 1, dtype=np.int32) * k) for k in (len(features), len(levels))]
            f = np.tile(np.array(model.start), len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends[0], pa.array(found.ravel())), pa.ListArray.from_arrays(ends[1], pa.array(f))], ["y", "bins", "f"])

    held = scratch.materialize(rows.mapInArrow(binned, "y double, bins array<bigint>, f array<double>"), "boosting")
    recent: list[list[Tree]] = []
    for _ in range(rounds):
        trees = [Tree(np.full(2**depth - 1, -1), np.zeros(2**depth - 1, np.int64), np.zeros(2**depth)) for _ in levels]
        for d in range(depth):
            n, below = _counts(held, model, recent, trees, d, width)
            for t, level in enumerate(levels):
                for node in range(2**d):
                    trees[t].feature[2**d - 1 + node], trees[t].bin[2**d - 1 + node] = best_split(n[t, node], below[t, node], level, least)
        for (t, leaf), q in _leaves(held, model, recent, trees).items():
            trees[t].leaf[leaf] = rate * q
        model.rounds.append(trees)
        recent.append(trees)
        if len(recent) == HELD:
            before, held = held, _written(held, model, recent)
            scratch.remove(held.sparkSession, before)
            recent = []
    scratch.remove(held.sparkSession, held)
    return model


def quantile_intervals(df: DataFrame, features: list[str], y: str, fit: Column, alpha: float = 0.1, **options) -> DataFrame:
    """df with lo, pred and hi: quantiles of y at alpha / 2, 1/2 and 1 - alpha / 2, boosted on the rows with `fit`; null without such rows."""
    model = fit_quantiles(df.where(fit), features, y, [alpha / 2, 0.5, 1 - alpha / 2], **options)
    if model is None:
        return df.withColumns({c: F.lit(None).cast("double") for c in ("lo", "pred", "hi")})
    return model.transform(df, ["lo", "pred", "hi"])


def pinball(y: Column, q: Column, level: float) -> Column:
    """Loss of a quantile prediction."""
    return F.when(y >= q, level * (y - q)).otherwise((1 - level) * (q - y))
