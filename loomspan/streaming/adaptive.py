"""Adaptive conformal intervals on a stream: the level moves at the end of each step, with state for each series.

A series' state is its level, a bounded quantile sketch of its earlier scores (and of its last steps, where the method looks
back over a few), and a sketch of each step that is still open. An event-time timer closes a step once the watermark has
passed its end: its threshold is taken from the earlier scores, its coverage from its own sketch, and the level moves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Half the largest rank error of a sketch, as a share of its values.
EPS = 0.001
#: Earlier steps that a method may look back over.
BACK = 5


class Sketch:
    """A Greenwald-Khanna summary: ranks are off by 2 EPS times the number of values at most, and exact below 1 / EPS values.

    v are kept values in order, g counts the values from the one before (exclusive) to each, d is what may lie further back.
    """

    def __init__(self, v: np.ndarray | None = None, g: np.ndarray | None = None, d: np.ndarray | None = None, eps: float = EPS):
        self.v, self.g, self.d = (np.zeros(0, kind) if x is None else x for x, kind in ((v, float), (g, np.int64), (d, np.int64)))
        self.eps = eps

    @property
    def n(self) -> int:
        return int(self.g.sum())

    @staticmethod
    def of(values: np.ndarray, eps: float = EPS) -> Sketch:
        v, g = np.unique(values[~np.isnan(values)], return_counts=True)
        return Sketch(v, g.astype(np.int64), np.zeros(len(v), np.int64), eps).pressed()

    def _between(self, v: np.ndarray) -> np.ndarray:
        """How many of this sketch's values may lie below v though they are counted behind it."""
        at = np.searchsorted(self.v, v, "left")
        inside = (at > 0) & (at < len(self.v))
        at = np.minimum(at, max(len(self.v) - 1, 0))
        return np.where(inside & (self.v[at] != v), self.g[at] + self.d[at] - 1, 0) if len(self.v) else np.zeros(len(v), np.int64)

    def merged(self, other: Sketch) -> Sketch:
        v = np.concatenate([self.v, other.v])
        g, d = np.concatenate([self.g, other.g]), np.concatenate([self.d + other._between(self.v), other.d + self._between(other.v)])
        order = np.argsort(v, kind="stable")
        return Sketch(v[order], g[order], d[order], self.eps).pressed()

    def pressed(self) -> Sketch:
        """Neighbours joined as far as ranks allow it."""
        most = math.floor(2 * self.eps * self.n)
        if most < 2 or len(self.v) < 3:
            return self
        keep = [len(self.v) - 1]
        g = self.g.copy()
        for i in range(len(self.v) - 2, 0, -1):  # the least and the greatest value stay
            last = keep[-1]
            if self.g[i] + g[last] + self.d[last] <= most:
                g[last] += self.g[i]
            else:
                keep.append(i)
        keep.append(0)
        keep = np.array(keep[::-1])
        return Sketch(self.v[keep], g[keep], self.d[keep], self.eps)

    def at(self, rank: int) -> float:
        """A value whose rank, from 0, is that one within the error."""
        least = np.cumsum(self.g)
        off = np.maximum(rank + 1 - least, least + self.d - rank - 1)  # the farther of the two ranks that a value may have
        first = int(np.searchsorted(least, rank + 1, "left"))
        return float(self.v[first] if first < len(least) and off[first] <= self.eps * self.n else self.v[int(np.abs(off).argmin())])

    def quantile(self, level: float) -> float:
        h = (self.n - 1) * level
        low, high = self.at(math.floor(h)), self.at(min(math.floor(h) + 1, self.n - 1))
        return low * (1 - (h - math.floor(h))) + high * (h - math.floor(h))

    def up_to(self, q: float) -> int:
        """Values of at most q."""
        return int(self.g[: np.searchsorted(self.v, q, "right")].sum())

    def data(self) -> bytes:
        return b"".join(x.tobytes() for x in (np.array([len(self.v)]), self.v, self.g, self.d))

    @staticmethod
    def read(data: bytes, eps: float = EPS) -> Sketch:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        return Sketch(*(np.frombuffer(data, kind, n, 8 + 8 * n * i).copy() for i, kind in enumerate((float, np.int64, np.int64))), eps)


class AdaptiveSeries(StatefulProcessor):
    """State of a series. Rows have step, score, x (severity) and ends (milliseconds at which the step is over)."""

    def __init__(self, alpha: float, rate: Callable[[int], float], low: float, high: float, window: Callable[[float | None], int | None], eps: float = EPS):
        self.alpha, self.rate, self.low, self.high, self.window, self.eps = alpha, rate, low, high, window, eps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.level = handle.getValueState("level", "alpha double, steps int")
        self.pool = handle.getValueState("pool", "data binary")
        self.open = handle.getMapState("open", "step int", "data binary, n bigint, x double, cx bigint, ends bigint")
        self.closed = handle.getMapState("closed", "step int", "data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            for step, own in part.groupby("step"):
                found, ends = Sketch.of(own["score"].to_numpy(float), self.eps), int(own["ends"].iloc[0])
                n, x, cx = len(own), float(own["x"].sum()), int(own["x"].notna().sum())
                if self.open.containsKey((int(step),)):
                    data, n0, x0, cx0, ends = self.open.getValue((int(step),))
                    found, n, x, cx = Sketch.read(data, self.eps).merged(found), n + n0, x + x0, cx + cx0
                else:
                    self.handle.registerTimer(ends)
                self.open.updateValue((int(step),), (found.data(), n, x, cx, ends))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        over = sorted(s[0] for s in self.open.keys() if self.open.getValue((s[0],))[4] <= now)
        out = []
        for step in over:
            data, n, x, cx, _ = self.open.getValue((step,))
            own, mean = Sketch.read(data, self.eps), x / cx if cx else None
            alpha, steps = self.level.get() if self.level.exists() else (self.alpha, 0)
            back = self.window(mean)
            if back is None:
                earlier = Sketch.read(self.pool.get()[0], self.eps) if self.pool.exists() else Sketch(eps=self.eps)
            else:
                earlier = Sketch(eps=self.eps)
                for s in sorted(s[0] for s in self.closed.keys())[-back:]:
                    earlier = earlier.merged(Sketch.read(self.closed.getValue((s,))[0], self.eps))
            m = earlier.n
            q = earlier.quantile(min(math.ceil((1 - alpha) * (m + 1)) / m, 1.0)) if m else 0.0
            coverage = own.up_to(q) / own.n if own.n else None
            out.append((key[0], step, alpha, q, n, coverage, back))
            if coverage is not None:
                alpha = min(max(alpha + self.rate(steps + 1) * (self.alpha - (1 - coverage)), self.low), self.high)
            self.level.update((alpha, steps + 1))
            self.open.removeKey((step,))
            if self.window(0.0) is None:
                self.pool.update((earlier.merged(own).data(),))
            else:
                self.closed.updateValue((step,), (own.data(),))
                for s in sorted(s[0] for s in self.closed.keys())[:-BACK]:
                    self.closed.removeKey((s,))
        if out:
            yield pd.DataFrame(out, columns=["series", "step", "alpha_t", "q", "n", "coverage", "window"]).astype({"window": "Int32"})

    def close(self) -> None:
        pass


def _stream(rows: DataFrame, series: str, ts: str, score: Column, x: Column, late: str, processor: AdaptiveSeries) -> DataFrame:
    kind = rows.schema[series].dataType.simpleString()
    timed = rows.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    ends = F.unix_millis(F.to_timestamp(F.make_date(F.year("_ts") + 1, F.lit(1), F.lit(1))))
    slim = timed.select(F.col(series).alias("series"), F.year("_ts").alias("step"), score.cast("double").alias("score"), x.cast("double").alias("x"), ends.alias("ends"), "_ts")
    schema = f"series {kind}, step int, alpha_t double, q double, n bigint, coverage double, window int"
    return slim.groupBy("series").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def adaptive_stream(rows: DataFrame, series: str, ts: str, alpha: float = 0.1, rate: float = 0.05, low: float = 0.01, high: float = 0.4, late: str = "30 days", eps: float = EPS) -> DataFrame:
    """(series, step, alpha_t, q, n, coverage, window) a year, as adaptive_conformal() gives for the whole table.

    rows is a stream of (series, ts, y, lo, hi). A year is given out once the watermark, `late` behind the latest row, has
    passed its end; rows that come later are left out. Ranks behind q and coverage are off by 2 eps at most, as a share; below
    1 / eps scores they are exact. Needs the RocksDB state store.
    """
    score = F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi"))
    return _stream(rows, series, ts, score, F.lit(0.0), late, AdaptiveSeries(alpha, lambda t: rate, low, high, lambda x: None, eps))


def severity_adaptive_stream(
    rows: DataFrame, series: str, ts: str, severity: str, alpha: float = 0.1, rate: float = 0.05, widen: float = 0.05, low: float = 0.01, high: float = 0.4, late: str = "30 days", eps: float = EPS
) -> DataFrame:
    """As adaptive_stream(), for severity_adaptive_conformal(): scores relative to severity, and few years looked back on."""
    weight = 1 + F.lit(widen) * F.ln(1 + F.greatest(F.col(severity), F.lit(0.0)))
    score = F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi")) / weight
    window = lambda x: BACK if x is None or x < 1 else 3 if x < 5 else 2
    return _stream(rows, series, ts, score, F.col(severity), late, AdaptiveSeries(alpha, lambda t: rate / math.sqrt(t), low, high, window, eps))
