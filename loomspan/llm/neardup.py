"""MinHash near-dedup with odd sketches.

Each document becomes the set of its distinct word shingles. Documents with equal sets are one node. Banded MinHash
signatures give the buckets in which nodes meet; an odd sketch (the parities of the hashed MinHash samples) is kept
beside them, and the population count of the XOR of two sketches says how similar two sets are before any text moves.
Pairs that may reach the threshold are confirmed on the full sets.

A bucket of m nodes never becomes m * m pairs. First each member is paired with the bucket's first document. Members that
are then connected need no further pairs. In buckets that still hold several components, the members outside the first
document's component meet all others in tiles of bounded size, where sketches are compared across components, and nodes
that may be similar are put in one cluster. The full sets of a cluster
are then compared across components, again in tiles, and only true links leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan import scratch
from loomspan.llm import bloom
from loomspan.llm.columns import hide, show
from loomspan.llm.graph import components
from loomspan.llm.hashing import mix, windows, word_hashes

#: 40 bands of 5: at similarity 0.8 a pair meets in no band with odds of 1.2e-7. Samples and bits of a sketch.
BANDS, ROWS, SAMPLES, SKETCH = 40, 5, 512, 4096
#: How far below the threshold an estimate may be (over five standard deviations), and members of a tile.
SLACK, TILE = 0.1, 1024
_SEEDS = np.random.default_rng(7).integers(1, 2**32, (2, SAMPLES), dtype=np.uint32) | np.uint32(1)


def shingle_sets(h: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, back to back, and where each row's begin; fewer than k words are one shingle."""
    w, at = windows(h, places, k)
    row = np.searchsorted(places, at, "right") - 1
    short = np.flatnonzero((np.diff(places) > 0) & (np.diff(places) < k))
    if len(short):
        whole = np.array([np.bitwise_xor.reduce(mix(h[places[r] : places[r + 1]] + np.arange(places[r + 1] - places[r], dtype=np.uint64))) for r in short], np.uint64)
        w, row = np.concatenate([w, mix(whole + np.uint64(1))]), np.concatenate([row, short])
    order = np.lexsort((w, row))
    w, row = w[order], row[order]
    if len(w):
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (row[1:] != row[:-1])
        w, row = w[new], row[new]
    return w, np.searchsorted(row, np.arange(len(places)))


def _signature(w: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (rows, BANDS) and sketches (rows, SKETCH / 64) of non-empty sets that lie back to back."""
    n, held = len(starts), (mix(w) >> np.uint64(32)).astype(np.uint32)
    turned, least = np.empty_like(held), np.empty((SAMPLES, n), np.uint32)
    for k in range(SAMPLES):
        np.multiply(held, _SEEDS[0, k], out=turned)
        turned += _SEEDS[1, k]
        np.minimum.reduceat(turned, starts, out=least[k])
    least = least.T.astype(np.uint64)
    bands = np.zeros((n, BANDS), np.uint64)
    for r in range(ROWS):
        bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + least[:, r : BANDS * ROWS : ROWS])
    bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
    bits = (mix(least << np.uint64(16) | np.arange(SAMPLES, dtype=np.uint64)) >> np.uint64(40)) % np.uint64(SKETCH)
    sketch = np.zeros((n, SKETCH), np.uint8)
    np.bitwise_xor.at(sketch, (np.repeat(np.arange(n), SAMPLES), bits.astype(np.int64).ravel()), 1)
    return bands, np.packbits(sketch, axis=1, bitorder="little").view("<u8")


def likely(distance: np.ndarray | Column, threshold: float):
    """Whether the population count of the XOR of two sketches fits a similarity of threshold - SLACK or more."""
    return distance <= _most_bits(threshold - SLACK)


def _most_bits(similarity: float) -> float:
    differing = 2 * SAMPLES * (1 - similarity)
    return SKETCH * (1 - np.exp(-2 * differing / SKETCH)) / 2


def signatures(docs: DataFrame, k: int, lower: bool = True) -> DataFrame:
    """(doc_id, tk, n, set1, set2, bands, sketch) per row of (doc_id, text, tk); set1 and set2 are hashes of the set, null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, h, places in word_hashes(batch.column("text"), lower):
                w, starts = shingle_sets(h, places, k)
                n = np.diff(starts)
                full = np.flatnonzero(n)
                bands = np.zeros((len(n), BANDS), np.uint64)
                sketch = np.zeros((len(n), SKETCH // 64), np.uint64)
                one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(full):
                    bands[full], sketch[full] = _signature(w, starts[full])
                    one[full] = np.add.reduceat(mix(w), starts[full])
                    two[full] = np.add.reduceat(mix(w ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts[full])
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.view(np.int64).ravel()))
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), batch.column("tk").slice(row, end - row), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64), mask=none), pa.array(two.view(np.int64), mask=none), lists(bands), lists(sketch)],
                    ["doc_id", "tk", "n", "set1", "set2", "bands", "sketch"],
                )

    return docs.select("doc_id", "text", "tk").mapInArrow(run, "doc_id bigint, tk bigint, n bigint, set1 bigint, set2 bigint, bands array<bigint>, sketch array<bigint>")


def _distance(a: str, b: str) -> Column:
    bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda s, x: s + x)


def _confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, lower: bool, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the threshold. Texts of nodes in a pair move, others don't."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = _texts(scratch.materialize(ends.join(nodes.select("node", "doc_id", "tk"), "node"), "pair-ends"), docs)
    of_a, of_b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)

        def whole(text: str) -> np.ndarray:
            for _, _, h, places in word_hashes(pa.array([text]), lower):
                return shingle_sets(h, places, k)[0]

        for batch in batches:
            good = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if last[0] != a:
                    last = (a, whole(ta.as_py()))
                x, y = last[1], whole(tb.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a bigint, b bigint")


def _likely_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and sketches don't rule out."""
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    fits = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & likely(_distance("s_a", "s_b"), percent / 100)
    return both.where(fits).select("a", "b")


def _grouped(rows: DataFrame, keys: list[str], work, schema: str, names: list[str]) -> DataFrame:
    """work(table) for the rows of each key, streamed from sorted partitions; one group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def groups(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest
            t = pa.Table.from_batches(rest)
            marks = [t[c].to_numpy() for c in keys]
            cut = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            at = 0
            for end in [*cut.tolist(), t.num_rows] if last else cut.tolist():
                group = t.slice(at, end - at)
                alone = group["i"][0] != group["j"][0] and pc.count_distinct(group["tile"]).as_py() == 1
                if end - at > 1 and not alone:
                    found = work(group)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names)
                at = end
            rest = t.slice(at).to_batches()

        for batch in batches:
            if batch.num_rows:
                rest.append(batch)
                yield from groups(False)
        if rest:
            yield from groups(True)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, schema)


def _tiled(members: DataFrame, key: str, load: Column, most: int, details: DataFrame) -> DataFrame:
    """Members (key, node, doc_id, component) of keys that hold several components, in tiles (i, j) of about twice `most` load.

    Members that share the component of the key's first document need not meet each other, and they are most of a large
    group of copies. So the other members' tiles come first, and every tile meets those alone: a member is there once for
    each tile that it meets. The details of a node join the members that are left.
    """
    parts = members.groupBy(key, "component").agg(F.min("doc_id").alias("doc_id"), F.sum(load).alias("load"))
    tiles = parts.groupBy(key).agg(F.min(F.struct("doc_id", "component", "load")).alias("first"), F.sum("load").alias("load"), F.count(F.lit(1)).alias("parts"))
    count = lambda load: F.ceil(load / most).cast("int")
    tiles = tiles.where("parts > 1").select(F.col(key).alias("_key"), F.col("first.component").alias("major"), count(F.col("load") - F.col("first.load")).alias("minors"), count(F.col("first.load")).alias("majors"))
    held = members.join(scratch.materialize(tiles, "tiles"), F.col(key) == F.col("_key")).withColumn("minor", F.col("component") != F.col("major"))
    met = held.drop("_key", "major", "doc_id").join(details, "node")
    spread = F.xxhash64("node")
    met = met.withColumn("tile", F.when(F.col("minor"), F.pmod(spread, "minors")).otherwise(F.col("minors") + F.pmod(spread, "majors")).cast("int"))
    last = F.when(F.col("minor"), F.col("minors") + F.col("majors")).otherwise(F.col("minors")) - 1
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return met.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")).drop("minor", "minors", "majors", "other")


def _may_fit(members: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect the nodes of a bucket (key, node, doc_id, component) with likely pairs across components.

    They form trees, at most one edge a node and task, and say which nodes have to be compared with each other.
    """
    most = _most_bits(percent / 100 - SLACK)

    def work(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, comp, n, tile = (t[c].to_numpy() for c in ("node", "component", "n", "tile"))
        sketch = t["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        left, right = np.flatnonzero(tile == tile.min()), np.flatnonzero(tile == tile.max())
        root = np.arange(len(node))
        for part in np.array_split(left, max(1, len(left) * len(right) // 100_000)):
            ok = comp[part][:, None] != comp[right][None, :]
            ok &= 100 * np.minimum(n[part][:, None], n[right][None, :]) >= percent * np.maximum(n[part][:, None], n[right][None, :])
            i, j = np.nonzero(ok)
            near = np.bitwise_count(sketch[part[i]] ^ sketch[right[j]]).sum(axis=1) <= most
            a, b = part[i[near]], right[j[near]]
            while len(a):  # hang all on the smallest place they are connected to
                low = np.minimum(root[a], root[b])
                np.minimum.at(root, root[a], low)
                np.minimum.at(root, root[b], low)
                root = root[root]
                apart = root[a] != root[b]
                a, b = a[apart], b[apart]
        hung = np.flatnonzero(root != np.arange(len(node)))
        return node[hung], node[root[hung]]

    met = _tiled(members, "key", F.lit(1), TILE, light.select("node", "n", "sketch")).select("key", "i", "j", "tile", "node", "component", "n", "sketch")
    return _grouped(met, ["key", "i", "j"], work, "a bigint, b bigint", ["a", "b"])


def _exact_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components among nodes (cluster, node, doc_id, component, n) of one cluster, by their full sets.

    A task counts the common shingles of all pairs of two tiles by products of 0/1 matrices. One link is given for two
    components that have several in a task.
    """

    def work(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, comp, n, tile = (t[c].to_numpy() for c in ("node", "component", "n", "tile"))
        held = t["shingles"].combine_chunks()
        row = np.repeat(np.arange(len(node)), n)
        _, column, times = np.unique(held.flatten().to_numpy(), return_inverse=True, return_counts=True)
        common = times[column] > 1
        row, column = row[common], (np.cumsum(times > 1) - 1)[column[common]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        left, right = np.flatnonzero(tile == tile.min()), np.flatnonzero(tile == tile.max())
        both = np.zeros((len(left), len(right)), np.float32)
        width = 4096
        for at in range(0, int(column.max(initial=-1)) + 1, width):
            i, j = np.searchsorted(column, [at, at + width])
            block = np.zeros((len(node), width), np.float32)
            block[row[i:j], column[i:j] - at] = 1
            both += block[left] @ block[right].T
        ok = comp[left][:, None] != comp[right][None, :]
        ok &= 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
        a, b = np.nonzero(ok)
        a, b = left[a], right[b]
        two = np.sort(np.stack([comp[a], comp[b]]), axis=0)
        _, one = np.unique(two, axis=1, return_index=True)
        return node[a[one]], node[b[one]]

    met = _tiled(members, "cluster", F.col("n"), 200_000, sets).select("cluster", "i", "j", "tile", "node", "component", "n", "shingles")
    return _grouped(met, ["cluster", "i", "j"], work, "a bigint, b bigint", ["a", "b"])


def _texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of wanted (node, doc_id, tk). Texts of other documents don't move."""
    inside = bloom.of_column(wanted.select("doc_id"))
    of = wanted.select("node", F.col("doc_id").alias("_d"), F.col("tk").alias("_t"))
    return bloom.keep(docs, "doc_id", inside).join(of, (F.col("doc_id") == F.col("_d")) & (F.col("tk") == F.col("_t"))).select("node", "text")


def _with_sets(wanted: DataFrame, docs: DataFrame, k: int, lower: bool) -> DataFrame:
    """(node, shingles) of wanted (node, doc_id, tk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, h, places in word_hashes(batch.column(1), lower):
                w, starts = shingle_sets(h, places, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(w.view(np.int64)))], ["node", "shingles"])

    return _texts(wanted, docs).dropDuplicates(["node"]).mapInArrow(run, "node bigint, shingles array<bigint>")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of (doc_id, text).

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    doc_id that links reach. Null, empty and blank texts have an empty set and no link. Rows that share a doc_id are one
    document to the links. A row without doc_id takes no part: its component_id is null and it is kept. The threshold
    must be 80 or more, for which the bands are laid out. Extra columns are ignored.
    """
    if percent < 80:
        raise ValueError("the bands are laid out for similarities of 0.8 and more")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("tk", F.xxhash64("text"))
    found = scratch.materialize(signatures(docs, k, lower), "signatures")
    own = found.where(F.col("doc_id").isNotNull() & F.col("set1").isNotNull())
    # equal sets are one node, held by their first document
    first = own.groupBy("set1", "set2").agg(F.min(F.struct("doc_id", "tk", "n", "bands", "sketch")).alias("f"))
    nodes = scratch.materialize(first.select(F.xxhash64("set1", "set2").alias("node"), "f.*"), "nodes")

    # buckets of several nodes, with the node of their first document: of copies it is most likely what they were made from
    keys = nodes.select("node", "doc_id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min(F.struct("doc_id", "node")).alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = scratch.materialize(shared.select(F.col("key").alias("_key"), F.col("lead.node").alias("lead")), "buckets")
    members = scratch.materialize(keys.join(shared, F.col("key") == F.col("_key")).select("key", "node", "doc_id", "lead"), "members")

    light = nodes.select("node", "n", "sketch")
    stars = members.where("node <> lead").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
    tried = scratch.materialize(_likely_pairs(stars, light, percent), "likely-stars")
    links = scratch.materialize(_confirm(tried, nodes, docs, k, lower, percent), "star-links")
    joined = components(links)

    # pairs across components in buckets that hold several
    component = lambda rows: rows.join(joined.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("component", F.coalesce("component", "node")).drop("_n")
    near = scratch.materialize(_may_fit(component(members.drop("lead")), light, percent), "may-fit")
    clusters = components(near).select("node", F.col("component").alias("cluster"))
    wanted = scratch.materialize(component(clusters.join(nodes.select("node", "doc_id", "tk", "n"), "node")), "clusters")
    sets = _with_sets(wanted.select("node", "doc_id", "tk"), docs, k, lower)
    across = scratch.materialize(_exact_links(wanted.drop("tk"), sets, percent), "across-links")

    # documents hang on their set's node, linked sets on each other
    ends = lambda x: nodes.select(F.col("node").alias(x), F.col("doc_id").alias(f"d_{x}"))
    set_links = links.union(across).join(ends("a"), "a").join(ends("b"), "b").select(F.col("d_a").alias("a"), F.col("d_b").alias("b"))
    hung = own.select("doc_id", F.xxhash64("set1", "set2").alias("a")).join(ends("a"), "a").where("doc_id <> d_a").select(F.col("doc_id").alias("a"), F.col("d_a").alias("b"))
    whole = components(set_links.union(hung))
    out = found.select("doc_id", F.col("n").alias("n_shingles")).join(whole.withColumnRenamed("node", "_n"), F.col("doc_id") == F.col("_n"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """One row of docs for each component: its smallest doc_id, and of rows that share that id the one with the smallest text hash.

    Rows without doc_id all stay. Only rows that may have to go move to a join; the others are passed on in place.
    """
    docs, names = hide(docs, "doc_id", "text")
    judged = scratch.materialize(near_duplicates(docs, k, percent, lower), "judged")
    gone = judged.where(~F.col("kept")).select("doc_id").distinct()
    several = judged.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    gone = scratch.materialize(gone, "near-duplicates")
    doubtful = bloom.of_column(gone.union(several))
    held = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    sure = bloom.keep(held, "doc_id", doubtful, inside=False)
    rest = bloom.keep(held, "doc_id", doubtful).join(gone, "doc_id", "left_anti")
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    rest = rest.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return show(sure.select(*docs.columns).union(rest.select(*docs.columns)), names, "doc_id", "text")
