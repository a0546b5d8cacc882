"""Exact substring dedup over words with fixed-block anchors.

Every document indexes its non-overlapping blocks of BLOCK words. Any window of WINDOW >= 2 * BLOCK - 1 words holds one
whole block of its document, so two documents that share a window share an anchor: an indexed block of one that a
rolling probe of the other hits. Hits are extended to all windows around them, windows are compared by 128 bits of hash, and runs
of windows found in an earlier document are the maximal repeats that go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.llm import bloom
from loomspan.llm.columns import hide, show
from loomspan.llm.hashing import windows, word_hashes

WINDOW, BLOCK = 50, 25
#: Turns the word hashes of the second window hash: windows of two documents are equal if all 128 bits are.
SEED = 0x5DEECE66D


def _blocks(h: np.ndarray, places: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling block hashes, the places of their first words, and whether they are aligned in their row."""
    w, at = windows(h, places, block)
    row = np.searchsorted(places, at, "right") - 1
    return w, at, (at - places[row]) % block == 0


def _index(docs: DataFrame, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bloom.BITS // 8, np.uint8)
        for batch in batches:
            for _, _, h, places in word_hashes(batch.column("text")):
                w, _, aligned = _blocks(h, places, block)
                bloom.add(bitmap, w[aligned])
        yield bloom.pieces(bitmap)

    return bloom.merged(docs.mapInArrow(run, bloom.PIECES))


def _probe(docs: DataFrame, index, block: int) -> DataFrame:
    """(h, aligned, probed): blocks of the index that occur, how often aligned, and whether a probe hits them elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, places in word_hashes(batch.column("text")):
                w, _, aligned = _blocks(h, places, block)
                own, times = np.unique(w[aligned], return_counts=True)
                other = w[~aligned]
                other = np.unique(other[bloom.has(index.value, other)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([own, other]).view(np.int64)), pa.array(np.concatenate([times, np.zeros(len(other), np.int64)])), pa.array(np.repeat([0, 1], [len(own), len(other)]))],
                    ["h", "aligned", "probed"],
                )

    return docs.mapInArrow(run, "h bigint, aligned bigint, probed bigint")


def _candidates(docs: DataFrame, shared, window: int, block: int) -> DataFrame:
    """(h, h2, doc_id) of the windows that hold a shared block; h and h2 are independent hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, h, places in word_hashes(batch.column("text")):
                w, at = windows(h, places, block)
                hit = np.zeros(len(h) + 1, np.int64)
                hit[1:][at[bloom.has(shared.value, w)]] = 1
                hit = np.cumsum(hit)
                big, start = windows(h, places, window)
                again, _ = windows(h, places, window, seed=SEED)
                held = hit[start + window - block + 1] > hit[start]
                ids = batch.column("doc_id").slice(row, end - row)
                of = np.searchsorted(places, start[held], "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(big[held].view(np.int64)), pa.array(again[held].view(np.int64)), ids.take(pa.array(of))], ["h", "h2", "doc_id"])

    return docs.mapInArrow(run, "h bigint, h2 bigint, doc_id bigint")


def repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, gone array<bigint>): hashes of each document's windows that also start in a smaller doc_id."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block at any alignment")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    index = _index(docs, block)
    hits = _probe(docs, index, block).groupBy("h").agg(F.sum("aligned").alias("aligned"), F.max("probed").alias("probed"))
    shared = bloom.of_column(hits.where((F.col("aligned") > 1) | (F.col("aligned") > 0) & (F.col("probed") > 0)).select("h"), bloom.BITS)
    found = scratch.materialize(_candidates(docs, shared, window, block), "window-candidates")
    # the smallest document of each window, for windows of several; written, so that the join below can split hot windows
    first = found.groupBy("h", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = scratch.materialize(first.where("first < last").select(F.col("h").alias("_h"), F.col("h2").alias("_h2"), "first"), "window-firsts")
    gone = found.join(first, (F.col("h") == F.col("_h")) & (F.col("h2") == F.col("_h2"))).where(F.col("doc_id") > F.col("first"))
    return gone.groupBy("doc_id").agg(F.collect_list("h").alias("gone"))


def _marks(text: str, gone: list[int] | None, window: int) -> tuple[list[bytes], np.ndarray]:
    """Words of a text and whether each goes."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    out = np.zeros(len(words) + 1, np.int64)
    if gone:
        for _, _, h, places in word_hashes(pa.array([text])):
            w, at = windows(h, places, window)
            at = at[np.isin(w.view(np.int64), np.array(gone, np.int64))]
            np.add.at(out, at, 1)
            np.add.at(out, at + window, -1)
    return words, np.cumsum(out)[:-1] > 0


def _split(docs: DataFrame, window: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Documents that surely keep all words, and the others with their `gone`."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    gone = scratch.materialize(repeats(docs, window, block), "repeats")
    touched = bloom.of_column(gone.select("doc_id"))
    clean = bloom.keep(docs, "doc_id", touched, inside=False)
    some = bloom.keep(docs, "doc_id", touched).join(gone.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    return clean, some


def dedup_digests(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of docs.

    Null and empty texts have no words; texts shorter than the window lose none. A row without doc_id loses nothing and
    makes no other row lose anything. Rows that share a doc_id don't affect each other. Extra columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    clean, some = _split(docs, window, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, gone in zip(*(batch.column(k) for k in range(3)), strict=True):
                words, out = _marks(text.as_py() or "", gone.as_py(), window)
                kept = [w for w, x in zip(words, out.tolist(), strict=True) if not x] if out.any() else words
                rows.append((doc_id.as_py(), len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    none = F.lit(None).cast("array<bigint>").alias("gone")
    return clean.select("doc_id", "text", none).mapInArrow(run, schema).union(some.select("doc_id", "text", "gone").mapInArrow(run, schema))


def strip(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """docs without the repeated words: their bytes go, with the blanks behind them; other texts stay to the byte.

    Texts are handled as in dedup_digests(); all columns of docs are returned, n_chars (if there) for the new text.
    """
    needed = ("doc_id", "text", "n_chars")
    docs, names = hide(docs, *needed)
    clean, some = _split(docs, window, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_at, gone_at = batch.schema.get_field_index("text"), batch.schema.get_field_index("gone")
            texts = [_stripped(t.as_py(), g.as_py(), window) for t, g in zip(batch.column(text_at), batch.column(gone_at), strict=True)]
            batch = batch.set_column(text_at, "text", pa.array(texts, pa.string()))
            yield batch.select([n for n in batch.schema.names if n != "gone"])

    some = some.select(*docs.columns, "gone").mapInArrow(run, clean.schema)
    out = clean.unionByName(some)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return show(out, names, *needed)


def _stripped(text: str | None, gone: list[int] | None, window: int) -> str | None:
    if text is None or not gone:
        return text
    words, out = _marks(text, gone, window)
    if not out.any():
        return text
    data, at, parts = text.encode("utf-8", "surrogatepass"), 0, []
    for k, word in enumerate(words):
        start = data.index(word, at)
        end = data.index(words[k + 1], start + len(word)) if k + 1 < len(words) else len(data)
        if k == 0:
            parts.append(data[:start])
        if not out[k]:
            parts.append(data[start:end])
        at = start + len(word)
    return b"".join(parts).decode("utf-8", "surrogatepass")
