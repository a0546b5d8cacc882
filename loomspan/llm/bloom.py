"""Bloom filters of one fixed size, built in tasks, merged by or, and broadcast.

The size is a parameter and never grows with the data: a fuller filter only lets more rows through to the exact step
behind it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspan.llm.hashing import mix

#: Bits of a filter of text hashes (16 MB) and of one of ids (4 MB), and bytes of the pieces that are merged.
BITS, ID_BITS, CHUNK = 1 << 27, 1 << 25, 1 << 16


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    h = h.view(np.uint64)
    return (mix(h + np.uint64(0x51ED270B)) & mask).astype(np.int64), (mix(h ^ np.uint64(0x2545F4914F6CDD1D)) & mask).astype(np.int64)


def add(bitmap: np.ndarray, h: np.ndarray) -> None:
    """Enter 64-bit hashes into a bitmap of bytes."""
    for at in _places(h, len(bitmap) * 8):
        np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))


def has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may have been entered; never false for one that was."""
    a, b = _places(h, len(bitmap) * 8)
    found = (bitmap[a >> 3] >> (a & 7).astype(np.uint8)) & 1 == 1
    some = np.flatnonzero(found)
    found[some] = (bitmap[b[some] >> 3] >> (b[some] & 7).astype(np.uint8)) & 1 == 1
    return found


def pieces(bitmap: np.ndarray) -> pa.RecordBatch:
    """The pieces of a bitmap that have a bit set, compressed."""
    whole = bitmap.reshape(-1, CHUNK)
    used = np.flatnonzero(whole.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([zlib.compress(whole[k].tobytes(), 1) for k in used], pa.binary())], ["chunk", "bits"])


PIECES = "chunk bigint, bits binary"


def merged(parts: DataFrame, bits: int = BITS):
    """A broadcast of the bitmap that is the or of all parts (chunk, bits). Tasks hold the pieces dealt to them."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                piece = np.frombuffer(zlib.decompress(data), np.uint8)
                held[chunk] = held[chunk] | piece if chunk in held else piece
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())], ["chunk", "bits"])

    bitmap = np.zeros((bits // 8 // CHUNK, CHUNK), np.uint8)
    for row in parts.repartition("chunk").mapInArrow(fold, PIECES).collect():  # bits / 8 bytes in all, whatever the data
        bitmap[row.chunk] = np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return parts.sparkSession.sparkContext.broadcast(bitmap.reshape(-1))


def of_column(values: DataFrame, bits: int = ID_BITS):
    """A broadcast filter of the one bigint column of values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            add(bitmap, batch.column(0).drop_null().to_numpy(zero_copy_only=False))
        yield pieces(bitmap)

    return merged(values.mapInArrow(run, PIECES), bits)


def keep(rows: DataFrame, column: str, bitmap, inside: bool = True) -> DataFrame:
    """Rows whose bigint column may be in the filter, or (inside=False) is surely not or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column))
            found = has(bitmap.value, values.fill_null(0).to_numpy(zero_copy_only=False)) & ~np.array(values.is_null())
            yield batch.filter(pa.array(found == inside))

    return rows.mapInArrow(run, rows.schema)
