"""Word hashes of Arrow string batches, in numpy: one pass over the bytes instead of a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(20_240_607).integers(1, 2**63, 256, dtype=np.uint64)
#: Bytes hashed at a time (the power tables are as long), and rows copied at a time.
PIECE, SLICE = 1 << 18, 256
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(18, (n + 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        base, inverse = np.full(size, _BASE, _U), np.full(size, pow(_BASE, -1, 2**64), _U)
        base[0] = inverse[0] = 1
        _POWERS[size] = np.cumprod(base, dtype=_U), np.cumprod(inverse, dtype=_U)
    return _POWERS[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def word_hashes(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, place of each row's first word) for runs of rows with about PIECE bytes.

    The places have one more entry than rows. Null texts have no words. A text is never cut.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for first in range(0, len(texts), SLICE):
        for row, end, h, places in _word_hashes(texts.slice(first, SLICE).cast(pa.large_string()).fill_null(""), lower):
            yield first + row, first + end, h, places


def _word_hashes(texts: pa.Array, lower: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        end = min(end, n)
        yield row, end, *_hashes(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], lower)
        row = end


def _hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    if lower:
        data = _LOWER[data]
    blank = _BLANK[data]
    new = np.ones(len(data), bool)
    new[1:] = blank[:-1]
    cut = offsets[:-1]
    new[cut[cut < len(data)]] = True
    starts = np.flatnonzero(new & ~blank)
    last = np.ones(len(data), bool)
    last[:-1] = new[1:] | blank[1:]
    ends = np.flatnonzero(last & ~blank) + 1
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_VALUES[data] * power[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(_U)), np.searchsorted(starts, offsets)


def windows(h: np.ndarray, places: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k consecutive words inside a row, and the place of its first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    power, inverse = _powers(len(h))
    total = np.zeros(len(h) + 1, _U)
    np.cumsum((mix(h + _U(seed)) if seed else h) * power[: len(h)], out=total[1:])
    w = (total[k:] - total[:-k])[:n] * inverse[:n]
    ok = np.ones(n, bool)
    for p in places[1:-1]:
        ok[max(0, p - k + 1) : p] = False
    at = np.flatnonzero(ok)
    return mix(w[at] + _U(k)), at
