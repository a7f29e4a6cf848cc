"""Vectorised words and shingles over Arrow string columns.

Words are maximal runs of bytes other than space and 0x09-0x0D, the same runs that
``[^\\x20\\x09-\\x0D]+`` matches in the decoded text.  All work is done on slices of a few
megabytes, so memory does not depend on how many rows an Arrow batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        step = np.full(size, base, dtype=_U)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 8 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


class Words:
    """Words of a slice: byte spans, and where each row's words begin (``row[i]:row[i+1]``)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = True):
        self.data = _LOWER[data] if lower else data
        inside = ~_IS_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.start, offs)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        total = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[self.data] * _power(_R, n), out=total[1:])
        h = (total[self.end] - total[self.start]) * _power(_RINV, n + 1)[self.start]
        return mix(h + (self.end - self.start).astype(_U) * _U(0xD6E8FEB86659FD93))


def shingle_hashes(h: np.ndarray, row: np.ndarray, width: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words and the rows' bounds in them, in text order with repeats.

    A row with fewer words has one shingle of them all if ``short``, else none; a row without words has none.
    """
    count = np.diff(row)
    n = np.where(count >= width, count - width + 1, (count > 0) & short)
    bound = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(bound[-1]), _U)
    if len(h) >= width:
        m = len(h) - width + 1
        acc = np.zeros(m, _U)
        for j in range(width):
            acc = acc * _U(0xA24BAED4963EE407) + h[j : j + m]
        full = count >= width
        k = np.repeat(full, n)
        starts = np.repeat(row[:-1][full] - bound[:-1][full], n[full])
        out[k] = mix(acc[np.flatnonzero(k) + starts])
    if short:
        for i in np.flatnonzero((count > 0) & (count < width)):
            v = 0
            for x in h[row[i] : row[i + 1]]:
                v = (v * 0xA24BAED4963EE407 + int(x)) & 0xFFFFFFFFFFFFFFFF
            out[bound[i]] = mix(np.array([v ^ (0x5851F42D4C957F2D * int(count[i]) & 0xFFFFFFFFFFFFFFFF)], _U))[0]
    return out, bound


def distinct_per_row(values: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the rows' bounds."""
    rows = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    order = np.lexsort((values, rows)) if len(bound) > 400 * max(1, len(values)) else None
    if order is None:
        out = values.copy()
        for i in range(len(bound) - 1):
            out[bound[i] : bound[i + 1]].sort()
    else:
        out = values[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
    return out[keep], np.concatenate([[0], np.cumsum(np.bincount(rows[keep], minlength=len(bound) - 1))]).astype(np.int64)
