"""Array helpers that the operators use inside tasks: words, hashes and anchors of a batch.

Everything here works on the bytes of a slice of an Arrow batch at once. Hashes are sums
over position powers modulo 2**64 with a mixed table of symbol values, so the hash of any
stretch is a difference of two running sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space of all contracts: space, and bytes 9 to 13.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SLICE_BYTES = 1 << 19
_POSITION_BITS = np.uint64(30)
_POSITION = np.uint64((1 << 30) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = seeded(11, 256)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Sums:
    """Running sums of symbol values, for the hash of any stretch [start, end)."""

    def __init__(self, values: np.ndarray):
        power, self._back = _power(len(values) + 1)
        self._sum = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[:-1], out=self._sum[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sum[end] - self._sum[start]) * self._back[start]

    def every(self, length: int) -> np.ndarray:
        """The hash of the stretch of ``length`` symbols from each position."""
        n = len(self._sum) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self._sum[length:] - self._sum[:n]) * self._back[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each stretch; its length counts."""
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds of the rows in the bytes) of a text column.

    A slice holds at most ``limit`` bytes or a single row. Null counts as empty.
    """
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_binary()), b"")
    n = len(text)
    if not n:
        return
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first]
        first = end


class Words:
    """The words of a slice: ``start`` and ``end`` in its bytes; ``first[i]:first[i + 1]`` belong to row i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = SEPARATOR):
        n = len(data)
        gap = separator[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = gap[:-1], gap[1:]
        before[bounds[:-1][bounds[:-1] < n]] = True
        after[bounds[1:][bounds[1:] > 0] - 1] = True
        self.start = np.flatnonzero(~gap & before)
        self.end = np.flatnonzero(~gap & after) + 1
        self.first = np.searchsorted(self.start, bounds)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        return Sums(_BYTE[data]).of(self.start, self.end)


def byte_sums(data: np.ndarray) -> Sums:
    return Sums(_BYTE[data])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, from block-wise running minima."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(sums: Sums, first: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """The synchronising positions of every window of ``window`` symbols inside a row.

    Each window picks its ``gram`` of least hash (leftmost of equals), so equal windows pick
    the same place wherever they stand. Windows with the same pick are consecutive: ``low``
    to ``high`` are their starts, ``at`` the pick, ``row`` the row; ``gram`` is the hash of
    the picked symbols and ``span`` the hash of [low, high + window) and the place in it.
    """
    count = int(first[-1])
    hashes = sums.every(gram)
    place = np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min((hashes >> _POSITION_BITS << _POSITION_BITS) | place, window - gram + 1)
    valid = np.ones(len(least), bool)
    for edge in range(len(first) - 1):  # starts whose window would leave the row
        low, high = max(first[edge + 1] - window + 1, first[edge]), first[edge + 1]
        valid[low:high] = False
    starts = np.flatnonzero(valid[: max(0, count - window + 1)])
    pick = (least[starts] & _POSITION).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (starts[1:] != starts[:-1] + 1)
    opening = np.flatnonzero(new)
    closing = np.append(opening[1:], len(starts)) - 1 if len(starts) else opening
    low, high, at = starts[opening], starts[closing], pick[opening]
    shape = ((at - low) * 4096 + (high - low)).astype(np.uint64)
    span = mix(sums.raw(low, high + window) + shape * np.uint64(0xE7037ED1A0B428DB))
    return {"row": np.searchsorted(first, low, side="right") - 1, "low": low, "high": high, "at": at, "gram": hashes[at], "span": span}


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
