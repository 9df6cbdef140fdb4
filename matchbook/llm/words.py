"""Words and n-grams of whole texts as numpy arrays, straight from Arrow string buffers.

A word is a run of bytes other than ASCII white space. Hashes are polynomial sums over random
byte values modulo 2**64, taken as differences of prefix sums and then mixed; two lanes with
other constants give 128 bits where equality must hold over a whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one round of array work takes (a longer text is a round of its own).
ROUND_BYTES = 1 << 20
SLICE_ROWS = 1024

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
#: Odd multipliers and their inverses modulo 2**64: per lane one for bytes, one for words.
_MUL = [[0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93], [0xA0761D6478BD642F, 0xE7037ED1A0B428DB]]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(mul: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(mul)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, mul, np.uint64), np.full(size, pow(mul, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 4 * ROUND_BYTES:
            _POWERS[mul] = have
    return have


def rounds(column: pa.Array, limit: int = ROUND_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, end row, their bytes, and the offsets of the rows in them. Null is empty.

    Only SLICE_ROWS rows at a time are brought into one buffer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for base in range(0, len(column), SLICE_ROWS):
        part = pc.fill_null(column.slice(base, SLICE_ROWS).cast(pa.large_string()), "")
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        first = 0
        while first < len(part):
            end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield base + first, base + end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
            first = end


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and per row the index of its first word (and the end)."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = ~word[:-1]
    after[:-1] = ~word[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _sums(values: np.ndarray, mul: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(mul, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of the bytes of each span; spans may overlap."""
    found = _sums(_BYTE[lane][data], _MUL[lane][0], starts, ends)
    return mix(found + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def grams(values: np.ndarray, starts: np.ndarray, width, lane: int = 0) -> np.ndarray:
    """Hash of ``width`` consecutive values from each start."""
    return mix(_sums(values, _MUL[lane][1], starts, starts + width) ^ np.uint64(0x5851F42D4C957F2D))


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``width`` values inside the rows, and the row of each."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][row], row


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each start, the offset into ``values`` of the leftmost least of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at, have = values.copy(), np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        best, at, have = np.where(take, right, left), np.where(take, at[step:], at[: len(at) - step]), have + step
    return at[:n]
