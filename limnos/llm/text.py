"""Words and hashes of whole texts, in numpy, one text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A word: a run of anything but the six ASCII white-space characters (Java and SQL spelling).
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

_U = np.uint64
_PIECE = 1 << 19
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, 1 << 12)
_INV = _powers(pow(_BASE, -1, 1 << 64), 1 << 12)


def _reach(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if n > len(_POW):
        size = 1 << (n - 1).bit_length()
        _POW, _INV = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _POW, _INV


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def byte_views(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of each cell of a text column without copies; None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield raw[edges[i] : edges[i + 1]] if valid[i] else None


def word_edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every word."""
    inside = np.zeros(len(raw) + 2, np.int8)
    np.logical_not(_GAP[raw], out=inside[1:-1].view(bool))
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def word_hashes(raw: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash, the start and the end of every word; long texts go in pieces cut between words."""
    starts, ends = word_edges(raw)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        piece = raw[lo:hi]
        if lower:
            piece = _LOWER[piece]
        pow_, inv = _reach(hi - lo + 1)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[piece] * pow_[: hi - lo], out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix64((sums[b] - sums[a]) * inv[a] + (b - a).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        i = j
    return out, starts, ends


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive words; none when there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix64(out * _U(0xA24BAED4963EE407) + words[k : len(words) - n + 1 + k])
    return out


def symbol_values(raw: np.ndarray) -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return _BYTE[raw]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any run of symbols follows."""
    pow_, _ = _reach(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * pow_[: len(symbols)], out=out[1:])
    return out


def hash_run(sums: np.ndarray, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of a size that start at these places."""
    _, inv = _reach(len(sums))
    return mix64((sums[starts + size] - sums[starts]) * inv[starts])


def hash_all_runs(sums: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the runs of a size that start at any place, the same as ``hash_run`` gives."""
    _, inv = _reach(len(sums))
    return mix64((sums[size:] - sums[: len(sums) - size]) * inv[: len(sums) - size])
