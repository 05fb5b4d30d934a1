"""Words of Arrow text batches as 64-bit hashes, without a Python object per word.

A word's hash is a polynomial over random 64-bit values of its bytes, taken from prefix sums, so that all words of a batch
are hashed by a few array operations. Different words share a hash with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes hashed together; bounds the temporary arrays
SPAN = 1 << 19
#: bytes of texts handled together
SLICE = 4 << 20

#: space and the controls 9 to 13
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: every ASCII byte but digits and letters
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = {"n": 0, "up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, SPAN)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _powers[name] = np.cumprod(t, dtype=np.uint64)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (in place)."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Words:
    """Words of some texts: hashes, byte ranges in ``data`` and each text's first word."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one entry more than texts
    data: np.ndarray  # lower-cased bytes

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def _text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return at, raw


def slices(column: pa.Array, separators: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int, Words]]:
    """(first text, end, their words) for runs of whole texts of about ``limit`` bytes; null counts as empty."""
    at, raw = _text_buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, _words(at[i : j + 1] - at[i], raw[at[i] : at[j]], separators)
        i = j


def _words(at: np.ndarray, raw: np.ndarray, separators: np.ndarray) -> Words:
    data = _LOWER[raw]
    inside = ~separators[data]
    if not len(data):
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), none, none, np.zeros(len(at), np.int64), data)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = at[(at > 0) & (at < len(data))]
    opens[edges] = inside[edges]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, "right")))
        base = starts[i]
        size = int(ends[j - 1] - base)
        up, down = _tables(size + 1)
        sums = np.empty(size + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_VALUES[data[base : base + size]] * up[:size], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        hashes[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return Words(mix(hashes), starts, ends, np.searchsorted(starts, at), data)


def chained(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbours (fewer results than hashes by ``size - 1``)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : k + n]
    return mix(out)


def runs_inside(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start index of every run of ``size`` words inside one text, and each text's first run."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    shift = np.repeat(first[:-1] - bounds[:-1], counts)
    return np.arange(bounds[-1]) + shift, bounds
