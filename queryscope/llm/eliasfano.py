"""Monotone sequences in Elias-Fano form, and flat files of arrays that are memory-mapped when read.

A sequence of n growing numbers below u keeps the low bits of each (whole bytes here) apart, and the high parts as unary gaps
in one bit vector: a one for each element, a zero at the end of each high value. A sparse directory of zeros finds the
elements of a high value; the low bytes are searched inside them.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow.fs as pafs

_ONE = np.uint64(1)
#: 64-bit words for each entry of the directory
STRIDE = 4


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of the sequence; values grow strictly or stay equal, all below ``universe``."""
    n = len(values)
    bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
    width = -(-bits // 8)
    low = np.empty((width, n), np.uint8)
    for k in range(width):
        low[k] = (values >> np.uint64(8 * k)) & np.uint64(0xFF)
    high = (values >> np.uint64(8 * width)).astype(np.int64) if width < 8 else np.zeros(n, np.int64)
    zeros = (universe >> (8 * width)) + 1
    size = n + zeros
    words = -(-size // 64)
    words += -words % STRIDE
    vector = np.zeros(words, np.uint64)
    at = high + np.arange(n)
    np.bitwise_or.at(vector, at >> 6, _ONE << (at & 63).astype(np.uint64))
    free = 64 - np.bitwise_count(vector).astype(np.int64).reshape(-1, STRIDE).sum(1)
    free += 64 * (STRIDE - 1)
    return {"low": low, "high": vector, "zeros": np.concatenate([[0], np.cumsum(free)]).astype(np.int64), "n": np.array([n, width, zeros], np.int64)}


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit."""
    place = np.zeros(len(word), np.uint64)
    k = k.astype(np.uint64)
    for width in (32, 16, 8, 4, 2, 1):
        w = np.uint64(width)
        below = np.bitwise_count((word >> place) & ((_ONE << w) - _ONE)).astype(np.uint64)
        go = below <= k
        k = np.where(go, k - below, k)
        place = np.where(go, place + w, place)
    return place.astype(np.int64)


class Sequence:
    """Reader of an encoded sequence."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str = ""):
        self.low, self.high, self.zeros = (arrays[prefix + k] for k in ("low", "high", "zeros"))
        self.n, self.width, self.buckets = (int(x) for x in arrays[prefix + "n"])
        self.ones = np.arange(len(self.zeros)) * (64 * STRIDE) - self.zeros

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Bit place of the k-th zero (from 0)."""
        block = np.searchsorted(self.zeros, k, "right") - 1
        rest = k - self.zeros[block]
        word = block * STRIDE
        for _ in range(STRIDE - 1):
            free = 64 - np.bitwise_count(self.high[word]).astype(np.int64)
            go = rest >= free
            if not go.any():
                break
            rest = np.where(go, rest - free, rest)
            word = np.where(go, word + 1, word)
        return word * 64 + _select_in_word(~self.high[word], rest)

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end place of the elements with a high part."""
        end = self._zero(high) - high
        before = np.maximum(high - 1, 0)
        start = np.where(high > 0, self._zero(before) - before, 0)
        return start, end

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for k in range(self.width):
            out |= self.low[k][i].astype(np.uint64) << np.uint64(8 * k)
        return out

    def find(self, values: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each value, -1 where absent; by successor search, inside [start, end) if given."""
        shift = np.uint64(8 * self.width)
        high = (values >> shift).astype(np.int64)
        low = values & ((_ONE << shift) - _ONE)
        lo, hi = self.bucket(high)
        if start is not None:
            lo, hi = np.maximum(lo, start), np.minimum(hi, end)
        stop = hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < low[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        there = lo < stop
        there[there] = self._low(lo[there]) == low[there]
        return np.where(there, lo, -1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places: the high part is found by a search over the zeros before the i-th one."""
        block = np.searchsorted(self.ones, i, "right") - 1
        rest = i - self.ones[block]
        word = block * STRIDE
        for _ in range(STRIDE - 1):
            have = np.bitwise_count(self.high[word]).astype(np.int64)
            go = rest >= have
            rest = np.where(go, rest - have, rest)
            word = np.where(go, word + 1, word)
        place = word * 64 + _select_in_word(self.high[word], rest)
        return ((place - i).astype(np.uint64) << np.uint64(8 * self.width)) | self._low(i)


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:") or "://" not in folder:
        return pafs.LocalFileSystem(), unquote(urlparse(folder).path)
    return pafs.FileSystem.from_uri(folder)


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file with a header and aligned arrays; written aside and moved, so that a repeated task leaves a whole file."""
    fs, path = _opened(folder)
    fs.create_dir(path, recursive=True)
    head, at, parts = {}, 0, []
    for k, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[k] = (a.dtype.str, a.shape, at)
        parts.append(a.tobytes() + b"\0" * (-a.nbytes % 64))
        at += len(parts[-1])
    top = json.dumps(head).encode()
    top += b" " * (-(len(top) + 1) % 64) + b"\n"
    aside = f"{path}/_{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as f:
        f.write(top)
        for p in parts:
            f.write(p)
    fs.move(aside, f"{path}/{name}")


def read_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    """Arrays of a file, mapped into memory. A file of a remote store is first copied to an unnamed temporary file."""
    fs, path = _opened(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        data = np.memmap(f"{path}/{name}", np.uint8, "r")
    else:
        with tempfile.TemporaryFile() as f, fs.open_input_stream(f"{path}/{name}") as source:
            while part := source.read(1 << 24):
                f.write(part)
            f.flush()
            data = np.memmap(f, np.uint8, "r")
    end = int(np.flatnonzero(data[: 1 << 16] == 10)[0]) + 1
    head = json.loads(data[:end].tobytes())
    out = {}
    for k, (dtype, shape, at) in head.items():
        size = int(np.prod(shape)) * np.dtype(dtype).itemsize
        out[k] = data[end + at : end + at + size].view(dtype).reshape(shape)
    return out


def remove(folder: str) -> None:
    fs, path = _opened(folder)
    fs.delete_dir(path)


__all__ = ["Sequence", "encode", "read_arrays", "remove", "write_arrays"]
