"""Elias-Fano lists of monotone numbers in numpy arrays, and files of arrays that are memory-mapped."""

from __future__ import annotations

import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs

_ONE = np.uint64(1)


def _bits(n: int) -> np.uint64:
    return np.uint64((1 << n) - 1)


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit, from 0, of each word."""
    words, k, place = words.copy(), k.copy(), np.zeros(len(words), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(words & _bits(half)).astype(np.int64)
        up = k >= low
        k -= np.where(up, low, 0)
        place += np.where(up, half, 0)
        words = np.where(up, words >> np.uint64(half), words)
    return place


class EliasFano:
    """n numbers below u in about n * (2 + log2(u / n)) bits: the low bits of every number as they
    are, the high bits as one bit vector with a running count of ones for each 64 bits."""

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width = int(head[0]), int(head[1])
        self.low, self.high, self.ones = low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(((top >> width) + n + 1) // 64 + 1, np.uint64)
        np.bitwise_or.at(high, places >> 6, _ONE << (places & 63).astype(np.uint64))
        ones = np.r_[0, np.cumsum(np.bitwise_count(high).astype(np.int64))].astype(np.uint64)
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            at = np.arange(n) * width
            part, shift = values & _bits(width), (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, part << shift)
            spill = shift + np.uint64(width) > 64
            np.bitwise_or.at(low, (at[spill] >> 6) + 1, part[spill] >> (np.uint64(64) - shift[spill]))
        return cls(np.array([n, width], np.uint64), low, high, ones)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.uint64), self.low, self.high, self.ones]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        above = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | above) & _bits(self.width)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i.astype(np.uint64), "right") - 1
        place = word * 64 + _select(self.high[word], i - self.ones[word].astype(np.int64))
        return ((place - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def _before(self, part: np.ndarray) -> np.ndarray:
        """How many numbers have high bits below ``part``."""
        k = part - 1  # the k-th zero ends the numbers with high bits k
        out = np.zeros(len(part), np.int64)
        zeros = np.arange(len(self.ones)) * 64 - self.ones.astype(np.int64)
        inside = (k >= 0) & (k < zeros[-1])
        out[k >= zeros[-1]] = self.n
        word = np.searchsorted(zeros, k[inside], "right") - 1
        place = word * 64 + _select(~self.high[word], k[inside] - zeros[word])
        out[inside] = place - k[inside]
        return np.minimum(out, self.n)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of the first number that is at least ``x``, among the places from ``first`` to ``end``."""
        x = np.asarray(x, np.uint64)
        part = (x >> np.uint64(self.width)).astype(np.int64)
        low, high = self._before(part), self._before(part + 1)
        if first is not None:
            low, high = np.clip(low, first, end), np.clip(high, first, end)
        rest = x & _bits(self.width)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            less = self._low(mid) < rest[open_]
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        return low

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of ``x``, or -1."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        place = self.successor(x)
        inside = np.minimum(place, self.n - 1)
        return np.where((place < self.n) & (self.at(inside) == np.asarray(x, np.uint64)), place, -1)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, arrays: list[np.ndarray]) -> None:
    """Write arrays to one file. It appears whole or not at all, so a repeated task does no harm."""
    files, path = _open(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    padded = [np.ascontiguousarray(a).view(np.uint8) for a in arrays]
    head = np.array([len(arrays), *[len(a) for a in padded]], np.int64)
    draft = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        out.write(head.tobytes())
        for a in padded:
            out.write(a.tobytes() + bytes(-len(a) % 8))
    files.move(draft, path)


def get(uri: str, kinds: list) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped. A file that is not local is copied to an unnamed
    temporary file first, which goes when the arrays go."""
    files, path = _open(uri)
    if isinstance(files, fs.LocalFileSystem):
        buffer = pa.memory_map(path, "r").read_buffer()
        raw = np.frombuffer(buffer, np.uint8)
    else:
        held = tempfile.TemporaryFile()
        with files.open_input_stream(path) as source:
            shutil.copyfileobj(source, held)
        held.flush()
        raw = np.memmap(held, np.uint8, "r")
    n = int(raw[:8].view(np.int64)[0])
    sizes = raw[8 : 8 * (n + 1)].view(np.int64).tolist()
    out, at = [], 8 * (n + 1)
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(raw[at : at + size].view(kind))
        at += size + -size % 8
    return out
