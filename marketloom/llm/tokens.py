"""Whole Arrow batches of texts as NumPy arrays: words, their places and 64-bit hashes.

A text is its UTF-8 bytes. Substring hashes come from a running polynomial sum modulo 2**64 over randomised byte
values, finished by a bit mixer, so that the hash of any byte range costs a few operations. They are the same in every
process and for every position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Texts are worked on in pieces of about so many bytes (more only for a single longer text).
PIECE = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective bit mixer on uint64 (the published finaliser of a common 64-bit hash)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


@cache
def byte_values(seed: int, lower: bool) -> np.ndarray:
    """A random odd 64-bit value for every byte; A-Z share those of a-z if ``lower``."""
    v = np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
    if lower:
        v[65:91] = v[97:123]
    return v


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(base, -1, 2**64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _POWERS[base] = (out[0], out[1])
    return have


@cache
def is_space(letters_only: bool) -> np.ndarray:
    """What separates words: the contracts' white space, or every ASCII byte that is no letter."""
    s = np.zeros(256, bool)
    s[[32, 9, 10, 11, 12, 13]] = True
    if letters_only:
        s[:128] = True
        s[65:91] = s[97:123] = False
    return s


@dataclass
class Piece:
    """Texts first..last-1 of a batch; ``offsets`` are their byte borders in ``data``."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def sums(self, seed: int = 1, lower: bool = False, base: int = BASE) -> np.ndarray:
        out = np.empty(len(self.data) + 1, np.uint64)
        out[0] = 0
        np.cumsum(byte_values(seed, lower)[self.data] * powers(len(self.data), base)[0][: len(self.data)], out=out[1:])
        return out

    def words(self, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and per text the index of its first word (with a last border)."""
        inside = ~is_space(letters_only)[self.data]
        n = len(inside)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        borders = self.offsets[1:-1]
        borders = borders[(borders > 0) & (borders < n)]
        before[borders] = False
        after[borders - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def split(self, size: int) -> Iterator[Piece]:
        """Pieces of about ``size`` bytes, more only for a single longer text."""
        o, i = self.offsets, 0
        while i < len(o) - 1:
            j = max(i + 1, int(np.searchsorted(o, o[i] + size, side="right")) - 1)
            yield Piece(self.first + i, self.first + j, self.data[o[i] : o[j]], o[i : j + 1] - o[i])
            i = j


def ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hashes of byte ranges, from the running sums."""
    return mixed((sums[ends] - sums[starts]) * powers(len(sums), base)[1][starts] + (ends - starts).astype(np.uint64))


def pieces(texts: pa.Array | pa.ChunkedArray, size: int = PIECE) -> Iterator[Piece]:
    """A string array in pieces; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if not wide and not pa.types.is_string(texts.type):
        texts, wide = texts.cast(pa.large_string()), True
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    yield from Piece(0, len(texts), raw, o).split(size)


class Index:
    """Positions of known 64-bit keys: a table of slots first, binary search for keys that share a slot."""

    def __init__(self, keys: np.ndarray) -> None:
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.bits = max(10, int(np.ceil(np.log2(max(len(keys), 1)))) + 3)
        slot = (self.keys >> U(64 - self.bits)).astype(np.int64)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.slots[slot] = np.arange(len(self.keys), dtype=np.int32)
        self.shared = np.zeros(1 << self.bits, bool)
        if len(slot) > 1:
            self.shared[slot[1:][slot[1:] == slot[:-1]]] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """The index into the given keys, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        slot = (h >> U(64 - self.bits)).astype(np.int64)
        at = self.slots[slot]
        hit = (at >= 0) & (self.keys[at] == h)
        lost = np.flatnonzero(~hit & self.shared[slot])
        if len(lost):
            k = np.minimum(np.searchsorted(self.keys, h[lost]), len(self.keys) - 1)
            good = self.keys[k] == h[lost]
            at[lost[good]] = k[good]
            hit[lost[good]] = True
        return np.where(hit, self.order[at], -1)


def per_text(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of values (n or n x k) between borders; empty texts get 0."""
    total = np.zeros((len(values) + 1,) + values.shape[1:], np.float64)
    np.cumsum(values, axis=0, out=total[1:], dtype=np.float64)
    return total[borders[1:]] - total[borders[:-1]]


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their number, or the sum of their weights."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    out, inverse = np.unique(keys, return_inverse=True)
    return out, np.bincount(inverse, weights, len(out)).astype(np.int64)


class Counter:
    """Counts of uint64 keys over many pieces, merged when the backlog is large."""

    def __init__(self, backlog: int = 1 << 20) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.waiting, self.backlog = 0, backlog

    def add(self, keys: np.ndarray, weights: np.ndarray | None = None) -> None:
        k, c = counted(keys, weights)
        self.keys.append(k)
        self.counts.append(c)
        self.waiting += len(k)
        if self.waiting > self.backlog and len(self.keys) > 1:
            self.merge()
            self.backlog = max(self.backlog, 2 * self.waiting)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        k, c = counted(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.waiting = [k], [c], len(k)
        return k, c


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def unsigned(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).astype(np.int64).view(np.uint64)
