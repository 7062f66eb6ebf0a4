"""Short binary blocks of sorted integers, for rows that would otherwise move one by one.

An n-gram that is seen once costs a row of 28 bytes or more in a shuffle. As a member of a sorted block it costs about five.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard


def pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned integers as byte planes, each compressed by itself: high bytes are mostly equal, low ones are noise."""
    press = zstandard.ZstdCompressor(level=1)
    out = [np.uint8(len(columns)).tobytes()]
    for c in columns:
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        planes = np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
        pressed = [press.compress(p.tobytes()) for p in planes]
        out.append(np.array([len(c), width, *map(len, pressed)], "<u4").tobytes())
        out.extend(pressed)
    return b"".join(out)


def unpack(block: bytes) -> list[np.ndarray]:
    """The columns that ``pack`` was given, as uint64."""
    open_ = zstandard.ZstdDecompressor()
    out, at = [], 1
    for _ in range(block[0]):
        n, width = np.frombuffer(block, "<u4", 2, at).tolist()
        sizes = np.frombuffer(block, "<u4", width, at + 8).tolist()
        at += 8 + 4 * width
        c = np.zeros((n, 8), np.uint8)
        for i, size in enumerate(sizes):
            c[:, i] = np.frombuffer(open_.decompress(block[at : at + size], max_output_size=max(n, 1)), np.uint8)
            at += size
        out.append(c.reshape(-1).view("<u8"))
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending unsigned integers, the first one whole."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def by_range(keys: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of the keys of each of ``count`` (a power of two) ranges of their lowest bits, in the order given."""
    # numbers of 16 bits are sorted by their digits, which is several times faster
    r = (keys & np.uint64(count - 1)).astype(np.uint16 if count <= 1 << 16 else np.int32)
    order = np.argsort(r, kind="stable")
    borders = np.searchsorted(r[order], np.arange(count + 1))
    for i in np.flatnonzero(np.diff(borders)):
        yield int(i), order[borders[i] : borders[i + 1]]


def range_count(rows: int, each: int = 1 << 22, least: int = 64) -> int:
    """A power of two of ranges, so that one holds about ``each`` of ``rows`` evenly hashed rows at most."""
    return max(least, 1 << max(0, int(np.ceil(np.log2(max(1, rows) / each)))))
