"""Vectorised hashes of words, shingles and windows over UTF-8 bytes.

A batch of texts is one byte array.  Every hash is a polynomial in a fixed odd
base modulo 2**64, so that the hash of any run comes from two prefix sums; a
final mix spreads the bits.  The functions depend on their input alone, so all
executors agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
#: Space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random-looking value for each byte, so that low bits are not degenerate.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Powers:
    """Powers of the base and of its inverse, extended on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", BASE), ("down", INVERSE)):
                values = np.full(size, base, dtype=np.uint64)
                values[0] = 1
                setattr(self, name, np.multiply.accumulate(values))
        return self.up, self.down


POWERS = Powers()


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * BASE**i``, one longer than the input."""
    up, _ = POWERS.get(len(values) + 1)
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def runs(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end)."""
    _, down = POWERS.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each text starts, with the end of the last."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word, with the number of words at the end."""
    inside = np.ones(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~SPACES[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    if len(inner):  # a word never reaches over the end of its text
        cut = inner[(inside[inner] == 1) & (inside[inner + 1] == 1)]
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return runs(prefix(BYTE[data]), starts, ends)


def word_table(data: np.ndarray, offsets: np.ndarray, step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words, and for each text the index of its first word, with the number of words at the end.

    Long data is taken in parts of about ``step`` bytes that end at white space or
    at the end of a text, so that what is kept for each byte stays bounded.
    """
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + step)
        while end < len(data):
            ahead = SPACES[data[end : end + 65_536]]
            inner = int(np.searchsorted(offsets, end))
            stop = int(ahead.argmax()) if ahead.any() else len(ahead)
            if inner < len(offsets) and offsets[inner] <= end + stop:
                end = int(offsets[inner])
                break
            end += stop
            if ahead.any():
                break
        low, high = np.searchsorted(offsets, [at, end], side="right")
        own = np.concatenate([[at], offsets[low:high][offsets[low:high] < end], [end]]) - at
        starts, ends, _ = words(data[at:end], own)
        parts.append((starts + at, ends + at, word_hashes(data[at:end], starts, ends)))
        at = end
    starts, ends, keys = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return starts, ends, keys, np.searchsorted(starts, offsets)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    step, out = 1, x
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
