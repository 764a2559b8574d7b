"""Vectorised word, line and window arithmetic over Arrow text buffers.

Words are maximal runs of bytes other than the six ASCII spaces 0x20 and
0x09-0x0D, so UTF-8 continuation bytes never split. ``span_hash`` identifies words
and lines: eight bytes at a time go through a non-linear mixer, so no pattern of
letters makes two texts collide by construction, and two seeds give 128 bits where
exact grouping depends on them. ``Rolling`` is a polynomial modulo 2**64 that only
nominates: whoever uses it compares the bytes afterwards."""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, U).copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_TABLE = [mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(s)) for s in (11, 77)]
_BASE = [0x9FB21C651E98DF25, 0xD6E8FEB86659FD93]
_POWERS: list[tuple[np.ndarray, np.ndarray] | None] = [None, None]


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, kept for reuse within a worker."""
    got = _POWERS[which]
    if got is None or len(got[0]) < n:
        size, base = max(n, 1 << 16), _BASE[which]
        inverse = pow(base, -1, 1 << 64)
        got = tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, b, U))]) for b in (base, inverse))
        if size <= 2 << 20:
            _POWERS[which] = got
    return got


class Rolling:
    """Hash of any byte range of ``data`` in constant time."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        n = len(data) + 1
        self.power, self.inverse = _powers(which, n)
        self.sums = np.zeros(n, U)
        np.cumsum(_TABLE[which][data] * self.power[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


_LOW = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 8)), (1 << 64) - 1], U)
_LONG, _CHUNK = 512, 256


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of many byte ranges. Ranges over ``_LONG`` bytes are hashed by
    chunks, then the chunks' hashes, so one huge range takes few steps too."""
    n = end - start
    acc = mix(n.astype(U) * U(0x9E3779B97F4A7C15) + U(0x632BE59BD9B4E019 * (seed + 1) & (1 << 64) - 1))
    long = np.flatnonzero(n > _LONG)
    if len(long):
        parts = -(-n[long] // _CHUNK)
        first = np.cumsum(parts) - parts
        k = np.arange(int(parts.sum())) - np.repeat(first, parts)
        at = np.repeat(start[long], parts) + k * _CHUNK
        each = span_hash(data, at, np.minimum(at + _CHUNK, np.repeat(end[long], parts)), seed + 2)
        acc[long] = mix(acc[long] ^ span_hash(each.view(np.uint8), first * 8, (first + parts) * 8, seed + 4))
    left = np.flatnonzero((n > 0) & (n <= _LONG))
    if len(left):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        at, rest = start[left], n[left]
        while len(left):
            acc[left] = mix((acc[left] ^ (eight[at] & _LOW[np.minimum(rest, 8)])) * U(0xD6E8FEB86659FD93))
            more = rest > 8
            left, at, rest = left[more], at[more] + 8, rest[more] - 8
    return acc


def chain(acc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One step of a hash over a sequence of hashes; not linear in any of them."""
    acc = (acc ^ value) * U(0xD1342543DE82EF95)
    return acc ^ (acc >> U(29))


def words(data: np.ndarray, offs: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all words (runs of bytes that are not ``outside``); words never span rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~outside[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offs[(offs > 0) & (offs < len(data))]
    start[edge] |= inside[edge]
    end[edge - 1] |= inside[edge - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def windows(hashes: np.ndarray, rows: np.ndarray, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of one row, and the index of their first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    acc = np.full(n, salt, U)
    for k in range(width):
        acc = chain(acc, hashes[k : k + n])
    at = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return mix(acc[at]), at


def covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in one of the windows that start at ``at``."""
    d = np.zeros(n + width + 1, np.int32)
    np.add.at(d, at, 1)
    np.add.at(d, at + width, -1)
    return np.cumsum(d[:n]) > 0


def repeated_within(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values that sit in rows: masks of those that occur twice or more in
    their row, and of those equal to an earlier one of it."""
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys):
        order = np.lexsort((np.arange(len(keys)), keys, rows))
        same = (keys[order][1:] == keys[order][:-1]) & (rows[order][1:] == rows[order][:-1])
        later[order[1:][same]] = True
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    return twice, later


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all \\n-separated lines, empty ones too; an empty row has one empty line."""
    breaks = np.flatnonzero(data == 10)
    rows = np.searchsorted(offs, breaks, "right") - 1
    starts = np.concatenate([offs[:-1], breaks + 1])
    ends = np.concatenate([offs[1:], breaks])
    line_rows = np.concatenate([np.arange(len(offs) - 1), rows])
    order = np.lexsort((starts, line_rows))
    end_order = np.lexsort((ends, line_rows))
    return starts[order], ends[end_order], line_rows[order]
