"""Vectorised text helpers for Arrow batches: words, lines and their hashes.

A :class:`Slice` holds the UTF-8 bytes of a run of documents (about
``SLICE_BYTES``; a longer document is a slice of its own), separated by line
feeds. Words, lines and n-grams are index arrays into it, so no Python code
runs per word. Null texts count as empty.

Hashes are 64-bit polynomials over bytes (or over word hashes) followed by a
finalising mix; the constants are fixed, so every task and run agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV_BASE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective), elementwise."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            step = np.full(n, _BASE, np.uint64)
            step[0] = 1
            self.up = np.cumprod(step, dtype=np.uint64)
            step[1:] = np.uint64(_INV_BASE)
            self.down = np.cumprod(step, dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[s:e]`` for each span (values are uint64)."""
    up, down = _POWERS.get(len(values) + 1)
    acc = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=acc[1:])
    h = (acc[ends] - acc[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def byte_class(separators: bytes | None = None, words: bytes | None = None) -> np.ndarray:
    """Boolean table over byte values: True for bytes of a word."""
    t = np.ones(256, bool) if words is None else np.zeros(256, bool)
    for b in separators or b"":
        t[b] = False
    for b in words or b"":
        t[b] = True
    return t


#: words ``[^\x20\x09-\x0D]+``
PLAIN = byte_class(separators=b" \t\n\x0b\x0c\r")
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = byte_class(words=bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Slice:
    """Bytes of rows ``first .. first + n`` of a batch; ``edges[i]:edges[i + 1] - 1`` is row i."""

    def __init__(self, first: int, data: np.ndarray, edges: np.ndarray) -> None:
        self.first, self.data, self.edges, self.n = first, data, edges, len(edges) - 1

    def row_bytes(self, i: int) -> bytes:
        return self.data[self.edges[i]:self.edges[i + 1] - 1].tobytes()

    def lower(self) -> "Slice":
        """A-Z to a-z; every other byte stays."""
        return Slice(self.first, _LOWER[self.data], self.edges)

    def words(self, table: np.ndarray = PLAIN) -> "Words":
        flag = np.zeros(len(self.data) + 2, np.int8)
        flag[1:-1] = table[self.data]
        step = np.diff(flag)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        return Words(self, starts, ends)


class Words:
    """Words of a slice: byte spans, ``first[i]:first[i + 1]`` belongs to row i."""

    def __init__(self, part: Slice, starts: np.ndarray, ends: np.ndarray) -> None:
        self.part, self.starts, self.ends = part, starts, ends
        self.first = np.searchsorted(starts, part.edges)
        self.counts = np.diff(self.first)
        self._hashes: np.ndarray | None = None

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.part.n), self.counts)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = span_hashes(_BYTE[self.part.data], self.starts, self.ends)
        return self._hashes

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of every run of k words inside one row."""
        n = len(self.starts)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(n - k + 1)
        left = np.repeat(self.first[1:], self.counts)[:n - k + 1]
        at = at[at + k <= left]
        return at, span_hashes(self.hashes, at, at + k)


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string array into slices at row borders."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    n = len(text)
    if not n:
        return
    bufs = text.buffers()
    offs = np.frombuffer(bufs[1], np.int64, n + 1, text.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), i + 65536, n)
        rel = offs[i:j + 1] - offs[i]
        edges = rel + np.arange(j - i + 1)
        out = np.full(int(edges[-1]), 10, np.uint8)
        keep = np.ones(len(out), bool)
        keep[edges[1:] - 1] = False
        out[keep] = data[offs[i]:offs[j]]
        yield Slice(i, out, edges)
        i = j


def row_sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of ``values[edges[i]:edges[i + 1]]`` for each row."""
    acc = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=acc[1:])
    return acc[edges[1:]] - acc[edges[:-1]]


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Boolean per position: inside one of the spans ``[s, s + width)``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:n]) > 0


def repeated(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more in its group, equal to an earlier one) per entry."""
    n = len(values)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    key = mix(values + mix(groups.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again, twice = np.zeros(n, bool), np.zeros(n, bool)
    again[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, again
