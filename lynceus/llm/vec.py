"""Whole-batch text primitives on Arrow buffers: words, 64-bit hashes, hash tables.

Every function works on one byte buffer that holds several documents end to end,
so the cost of a document is numpy work per word, not Python work per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
K1, K2, K3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
CHUNK_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space (x20, x09-x0D) delimits.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words made of digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * K2
    x = (x ^ (x >> U64(27))) * K3
    return x ^ (x >> U64(31))


def binary(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and its n + 1 offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of about `limit` bytes and at most `rows` rows: first row, end row, bytes, offsets."""
    buf, off = binary(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + (rows or n))
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 word offsets of the documents."""
    return runs(table[buf], off)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of true places, none beyond a document, and the run offsets of the documents."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    edge = np.zeros(len(inside) + 1, dtype=bool)
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    cut = off[(off > 0) & (off < len(inside))]
    cut = cut[inside[cut] & inside[cut - 1]]  # a run of the next document follows without a gap
    first = edge[:-1] & inside
    first[0] = inside[0]
    first[cut] = True
    last = edge[1:] & inside
    last[-1] = inside[-1]
    last[cut - 1] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off).astype(np.int64)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, read eight at a time."""
    if not len(starts):
        return np.zeros(0, U64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    at = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = (ends - starts).astype(np.int64)
    h = (left.astype(U64) + U64(seed)) * K1
    full = U64(0xFFFFFFFFFFFFFFFF)
    keep = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [int(full)], dtype=U64)
    block = at[starts] & keep[np.minimum(left, 8)]
    h = mix(h ^ block)
    more = np.flatnonzero(left > 8)
    pos = 8
    while len(more):
        rest = left[more] - pos
        block = at[starts[more] + pos] & keep[np.minimum(rest, 8)]
        h[more] = mix((h[more] + K1) ^ block)
        pos += 8
        more = more[rest > 8]
    return h


def run_ids(ptr: np.ndarray) -> np.ndarray:
    """The document index of each item, from item offsets."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k hashes from each place on; the last k - 1 places have no meaning."""
    out = np.zeros(len(h), U64)
    for j in range(k):
        n = len(h) - j
        if n <= 0:
            break
        out[:n] = out[:n] * K1 + h[j:]
    return mix(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def counted(x: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often (or with what total weight) each occurs."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    if weight is None:
        x = np.sort(x)
        at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        return x[at], np.diff(np.r_[at, len(x)])
    order = np.argsort(x, kind="stable")
    x, weight = x[order], weight[order]
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return x[at], np.add.reduceat(weight, at)


class HashIndex:
    """Distinct non-zero 64-bit keys to their row numbers: linear probing, filled and read in bulk."""

    def __init__(self, keys: np.ndarray):
        self.size = 0
        self._room(len(keys))
        self.add(keys)

    def _room(self, n: int) -> None:
        bits = max(10, int(np.ceil(np.log2(max(1, n) * 2.2))))
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, U64)
        self.rows = np.zeros(1 << bits, np.int32)

    def add(self, keys: np.ndarray) -> None:
        """Give new keys the next row numbers, in their order."""
        if (self.size + len(keys)) * 2 > self.mask:
            used = self.keys != 0
            old, rows = self.keys[used], self.rows[used]
            self._room(2 * (self.size + len(keys)))
            self._put(old, rows)
        self._put(keys, np.arange(self.size, self.size + len(keys), dtype=np.int32))
        self.size += len(keys)

    def _put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot] == 0
            s, who = slot[free], left[free]
            self.keys[s] = keys[who]  # of rivals for a slot one wins; the others find it taken
            won = self.keys[s] == keys[who]
            self.rows[s[won]] = rows[who[won]]
            lost = np.r_[np.flatnonzero(~free), np.flatnonzero(free)[~won]]
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * K1) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, or -1."""
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.rows[slot], -1)
        todo = np.flatnonzero((got != keys) & (got != 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            got = self.keys[slot]
            want = keys[todo]
            hit = got == want
            out[todo[hit]] = self.rows[slot[hit]]
            on = ~hit & (got != 0)
            todo, slot = todo[on], slot[on]
        return out
