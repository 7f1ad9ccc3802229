"""Vectorised text primitives shared by the operators of this subpackage.

Texts arrive as Arrow string columns.  Everything here works on the UTF-8 bytes of
many texts at once, so no Python object is made per word.  A null text is an empty one.
Batches are cut into slices of bounded bytes; a single text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Odd multipliers, so that each has an inverse modulo 2**64.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and those of its inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 64)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        have = (made[0], made[1])
        if size <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them, from 0."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)
    o = o[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def vocabulary(name: str) -> str:
    """Where a tokenizer's file is on this machine: a path as it is, a bare name by the installed tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice has about ``limit`` bytes of the column, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes."""
    p, q = powers(BYTE_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], dtype=np.uint64, out=total[1:])
    h = (total[ends] - total[starts]) * q[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(WORD_BASE))


class Words:
    """The words of many texts: maximal runs of bytes for which ``kind`` holds.

    starts, ends: byte positions; first[d] .. first[d+1]: the words of text d;
    doc: the text of each word.
    """

    def __init__(self, column: pa.Array, kind: np.ndarray = NOT_SPACE, lower: bool = False):
        self.data, self.offsets = buffers(column)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        word = kind[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        before[:1], before[1:] = False, word[:-1]
        after[-1:], after[:-1] = False, word[1:]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.n = len(self.starts)
        self._doc = self._hash = self._sums = None

    @property
    def doc(self) -> np.ndarray:
        if self._doc is None:
            self._doc = np.repeat(np.arange(len(self.counts)), self.counts)
        return self._doc

    @property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if self._hash is None:
            self._hash = hashes(self.data, self.starts, self.ends)
        return self._hash

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each run of words, from word ``starts`` to before word ``ends``."""
        p, q = powers(WORD_BASE, self.n + 1)
        if self._sums is None:
            self._sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(self.hashes * p[: self.n], dtype=np.uint64, out=self._sums[1:])
        h = (self._sums[ends] - self._sums[starts]) * q[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(BYTE_BASE))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of k words that lies in one text."""
        if self.n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(self.n - k + 1)
        at = at[self.doc[at] == self.doc[at + k - 1]]
        return at, self.runs(at, at + k)

    def text(self, word: int) -> bytes:
        return self.data[self.starts[word] : self.ends[word]].tobytes()
