"""Shingle sets of documents, their MinHash bands and odd sketches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered.  A set holds
the distinct windows of ``k`` words as 64-bit hashes; a shorter text is one shingle, a text
without words has an empty set.

An odd sketch folds the MinHash samples into a parity bitmap: each sample flips one bit.  The
XOR of two bitmaps has few bits where the samples agree, so its population count estimates
high similarities closely: J = 1 + bits / (4 samples) * ln(1 - 2 count / bits).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from palisade.llm.kernel import Words, mix

SHINGLE = 5
BANDS, ROWS = 24, 5
SKETCH_BITS = 512
SEED = 0x5851F42D4C957F2D


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(SEED)) | np.uint64(1)


class Shingles:
    """Distinct shingle hashes of each text of a slice: hashes[first[d]:first[d+1]]."""

    def __init__(self, text: pa.Array, k: int = SHINGLE):
        words = Words(text, lower=True)
        at, h = words.windows(k)
        doc = words.doc[at]
        short = np.flatnonzero((words.counts > 0) & (words.counts < k))
        if len(short):
            h = np.concatenate([h, words.runs(words.first[short], words.first[short + 1])])
            doc = np.concatenate([doc, short])
            order = np.argsort(doc, kind="stable")
            h, doc = h[order], doc[order]
        _, keep = np.unique(mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True)
        keep.sort()
        self.hashes, self.doc = h[keep], doc[keep]
        self.first = np.searchsorted(self.doc, np.arange(len(text) + 1))
        self.sizes = np.diff(self.first)

    def names(self) -> np.ndarray:
        """A 64-bit name of each set, whatever the order of its members; 0 for the empty one."""
        sums = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(mix(self.hashes + np.uint64(SEED)), dtype=np.uint64, out=sums[1:])
        total = sums[self.first[1:]] - sums[self.first[:-1]]
        return np.where(self.sizes > 0, mix(total + self.sizes.astype(np.uint64)), np.uint64(0))

    def signatures(self, samples: int = BANDS * ROWS) -> np.ndarray:
        """The MinHash samples of each set, one row for each non-empty text."""
        starts = self.first[:-1][self.sizes > 0]
        out = np.empty((len(starts), samples), np.uint64)
        if len(starts):
            for i, a in enumerate(multipliers(samples)):
                out[:, i] = np.minimum.reduceat(self.hashes * a, starts)
        return out


def bands(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band: equal where the band's samples are, and different from other bands' keys."""
    n, samples = signatures.shape
    out = np.zeros((n, samples // rows), np.uint64)
    for b in range(samples // rows):
        key = np.full(n, b + 1, np.uint64)
        for i in range(b * rows, (b + 1) * rows):
            key = mix(key * np.uint64(SEED) + signatures[:, i])
        out[:, b] = key
    return out


def odd_sketches(signatures: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps of the samples, as bytes."""
    n, samples = signatures.shape
    parity = np.zeros((n, bits), bool)
    row = np.arange(n)
    for i in range(samples):
        parity[row, (mix(signatures[:, i] + np.uint64(i)) % np.uint64(bits)).astype(np.int64)] ^= True
    return np.packbits(parity, axis=1)


def largest_xor(similarity: float, samples: int, bits: int) -> int:
    """The population count an odd sketch's XOR has at this similarity."""
    return int(np.ceil(bits / 2 * (1 - np.exp(-4 * samples * (1 - similarity) / bits))))
