"""Byte-level BPE: texts to token ids and back, with a hierarchical-bitmap rank queue.

Pre-tokens are found by the transducer of ``token_transducer``, for a whole slice of texts at
once.  A pre-token is a linked list of its parts.  Positions whose pair makes a token wait in the
bucket of that token's rank, those of all new pre-tokens of a slice in one queue; a bitmap has a bit for every rank whose bucket isn't empty, a second
one a bit for every word of the first, and so on up to one word.  Finding the first set bit from
the top down gives the next rank in as many steps as there are levels, whatever the number of
pairs, and its bucket's positions merge from left to right.  Entries that no longer tell what stands at their place
are stale and skipped.  A pre-token of n bytes takes n log n time at most, and about 30 bytes a byte.

A pre-token's ids are kept in a table of bounded size, so that a frequent one is merged once;
it is found there by a 64-bit hash, and what was found is checked: the ids are decoded again and
compared with the texts' own bytes, and a slice in which they differ is encoded without the table.

Defined results: a null text is an empty one and has no ids.  Strings of special tokens are
ordinary text.  Bytes that are no UTF-8 are encoded as U+FFFD.  Null, equal and repeated doc_ids
and repeated rows are encoded row by row; a text is never cut; empty tables give no rows; other
columns pass where carried and else are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from palisade.llm.kernel import buffers, hashes, slices, vocabulary
from palisade.llm.token_transducer import BACK, END, HERE, classes, emissions

#: Pre-tokens whose ids a worker remembers at most.
TABLE_ROWS = 1 << 19
NONE = 0x7FFFFFFF


class RankQueue:
    """Positions in buckets by rank; ``pop`` gives the least rank and the positions in its bucket, in order.

    The positions known at the start are one array, sorted by rank: a bucket is a stretch of it,
    and a list of what merges have added since.
    """

    def __init__(self, ranks: int):
        self.levels: list[list[int]] = []
        while True:
            ranks = -(-ranks // 64)
            self.levels.append([0] * ranks)
            if ranks == 1:
                break
        self.start: dict[int, tuple[int, int]] = {}
        self.later: dict[int, list[int]] = {}

    def fill(self, ranks: np.ndarray) -> None:
        """Start with these ranks of positions 0, 1, ...; NONE for a pair that makes no token."""
        at = np.flatnonzero(ranks != NONE)
        self.order = at[np.argsort(ranks[at], kind="stable")]
        of = ranks[self.order]
        edges = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else of
        for rank, a, b in zip(of[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(of)]):
            self.start[rank] = a, b
            self._mark(rank)

    def _mark(self, rank: int) -> None:
        for words in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            before = words[word]
            words[word] = before | bit
            if before:
                return
            rank = word

    def _clear(self, rank: int) -> None:
        for words in self.levels:
            word = rank >> 6
            words[word] &= ~(1 << (rank & 63))
            if words[word]:
                return
            rank = word

    def push(self, rank: int, at: list[int]) -> None:
        bucket = self.later.get(rank)
        if bucket is None:
            self.later[rank] = at
            self._mark(rank)
        else:
            bucket += at

    def pop(self) -> tuple[int, list[int]] | None:
        if not self.levels[-1][0]:
            return None
        rank = 0
        for words in reversed(self.levels):
            word = words[rank]
            rank = rank << 6 | (word & -word).bit_length() - 1
        self._clear(rank)
        at = self.later.pop(rank, [])
        stretch = self.start.pop(rank, None)
        if stretch:
            at += self.order[stretch[0] : stretch[1]].tolist()
        if len(at) > 1:
            at.sort()
        return rank, at


class BytePairs:
    """A vocabulary of ranked byte strings: encodes and decodes many texts at once."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in rows}
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError(f"{path}: no token for the bytes {missing[:5]}")
        top = max(self.rank.values()) + 1
        self.longest = max(map(len, self.rank))
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.pairs = np.full((256, 256), NONE, np.int64)
        tokens = [b""] * top
        for token, rank in self.rank.items():
            tokens[rank] = token
            if len(token) == 2:
                self.pairs[token[0], token[1]] = rank
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_ends = np.cumsum([len(t) for t in tokens])
        self.token_sizes = np.array([len(t) for t in tokens])
        self.queue = RankQueue(top)
        self._forget()

    def _forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.edges = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pre-tokens in a row, and how many each has.

        They share one queue: a rank's bucket holds its places in all of them.  As no pair spans
        two pre-tokens, each is merged in its own order, the least rank first and of equal ones
        the leftmost; where a merge makes a pair of lower rank, that one goes first.
        """
        raw = b"".join(pieces)
        data, n = np.frombuffer(raw, np.uint8), len(raw)
        ends = np.cumsum([len(p) for p in pieces])
        first = np.full(n, NONE, np.int64)
        first[:-1] = self.pairs[data[:-1], data[1:]]
        first[ends - 1] = NONE
        edge = bytearray(n + 1)
        for end in [0, *ends.tolist()]:
            edge[end] = 1
        # Parts begin where ``gone`` is 0 and end where the next one begins; pair: the rank of a part and the next one.
        plain = (lambda a: a.tolist()) if n < 1 << 22 else memoryview
        pair, ids, after, before, gone = plain(first.copy()), plain(self.single[data]), plain(np.arange(1, n + 1)), plain(np.arange(-1, n - 1)), bytearray(n)
        look, longest, queue = self.rank.get, self.longest, self.queue
        queue.fill(first)
        later, push = queue.later, queue.push
        while (least := queue.pop()) is not None:
            rank, places = least
            for k, at in enumerate(places):
                if pair[at] != rank:
                    continue
                middle = after[at]
                end = after[middle]
                after[at], ids[at], pair[middle], gone[middle], lowest = end, rank, NONE, 1, NONE
                found = NONE
                if not edge[end]:
                    before[end] = at
                    stop = after[end]
                    if stop - at <= longest:
                        found = look(raw[at:stop], NONE)
                pair[at] = found
                if found != NONE:
                    lowest = found
                    if found in later:
                        later[found].append(at)
                    else:
                        push(found, [at])
                if not edge[at]:
                    left = before[at]
                    found = look(raw[left:end], NONE) if end - left <= longest else NONE
                    pair[left] = found
                    if found != NONE:
                        lowest = min(lowest, found)
                        if found in later:
                            later[found].append(left)
                        else:
                            push(found, [left])
                if lowest < rank:
                    if rest := places[k + 1 :]:
                        push(rank, rest)
                    break
        parts = np.flatnonzero(np.frombuffer(gone, np.uint8) == 0)
        return np.array(ids, np.int64)[parts], np.diff(np.searchsorted(parts, ends), prepend=0)

    def _whole_or_merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers: a pre-token that is a token is that one."""
        whole = np.array([self.rank.get(p, -1) for p in pieces], np.int64)
        cut = whole < 0
        counts = np.ones(len(pieces), np.int64)
        if not cut.any():
            return whole, counts
        merged, counts[cut] = self.merge([p for p, c in zip(pieces, cut.tolist()) if c])
        ids = np.empty(counts.sum(), np.int64)
        many = np.repeat(cut, counts)
        ids[many], ids[~many] = merged, whole[~cut]
        return ids, counts

    def pretokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pre-tokens of many texts begin and end, in bytes."""
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        leads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        kinds = np.insert(classes()[codes], np.searchsorted(leads[:-1], offsets[1:]), END)
        emit = emissions(kinds)
        begin = (emit & HERE) > 0
        begin[:-1] |= (emit[1:] & BACK) > 0
        marks = np.flatnonzero(begin)
        stop = kinds == END
        at = leads[marks - (np.cumsum(stop)[marks] - stop[marks])]
        word = ~stop[marks]
        return at[word], np.append(at[1:], len(data))[word]

    def _table(self, names: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of the ids of each pre-token in ``flat``."""
        found, where, inverse = np.unique(names, return_index=True, return_inverse=True)
        if len(self.known) and len(self.known) + len(found) > TABLE_ROWS:
            self._forget()
        at = np.searchsorted(self.known, found)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == found[hit]
        miss = np.flatnonzero(~hit)
        if len(miss):
            raw, count = data.tobytes(), len(self.edges) - 1
            ids, counts = self._whole_or_merged([raw[a:b] for a, b in zip(starts[where[miss]].tolist(), ends[where[miss]].tolist())])
            self.flat = np.concatenate([self.flat, ids])
            self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(counts)])
            self.known = np.insert(self.known, at[miss], found[miss])
            self.place = np.insert(self.place, at[miss], np.arange(count, count + len(miss)))
        of = self.place[np.searchsorted(self.known, found)][inverse]
        return self.edges[of], self.edges[of + 1] - self.edges[of]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (and the last one's end)."""
        data, offsets = buffers(column)
        try:
            data.tobytes().decode("utf-8")
        except UnicodeDecodeError:
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            data, offsets = buffers(pa.array(texts, pa.large_string()))
        starts, ends = self.pretokens(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        first, counts = self._table(hashes(data, starts, ends), data, starts, ends)
        stops = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(counts, out=stops[1:])
        ids = self.flat[np.repeat(first - stops[:-1], counts) + np.arange(stops[-1])]
        edges = stops[np.searchsorted(starts, offsets)]
        back, back_edges = self.decode(ids, edges)
        if np.array_equal(back_edges, offsets) and np.array_equal(back, data):
            return ids, edges
        # Two pre-tokens shared a hash.
        ids, counts = self._whole_or_merged([data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())])
        stops[1:] = np.cumsum(counts)
        return ids, stops[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts in a row, and where each text's begin (and the last one's end)."""
        sizes = self.token_sizes[ids]
        stops = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=stops[1:])
        first = self.token_ends[ids] - sizes
        return self.token_bytes[np.repeat(first - stops[:-1], sizes) + np.arange(stops[-1])], stops[edges]


@functools.cache
def coder(name: str) -> BytePairs:
    return BytePairs(vocabulary(name))


def _columns(docs: DataFrame, carry: tuple[str, ...], *exprs: str) -> tuple[DataFrame, str]:
    rows = docs.selectExpr(*exprs, *[f"`{c}`" for c in carry])
    return rows, "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)


def encode_texts(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and ids (array<int>) of every row, and the columns to carry.  One narrow stage: nothing is shuffled."""
    rows, carried = _columns(docs, carry, f"`{id_col}` AS doc_id", f"`{text_col}` AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids, edges = coder(ranks).encode(part.column(1))
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, *part.columns[2:]], names=["doc_id", "ids", *carry])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>{carried}")


def decode_ids(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and data (the bytes) of every row of ids; null ids are none."""
    rows, _ = _columns(encoded, (), f"`{id_col}` AS doc_id", f"coalesce(`{ids_col}`, array()) AS ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            edges = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
            data, ends = coder(ranks).decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), edges)
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "data"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256 (the bytes the ids decode to) of every row."""
    rows, _ = _columns(docs, (), f"`{id_col}` AS doc_id", f"`{text_col}` AS text")

    def digests(values: np.ndarray, edges: np.ndarray) -> list[str]:
        raw, width = memoryview(values.tobytes()), values.itemsize
        return [hashlib.sha256(raw[a * width : b * width]).hexdigest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids, edges = coder(ranks).encode(part.column(1))
            data, ends = coder(ranks).decode(ids, edges)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(edges), pa.int64()), pa.array(digests(ids.astype("<u4"), edges)), pa.array(digests(data, ends))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), "byte_bpe_50k.tiktoken")
