"""Token counts by a compiled finite-state transducer.

The tokenizer's pre-tokenisation pattern is compiled into a deterministic transducer over
character classes.  A transition may close a pre-token (before the current character, or
before the one before it); its output is then the number of tokens that pre-token emits,
which a lazily filled table gives for each closed byte string, by the tokenizer's merges.

A text's characters are cut into chunks.  A chunk is a map from entry state to exit state;
maps compose associatively, and a parallel prefix scan over them gives each chunk its true
entry state, after which all chunks run side by side and emit.  So one very long text uses
the same lanes as many short ones.

Counts equal the library's with add_special_tokens=False.  Special strings in a text are
tokens of their own (the library's default).  Null and empty texts have 0 tokens and 0 bytes;
null and repeated doc_ids and repeated rows are counted row by row; empty tables give none;
other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from palisade.llm.kernel import buffers, mix, powers, slices, vocabulary

LIMIT = 1024
CHUNK = 512
#: Pre-tokens whose counts a worker remembers at most.
TABLE_ROWS = 1 << 20
CODE_BASE = 0xA0761D6478BD642F

# Character classes.  The letters of contractions have their own.
END, SP, WS, LETTER, NUMBER, OTHER, QUOTE = range(7)
CONTRACTION = "strevmld"
CLASS_OF = {c: 7 + i for i, c in enumerate(CONTRACTION)}
CLASSES = 7 + len(CONTRACTION)
#: Unicode White_Space (fixed values of the standard).
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# States: what the open pre-token is.
STATES = ("start", "letters", "numbers", "others", "space", "white", "spaces", "whites", "quote", "quote_r", "quote_v", "quote_l", "contraction")
S = {name: i for i, name in enumerate(STATES)}
HERE, BACK = 1, 2  # a pre-token begins at this character; at the one before


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE] = WS
    out[32] = SP
    out[ord("'")] = QUOTE
    for c, k in CLASS_OF.items():
        out[ord(c)] = k
    return out


@functools.cache
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission, indexed by state * CLASSES + class."""

    def opened(c: int, after_space: bool = False) -> int:
        if c == END:
            return S["start"]
        if c == SP:
            return S["space"]
        if c == WS:
            return S["white"]
        if c == NUMBER:
            return S["numbers"]
        if c == QUOTE and not after_space:
            return S["quote"]
        return S["others"] if c in (OTHER, QUOTE) else S["letters"]

    def step(state: str, c: int) -> tuple[int, int]:
        letter, blank = c == LETTER or c >= 7, c in (SP, WS)
        new = (opened(c), HERE)
        if c == END:
            return S["start"], HERE | (BACK if state in ("quote_r", "quote_v", "quote_l") else 0)
        if state == "letters" and letter or state == "numbers" and c == NUMBER or state == "others" and c in (OTHER, QUOTE):
            return S[state], 0
        if state in ("space", "white", "spaces", "whites"):
            if blank:
                return S["spaces" if c == SP else "whites"], 0
            if state == "space":
                return opened(c, True), 0
            if state == "spaces":
                return opened(c, True), BACK
            return new if state == "white" else (opened(c), HERE | BACK)
        if state == "quote":
            if c in (OTHER, QUOTE):
                return S["others"], 0
            if c >= 7 and CONTRACTION[c - 7] in "stmd":
                return S["contraction"], 0
            if c >= 7 and CONTRACTION[c - 7] in "rvl":
                return S["quote_" + CONTRACTION[c - 7]], 0
            return new
        if state in ("quote_r", "quote_v", "quote_l"):
            if c >= 7 and CONTRACTION[c - 7] == ("l" if state == "quote_l" else "e"):
                return S["contraction"], 0
            # No contraction: the quote stood alone, and its letter opened a run.
            return (S["letters"], BACK) if letter else (opened(c), HERE | BACK)
        return new

    table = [step(state, c) for state in STATES for c in range(CLASSES)]
    return np.array([t[0] for t in table], np.uint8), np.array([t[1] for t in table], np.uint8)


def emissions(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Run the transducer over a class stream: what each transition emits."""
    nxt, emit = transducer()
    n = len(kinds)
    lanes = max(1, -(-n // chunk))
    grid = np.zeros(lanes * chunk, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(lanes, chunk).T)
    # State maps: every entry state of every chunk, side by side.
    maps = np.repeat(np.arange(len(STATES), dtype=np.int16)[:, None], lanes, 1)
    wide, width = nxt.astype(np.int16), np.int16(CLASSES)
    for row in grid:
        maps = wide[maps * width + row]
    # Prefix scan by doubling: after it, maps[:, i] carries chunks 0..i.
    gap = 1
    while gap < lanes:
        composed = maps.copy()
        composed[:, gap:] = np.take_along_axis(maps[:, gap:], maps[:, :-gap].astype(np.int64), axis=0)
        maps, gap = composed, gap * 2
    state = np.zeros(lanes, np.int16)
    state[1:] = maps[S["start"], :-1]
    out = np.empty((chunk, lanes), np.uint8)
    for i, row in enumerate(grid):
        at = state * width + row
        out[i] = emit[at]
        state = wide[at]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Counts the tokens of one pre-token by ranked merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # What the transducer is compiled for; another tokenizer would be counted wrongly without a word.
        rules = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or rules.get("type") != "ByteLevel" or rules.get("add_prefix_space") or not rules.get("use_regex", True):
            raise ValueError(f"{path}: not a byte-level tokenizer with the usual pattern")
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        symbols = byte_symbols()
        self.byte_id = [0] * 256
        for s, b in symbols.items():
            self.byte_id[b] = vocab[s]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])

    def count(self, word: bytes) -> int:
        ids = [self.byte_id[b] for b in word]
        if len(ids) > 48:
            return self._count_long(ids)
        rank = self.rank
        while len(ids) > 1:
            best = None
            for pair in zip(ids, ids[1:]):
                found = rank.get(pair)
                if found and (best is None or found < best[0]):
                    best = found, pair
            if best is None:
                break
            (_, new), (a, b) = best
            merged, i = [], 0
            while i < len(ids):
                if ids[i] == a and i + 1 < len(ids) and ids[i + 1] == b:
                    merged.append(new)
                    i += 2
                else:
                    merged.append(ids[i])
                    i += 1
            ids = merged
        return len(ids)

    def _count_long(self, ids: list[int]) -> int:
        """The same with a heap: n log n for pre-tokens of any length."""
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(f[0], i, ids[i], ids[i + 1], f[1]) for i in range(n - 1) if (f := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if f := rank.get((new, ids[k])):
                    heapq.heappush(heap, (f[0], i, new, ids[k], f[1]))
            if (h := before[i]) >= 0 and (f := rank.get((ids[h], new))):
                heapq.heappush(heap, (f[0], h, ids[h], new, f[1]))
        return left


class Counter:
    """The compiled tokenizer: counts tokens of many texts at once."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.known = np.zeros(0, np.uint64)
        self.value = np.zeros(0, np.int32)

    def _counts(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, found)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == found[hit]
        value = np.empty(len(found), np.int32)
        value[hit] = self.value[at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            count = self.merges.count
            spans = zip(starts[where[miss]].tolist(), ends[where[miss]].tolist())
            value[miss] = [count(codes[a:b].tobytes().decode("utf-32-le").encode()) for a, b in spans]
            if len(self.known) + len(miss) > TABLE_ROWS:
                self.known, self.value = found, value.copy()
            else:
                self.known = np.insert(self.known, at[miss], found[miss])
                self.value = np.insert(self.value, at[miss], value[miss])
        return value[inverse]

    def _plain(self, column: pa.Array) -> np.ndarray:
        data, offsets = buffers(column)
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        leads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
        at = leads[offsets]
        kinds = np.insert(classes()[codes], at[1:], END)
        codes = np.insert(codes, at[1:], 0)
        emit = emissions(kinds)
        begin = (emit & HERE) > 0
        begin[:-1] |= (emit[1:] & BACK) > 0
        marks = np.flatnonzero(begin)
        word = kinds[marks] != END
        starts, ends = marks[word], np.append(marks[1:], len(kinds))[word]
        p, q = powers(CODE_BASE, len(codes) + 1)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * p[: len(codes)], dtype=np.uint64, out=total[1:])
        hashes = mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))
        sums = np.zeros(len(starts) + 1, np.int64)
        if len(starts):
            np.cumsum(self._counts(hashes, codes, starts, ends), out=sums[1:])
        stops = np.searchsorted(starts, at[1:] + np.arange(1, len(at)))
        return np.diff(sums[stops], prepend=0)

    def __call__(self, column: pa.Array) -> np.ndarray:
        column = column.fill_null("") if column.null_count else column
        special = None
        for s in self.merges.special:
            has = pc.match_substring(column, s)
            special = has if special is None else pc.or_(special, has)
        if special is None or not pc.any(special).as_py():
            return self._plain(column)
        # Texts that hold special strings: each such string is one token, and parts the text.
        parts, owner, extra = [], [], np.zeros(len(column), np.int64)
        for i, text in enumerate(column.to_pylist()):
            pieces = [text]
            for s in self.merges.special:
                pieces = [x for piece in pieces for x in piece.split(s)]
                extra[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        counts = self._plain(pa.array(parts, pa.large_string()))
        return extra + np.bincount(np.array(owner), counts, len(column)).astype(np.int64)


@functools.cache
def counter(tokenizer: str) -> Counter:
    return Counter(vocabulary(tokenizer))


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row.  One narrow stage: nothing is shuffled.

    ``tokenizer``: a path that every worker has, or the bare name of an installed vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for part in slices(batches, "text"):
            _, offsets = buffers(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(count(part.column(1)), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = count_tokens(docs, "byte_bpe_50k.json")
    return counted.selectExpr("*", f"n_tokens > {LIMIT} AS over_limit")
