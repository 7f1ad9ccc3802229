"""Packing token sequences into fixed windows: best-fit decreasing.

A document's ids are the tokenizer's (add_special_tokens=False) and an end id.  Overlong
documents are first cut into full windows, which fill a sequence each; what remains is
packed best-fit decreasing: a segment tree over remaining capacities finds the tightest
open window for each piece in O(log capacity), longest piece first.

Pieces carry only numbers, and are dealt by hash into bins of about ``bin_rows`` pieces;
each bin packs by itself, so a task's work is bounded and a repeated task gives the same
sequences.  A bin wastes at most its last windows.  ``sequence_id`` is local number times
bins plus bin, so it is unique and almost gapless.

Tokenising: texts are cut where the tokenizer cuts whatever stands around (at white space,
around ASCII digits, between ASCII letters and signs), and each distinct word goes through the
library once a worker while its cache has room.  Slices with a special string are cut at white
space only.  Words meet by a 64-bit hash within a slice of about 1 MB.

Defined results: a null or empty text is the end id alone (length 1); equal rows are packed
separately; null doc_ids are kept; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.kernel import LOWER, Words, buffers, hashes, slices, vocabulary
from palisade.session import materialise

WINDOW = 4096
END_ID = 2
BIN_ROWS = 50_000
#: Words whose ids a worker remembers at most.
CACHE_WORDS = 800_000
DIGITS = re.compile(rb"[0-9]")
#: Settings of the tokenizer for which texts may be cut as ``units`` does (fixed values of its file).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {
    "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True,
}
#: Kinds of bytes: white space, ASCII letters, digits, apostrophe, other ASCII, beyond ASCII.
KIND = np.full(256, 4, np.uint8)
KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
KIND[65:91] = KIND[97:123] = 1
KIND[48:58] = 2
KIND[39] = 3
KIND[128:] = 5
#: Where the tokenizer's pattern always cuts, by the kinds of neighbouring bytes: at white space,
#: around each digit, and between letters and other signs; an apostrophe may belong to the letters after it.
CUTS = np.zeros((6, 6), bool)
CUTS[0, :] = CUTS[:, 0] = True
CUTS[2, 1:5] = CUTS[1:5, 2] = True
CUTS[1, 3:5] = CUTS[4, 1] = True


class CapacityTree:
    """Open windows by remaining capacity; finds the least capacity of at least n."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.live = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        at = capacity + self.size
        while at and not self.live[at]:
            self.live[at] = 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest window with room for ``least``: (capacity, sequence), removed."""
        live, at = self.live, least + self.size
        if not live[at]:
            while True:
                if at & (at + 1) == 0:  # rightmost of its level: nothing above
                    return None
                if not at & 1 and live[at + 1]:
                    at += 1
                    break
                at >>= 1
            while at < self.size:
                at = 2 * at if live[2 * at] else 2 * at + 1
        capacity = at - self.size
        sequence = self.open[capacity].pop()
        if not self.open[capacity]:
            live[at] = 0
            at >>= 1
            while at and not (live[2 * at] or live[2 * at + 1]):
                live[at] = 0
                at >>= 1
        return capacity, sequence


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces must come longest first."""
    tree, made = CapacityTree(window), 0
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        found = tree.take(n)
        if found is None:
            found, made = (window, made), made + 1
        room, s = found
        sequence[i], offset[i] = s, window - room
        if room > n:
            tree.add(room - n, s)
    return sequence, offset


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches that the tokenizer encodes one by one, white space left out."""
    kind = KIND[data]
    word = kind != 0
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:-1] |= CUTS[kind[:-1], kind[1:]]
    starts = np.flatnonzero(word & cut[:-1])
    ends = np.flatnonzero(word & cut[1:]) + 1
    return starts, ends


class Encoder:
    """Token ids of many texts at once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        #: Whether texts may be cut into words here; those of any other tokenizer go through the library whole.
        self.cuts = spec.get("normalizer") == NORMALIZER and (spec.get("pre_tokenizer") or {}).get("pretokenizers", [None])[0] == SPLIT
        zero = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.zero = zero[0] if len(zero) == 1 else None
        self.cuts = self.cuts and self.zero is not None
        self.cache: dict[bytes, bytes] = {}

    def _learn(self, need: list[bytes]) -> None:
        """Puts the ids of all these words into the cache."""
        missing = [w for w in need if w not in self.cache]
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.cache.clear()
            missing = need
        # Between words without digits a digit is a token of its own: many words make one text.
        plain = [w for w in missing if not DIGITS.search(w)]
        odd = [w for w in missing if DIGITS.search(w)]
        for at in range(0, len(plain), 1000):
            part = plain[at : at + 1000]
            (found,) = self.tokenizer.encode_batch_fast([b"0".join(part).decode()], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            places = (4 * np.flatnonzero(ids == self.zero)).tolist()
            body = ids.tobytes()
            self.cache.update((w, body[a:b]) for w, a, b in zip(part, [0, *(x + 4 for x in places)], [*places, len(body)], strict=True))
        for at in range(0, len(odd), 20_000):
            part = odd[at : at + 20_000]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.cache.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, found))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offsets of each text's ids in them."""
        data, offsets = buffers(texts)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        if not self.cuts:
            found = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            sizes = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(e.ids) for e in found], out=sizes[1:])
            return np.concatenate([np.array(e.ids, "<u4") for e in found]), sizes
        whole = data.tobytes()
        if any(s in whole for s in self.special):
            words = Words(texts)
            starts, ends = words.starts, words.ends
        else:
            # Not before a byte beyond ASCII: a capital may compose with the mark that follows it.
            data = np.where(np.append(data[1:], 0) < 0x80, LOWER[data], data).astype(np.uint8)
            whole = data.tobytes()
            starts, ends = units(data, offsets)
        found = pa.array(hashes(data, starts, ends)).dictionary_encode()
        which = found.indices.to_numpy()
        first = np.empty(len(found.dictionary), np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        distinct = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        self._learn(distinct)
        ids = [self.cache[w] for w in distinct]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), "<u4")
        begin = np.cumsum(sizes) - sizes
        length = sizes[which]
        after = np.zeros(len(which) + 1, np.int64)
        np.cumsum(length, out=after[1:])
        take = np.repeat(begin[which] - after[:-1], length)
        take += np.arange(len(take))
        return flat[take], after[np.searchsorted(starts, offsets)]


@functools.cache
def encoder(tokenizer: str) -> Encoder:
    return Encoder(vocabulary(tokenizer))


def cut_documents(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * window
        for part in slices(batches, "text"):
            row, start, length, crc, total, ids = [], [], [], [], [], []
            found, offsets = encode(part.column(1))
            body, bounds = found.tobytes(), (4 * offsets).tolist()
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                for at in range(0, b - a + 4, step):
                    piece = body[a + at : min(b, a + at + step)]
                    if a + at + step > b:
                        piece += end
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append((b - a) // 4 + 1)
                    if with_ids:
                        ids.append(piece)
            columns = [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    bin_rows: int = BIN_ROWS,
    with_ids: bool = False,
) -> DataFrame:
    """Every piece with its sequence and offset there; the token ids too where asked for.

    ``tokenizer``: a path that every worker has, or the bare name of an installed vocabulary.
    """
    pieces = materialise(cut_documents(docs, tokenizer, window, end_id, id_col, text_col, with_ids), "pieces")
    bins = max(1, -(-pieces.count() // bin_rows))
    # By place in the written table too, so that equal rows are dealt out; a part's number is the same in a rerun.
    part = F.regexp_extract("_metadata.file_name", "^part-([0-9]+)", 1)
    dealt = pieces.select("*", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", part, F.col("_metadata.row_index")), F.lit(bins)).alias("bin"))
    names = [f.name for f in pieces.schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = best_fit_decreasing(table.column("length").to_numpy(), window)
        sequence = sequence * bins + table.column("bin").to_numpy()
        return table.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("bin").applyInArrow(fill, f"{schema}, sequence_id long, offset long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), "word_bpe_49k.json")
