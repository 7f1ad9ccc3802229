"""Substring dedup: removing words covered by a window of words that stands earlier too.

Suffix automata of reference shards give each passage its matching statistics: at each word,
how many words up to it stand in the reference.  Where that reaches ``WINDOW``, the window
goes.  Every document is reference for all later ones, so automata of whole documents could
neither be broadcast (together they are larger than the corpus) nor streamed past by every
document (work quadratic in the corpus).  So the shards are made of what can repeat, and a
passage visits the one shard that can hold it:

1. Each window of ``WINDOW`` words is represented by the least hash among its shorter grams.
   Neighbouring windows share it, so a document has one value for each run of windows
   (about 2 in 17 words).  Equal windows have equal values: a window whose value belongs to
   one run only stands nowhere else.  Values are counted with partial aggregation.
2. Runs that share a value are a reference shard of at most ``SHARD`` runs (each of at most
   2 * WINDOW - GRAM words).  Its runs come sorted by place (doc_id, then start) and stream
   past the shard's automaton, which then takes them in: what it holds is always what stands
   earlier.  Words are compared as they are; hashes only bring runs together.
3. A value with more runs (a passage in a third of all documents) mostly has the same ones
   again and again, and of equal runs only the earliest can hold a window's first place.  So
   each task keeps one of equal runs, Spark the earliest of all, told by 128 bits of hashes,
   and what is left is a shard as in 2.  Where more than ``SHARD`` different runs are left,
   their windows go by 128-bit names, and each name keeps its earliest place.
4. Each document gets the windows where it is the earliest; all its other windows in repeated
   runs stand earlier too, and their words go.

Rows with equal texts are settled first: all but the earliest lose every window.

Defined results: null and empty texts have no words; order is by doc_id (an integer) with
null first; rows that repeat doc_id and text are one document, with one result; a doc_id with
different texts is ordered by a hash of the text; documents under ``WINDOW`` words lose
nothing; empty tables give none; other columns are ignored.  Equal texts are told by 128 bits
of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.kernel import Words, mix, slices
from palisade.session import discard, materialise, release

WINDOW = 20
GRAM = 5
#: Runs that one automaton may hold: at most 35,000 words, some tens of MB.
SHARD = 1000
#: Joins on a value or a text deal each key to this many tasks.
SALTS = 8
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
NOTHING = hashlib.sha256(b"").hexdigest()
#: A document's place among all, as one number: doc_id, then 62 bits of its text's hash.
PLACE = f"CAST(coalesce(doc_id, -9223372036854775808) AS DECIMAL(20,0)) * CAST({1 << 62} AS DECIMAL(19,0)) + CAST(tie AS DECIMAL(19,0))"


class SuffixAutomaton:
    """The suffix automaton of the word sequences it has taken in."""

    def __init__(self) -> None:
        self.go: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, go: dict) -> int:
        self.go.append(go)
        self.link.append(0)
        self.length.append(length)
        return len(self.go) - 1

    def _suited(self, parent: int, word: object) -> int:
        """The state ``word`` leads to from ``parent``, split off where longer sequences share it."""
        found = self.go[parent][word]
        if self.length[found] == self.length[parent] + 1:
            return found
        split = self._state(self.length[parent] + 1, dict(self.go[found]))
        self.link[split], self.link[found] = self.link[found], split
        while parent >= 0 and self.go[parent].get(word) == found:
            self.go[parent][word] = split
            parent = self.link[parent]
        return split

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            if word in self.go[last]:
                last = self._suited(last, word)
                continue
            new = self._state(self.length[last] + 1, {})
            parent = last
            while parent >= 0 and word not in self.go[parent]:
                self.go[parent][word] = new
                parent = self.link[parent]
            if parent >= 0:
                self.link[new] = self._suited(parent, word)
            last = new

    def statistics(self, words: list) -> list[int]:
        """At each word, how many words up to it stand in a sequence taken in."""
        out, state, held = [], 0, 0
        go, link, length = self.go, self.link, self.length
        for word in words:
            while word not in go[state] and state:
                state = link[state]
                held = length[state]
            if word in go[state]:
                state = go[state][word]
                held += 1
            out.append(held)
        return out


def least_hashes(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, least gram hash, and first gram's hash of each window that lies in one text."""
    at, h = words.windows(gram)
    least = np.full(words.n, NONE)
    least[at] = h
    own = least.copy()
    width, want = 1, window - gram + 1
    while width < want:
        step = min(width, want - width)
        least[:-step] = np.minimum(least[:-step], least[step:])
        width += step
    first = np.arange(max(words.n - window + 1, 0))
    first = first[words.doc[first] == words.doc[first + window - 1]] if len(first) else first
    return first, least[first], own[first]


def window_runs(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, value, first and last window of each run of windows with one least gram in one place."""
    first, value, own = least_hashes(words, window, gram)
    if not len(first):
        return first, value, first, first
    doc = words.doc[first]
    # A run ends where the least hash changes, or goes on at a later gram (a text that repeats itself).
    edge = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | np.concatenate([[True], (value[1:] != value[:-1]) | (own[:-1] == value[:-1])]))
    return doc[edge], value[edge], first[edge], first[np.append(edge[1:], len(first)) - 1]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row and value of each item of a list column."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), lengths), values


def _held(doc: np.ndarray, value: np.ndarray, listed: pa.Array) -> np.ndarray:
    """Which runs have a value that their document's list holds."""
    row, values = _flat(listed)
    pair = lambda d, v: mix(v ^ mix(d.astype(np.uint64) + np.uint64(1)))
    return np.isin(pair(doc, value), pair(row, values.view(np.uint64)))


def _spread(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n places lie in a stretch from ``first`` to ``last``, both included."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, first, 1)
    np.add.at(delta, last + 1, -1)
    return np.cumsum(delta[:n]) > 0


class Line:
    """The words of a slice with one blank after each: word w is data[starts[w]:ends[w]]."""

    def __init__(self, words: Words):
        size = words.ends - words.starts
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        self.data = np.full(int(self.ends[-1]) + 1 if words.n else 0, 32, np.uint8)
        mark = np.zeros(len(words.data) + 1, np.int8)
        mark[words.starts] += 1
        np.add.at(mark, words.ends, -1)
        where = np.ones(len(self.data), bool)
        where[self.ends] = False
        self.data[where] = words.data[np.cumsum(mark[:-1]).astype(bool)]

    def stretches(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The words from ``first`` to ``last`` of each stretch, joined by one blank."""
        starts, size = self.starts[first], self.ends[last] - self.starts[first]
        offsets = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
        return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[at])]).cast(pa.binary())


def summaries(rows: DataFrame, window: int, gram: int, with_text: bool) -> DataFrame:
    """(doc_id, dk, tie, t1, t2, text) -> those keys, n_words, the digest of all words (and the words), and the values of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column(5))
            doc, value, _, _ = window_runs(words, window, gram)
            ends = np.zeros(part.num_rows + 1, np.int32)
            np.cumsum(np.bincount(doc, minlength=part.num_rows), out=ends[1:])
            kept = _kept(words, np.zeros(words.n, bool))
            out = [*part.columns[:5], pa.array(words.counts, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            out += [pa.array([k.decode("utf-8", "replace") for k in kept])] * with_text
            yield pa.RecordBatch.from_arrays([*out, pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64)))], names=names)

    names = ["doc_id", "dk", "tie", "t1", "t2", "n_words", "digest", *["words"] * with_text, "values"]
    kinds = ["long"] * 6 + ["string"] * (1 + with_text) + ["array<long>"]
    return rows.select("doc_id", "dk", "tie", "t1", "t2", "text").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def passages(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, dk, tie, shared, text) -> one row for each run with a shared value: value, doc_id, dk, tie, start, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column(4))
            doc, value, first, last = window_runs(words, window, gram)
            mine = _held(doc, value, part.column(3))
            doc, value, first, last = doc[mine], value[mine], first[mine], last[mine]
            owner = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), *[part.column(i).take(owner) for i in range(3)], pa.array(first - words.first[doc]), Line(words).stretches(first, last + window - 1)],
                names=["value", "doc_id", "dk", "tie", "start", "words"],
            )

    return rows.select("doc_id", "dk", "tie", "shared", "text").mapInArrow(run, "value long, doc_id long, dk long, tie long, start long, words binary")


def first_windows(rows: DataFrame, window: int) -> DataFrame:
    """Runs, sorted by value and place -> dk, tie, ranges of the windows that no earlier run of the value holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, held = None, {}, None
        for batch in batches:
            dk, tie, ranges = [], [], []
            for value, key, text_key, start, line in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)]):
                if value != now:
                    now, seen, held = value, {}, None
                if line in seen:
                    continue
                words = line.split(b" ")
                if not seen:
                    found = [(start << 32) | (start + len(words) - window)]
                else:
                    if held is None:
                        held = SuffixAutomaton()
                        held.add(next(iter(seen)).split(b" "))
                    new = [i for i, n in enumerate(held.statistics(words)[window - 1 :], start) if n < window]
                    found = [(a << 32) | a for a in new]
                    held.add(words)
                seen[line] = None
                if found:
                    dk.append(key)
                    tie.append(text_key)
                    ranges.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(dk, pa.int64()), pa.array(tie, pa.int64()), pa.array(ranges, pa.list_(pa.int64()))], names=["dk", "tie", "ranges"])

    return rows.select("value", "doc_id", "dk", "tie", "start", "words").mapInArrow(run, "dk long, tie long, ranges array<long>")


def frequent_runs(rows: DataFrame, window: int, gram: int, held: int = 200_000) -> DataFrame:
    """(doc_id, dk, tie, frequent, text) -> of equal runs of a frequent value the earliest that the task has met: value, name (two longs), doc_id, dk, tie, start, words."""
    keys = [("value", "ascending"), ("name", "ascending"), ("second", "ascending"), ("known", "ascending"), ("doc_id", "ascending"), ("tie", "ascending"), ("start", "ascending")]

    def earliest(tables: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(tables).sort_by(keys).combine_chunks()
        group = [table.column(c).to_numpy() for c in ("value", "name", "second")]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.logical_or.reduce([g[1:] != g[:-1] for g in group])
        return table.filter(pa.array(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[pa.Table] = []
        for part in slices(batches, "text"):
            words = Words(part.column(4))
            doc, value, first, last = window_runs(words, window, gram)
            mine = _held(doc, value, part.column(3))
            doc, value, first, end = doc[mine], value[mine], first[mine], last[mine] + window
            name, second = words.runs(first, end), np.zeros(len(first), np.uint64)
            for i in range(int((end - first).max(initial=0))):  # a name of its own kind: every word mixed in by itself
                at = np.minimum(first + i, words.n - 1)
                second = np.where(first + i < end, mix(second * np.uint64(0x9E3779B97F4A7C15) + words.hashes[at]), second)
            # Of a text that repeats a run, the first place.
            order = np.lexsort((second, name, value, doc))
            same = (value[order], name[order], second[order], doc[order])
            new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in same])]) if len(order) else np.zeros(0, bool)
            keep = order[new]
            owner = pa.array(doc[keep])
            ids = part.column(0).take(owner)
            columns = [pa.array(value[keep].view(np.int64)), pa.array(name[keep].view(np.int64)), pa.array(second[keep].view(np.int64)), ids.is_valid()]
            columns += [ids.fill_null(0), part.column(1).take(owner), part.column(2).take(owner), pa.array(first[keep] - words.first[doc[keep]])]
            columns.append(Line(words).stretches(first[keep], end[keep] - 1))
            found.append(earliest([pa.table(columns, names=["value", "name", "second", "known", "doc_id", "dk", "tie", "start", "words"])]))
            if sum(t.num_rows for t in found) > held:
                found = [earliest(found)]
                if found[0].num_rows > held // 2:
                    yield from out(found.pop())
        if found:
            yield from out(earliest(found))

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = pc.if_else(table.column("known"), table.column("doc_id"), pa.scalar(None, pa.int64()))
        table = table.set_column(table.schema.get_field_index("doc_id"), "doc_id", ids).drop_columns(["known"])
        yield from table.to_batches(max_chunksize=10_000)

    return rows.select("doc_id", "dk", "tie", "frequent", "text").mapInArrow(run, "value long, name long, second long, doc_id long, dk long, tie long, start long, words binary")


def named_windows(rows: DataFrame, window: int) -> DataFrame:
    """Runs (value, doc_id, dk, tie, start, words) -> name (two longs), doc_id, dk, tie, start of each of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "words"):
            words = Words(part.column(4))
            at, name = words.windows(window)
            second = np.zeros(len(at), np.uint64)
            for i in range(window):  # a name of its own kind: every word mixed in by itself
                second = mix(second * np.uint64(0x9E3779B97F4A7C15) + words.hashes[at + i])
            doc = words.doc[at]
            owner = pa.array(doc)
            start = part.column(3).to_numpy()[doc] + at - words.first[doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(name.view(np.int64)), pa.array(second.view(np.int64)), *[part.column(i).take(owner) for i in range(3)], pa.array(start)],
                names=["name", "second", "doc_id", "dk", "tie", "start"],
            )

    return rows.select("doc_id", "dk", "tie", "start", "words").mapInArrow(run, "name long, second long, doc_id long, dk long, tie long, start long")


def _kept(words: Words, removed: np.ndarray) -> list[bytes]:
    """The words of each text that are not removed, joined by one blank."""
    line = Line(words)
    take = np.repeat(~removed, line.ends - line.starts + 1)
    left = np.zeros(len(take) + 1, np.int64)
    np.cumsum(take, out=left[1:])
    data = line.data[take]
    bounds = left[np.append(line.starts, len(take))[words.first]].tolist()
    return [data[a : b - 1].tobytes() if b > a else b"" for a, b in zip(bounds[:-1], bounds[1:])]


def cut(rows: DataFrame, window: int, gram: int, with_text: bool) -> DataFrame:
    """(dk, tie, text, shared, frequent, ranges) -> dk, tie, n_removed, digest of the kept words (and the words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column(2))
            doc, value, first, last = window_runs(words, window, gram)
            mine = _held(doc, value, part.column(3)) | _held(doc, value, part.column(4))
            gone = _spread(words.n, first[mine], last[mine])
            row, packed = _flat(part.column(5))
            gone &= ~_spread(words.n, words.first[row] + (packed >> 32), words.first[row] + (packed & 0xFFFFFFFF))
            at = np.flatnonzero(gone)
            removed = _spread(words.n, at, at + window - 1)
            sums = np.zeros(words.n + 1, np.int64)
            np.cumsum(removed, out=sums[1:])
            kept = _kept(words, removed)
            out = [part.column(0), part.column(1), pa.array(np.diff(sums[words.first])), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            out += [pa.array([k.decode("utf-8", "replace") for k in kept])] * with_text
            yield pa.RecordBatch.from_arrays(out, names=["dk", "tie", "n_removed", "left_digest", *["left_words"] * with_text])

    return rows.select("dk", "tie", "text", "shared", "frequent", "ranges").mapInArrow(
        run, "dk long, tie long, n_removed long, left_digest string" + ", left_words string" * with_text
    )


def salted() -> Column:
    """One row for each salt."""
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, with_text: bool = False
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept words) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).selectExpr(
        "doc_id", "text", "xxhash64(doc_id, text) AS dk", "shiftrightunsigned(xxhash64(text, 1), 2) AS tie", "xxhash64(text) AS t1", "xxhash64(text, 2) AS t2"
    )
    salt = F.pmod("dk", F.lit(SALTS)).cast("int").alias("salt")

    # Documents, which of them are copies of an earlier one, and the values of their runs.
    all_rows = materialise(summaries(rows, window, gram, with_text), "documents")
    texts = all_rows.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("m"), F.count("doc_id").alias("with_id"), F.min("doc_id").alias("least"))
    many = texts.where("m > 1").selectExpr("t1", "t2", "CASE WHEN with_id = m THEN least END AS first_id", "true AS many").select("*", salted())
    known = [c for c in all_rows.columns if c not in ("values", "t1", "t2")]
    told = all_rows.drop("values").withColumn("salt", salt).join(many, ["t1", "t2", "salt"], "left")
    told = materialise(told.select(*known, F.expr("many IS NOT NULL AND NOT (doc_id <=> first_id) AS copy")), "told")

    # Values that more than one run has, and the documents with such runs.
    runs = all_rows.select("dk", F.explode("values").alias("value"))
    repeated = runs.groupBy("value").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("value", (F.col("m") > shard).alias("often"))
    repeated = materialise(repeated, "repeated")
    release(spark)
    shared = runs.withColumn("salt", salt).join(repeated.select("*", salted()), ["value", "salt"])
    pick = lambda test: F.collect_list(F.when(test, F.col("value")))
    shared = shared.groupBy("dk").agg(pick(~F.col("often")).alias("shared"), pick(F.col("often")).alias("frequent"))
    first_ones = told.where("NOT copy").select("dk", "tie").distinct()
    wanted = materialise(shared.join(first_ones, "dk"), "wanted")
    release(spark)

    open_rows = materialise(rows.select("doc_id", "dk", "tie", "text").join(wanted, ["dk", "tie"]), "open")
    release(spark)
    discard(all_rows)

    # Of equal runs of a frequent value only the earliest can be the first place of a window.
    runs = frequent_runs(open_rows.where("size(frequent) > 0"), window, gram).withColumn("place", F.expr(PLACE))
    told_apart = [F.min_by(F.struct("doc_id", "dk", "tie", "start", "words"), F.struct("place", "start")).alias("first")]
    runs = runs.groupBy("value", "name", "second").agg(*told_apart).select("value", "first.*")
    runs = materialise(runs.withColumn("salt", salt), "runs")
    wide = runs.groupBy("value").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > shard).select("value", salted())
    narrow = runs.join(wide, ["value", "salt"], "left_anti").drop("salt")
    routed = passages(open_rows.where("size(shared) > 0"), window, gram).unionByName(narrow).repartition("value")
    ordered = routed.sortWithinPartitions("value", F.asc_nulls_first("doc_id"), "tie", "start")
    named = named_windows(runs.join(wide, ["value", "salt"], "left_semi"), window).select("name", "second", "dk", "tie", "start", F.expr(PLACE).alias("place"))
    earliest = named.groupBy("name", "second").agg(*[F.min_by(c, F.struct("place", "start")).alias(c) for c in ("dk", "tie", "start")])
    firsts = first_windows(ordered, window).unionByName(earliest.select("dk", "tie", F.array(F.col("start").bitwiseOR(F.shiftleft("start", 32))).alias("ranges")))
    firsts = materialise(firsts.groupBy("dk", "tie").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "firsts")
    release(spark)

    changed = cut(open_rows.join(firsts, ["dk", "tie"], "left"), window, gram, with_text)
    changed = changed.groupBy("dk", "tie").agg(*[F.min(c).alias(c) for c in changed.columns if c not in ("dk", "tie")])
    whole = f"copy AND n_words >= {window}"
    out = told.join(changed, ["dk", "tie"], "left").select(
        "doc_id",
        "n_words",
        F.expr(f"CASE WHEN {whole} THEN n_words WHEN copy THEN 0L ELSE coalesce(n_removed, 0L) END").alias("n_removed"),
        F.expr(f"CASE WHEN {whole} THEN '{NOTHING}' WHEN copy THEN digest ELSE coalesce(left_digest, digest) END").alias("kept_sha256"),
        *[F.expr(f"CASE WHEN {whole} THEN '' WHEN copy THEN words ELSE coalesce(left_words, words) END").alias("kept")] * with_text,
    )
    return out


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
