"""Quality rules: repetition and length rules, and n-gram perplexity bands by language.

The language model is a modified Kneser-Ney model of order 5 over the UTF-8 bytes of the
text (white space collapsed to one blank), estimated from documents of all languages: the
bytes before tell the language, and a text that quotes another one is scored fairly.
Spark counts every 5-gram and smooths the counts in tables that grow with the corpus; lower
orders use continuation counts of the order above, and each 5-gram gets its probability
interpolated over all orders.  No gram is folded, cut off or capped.

Equal texts count once, in the model and in the bands, however many rows hold them.  A text's
hash puts it in one of ``FOLDS`` folds, each with a model of its own, and a text is scored by
the model of the next fold, which has not counted it or its copies.  A gram that model lacks
backs off to the lower orders.

The models are stored in sorted hash arrays, in as many shards as their size asks for: each
of about ``SHARD_GRAMS`` entries (48 MB), which bounds what the driver holds and a worker
loads at once.

A document is rejected where its held-out log perplexity leaves its language's band: the
median less ``LOWER_WIDTH`` to plus ``UPPER_WIDTH`` robust deviations, wider for short texts,
whose mean is noisier.

Defined results: null and empty texts have no words and fail the base rules; a null
language is a language of its own; texts under 5 bytes have no perplexity and keep the base
verdict; repeated rows are judged like any others; very long texts are scored whole; empty
tables give none; other columns pass by name where carried and else are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.kernel import SLICE_BYTES, SPACE, Words, buffers, mix, slices
from palisade.session import materialise, release

ORDER = 5
#: Models by fold; PLAIN is the one of all rows, copies and the scored text itself included.
FOLDS, PLAIN = 2, 2
#: An entry of the models: what it is (an order, or OF_CONTEXT and an order), the model, and the bytes of a gram or context.
MODEL_AT, WHAT_AT, OF_CONTEXT = 8 * ORDER, 8 * ORDER + 4, 8
MODEL_BITS = 15 << MODEL_AT
#: Grams in a shard of the model, and different grams a task holds before it sends them on.
SHARD_GRAMS, TASK_GRAMS = 4_000_000, 1_000_000
#: A gram's shard: its key modulo the prime, times the factor, without the last bits, modulo the shards.
SHARD_PRIME, SHARD_FACTOR, SHARD_SHIFT = 2147483647, 1103515245, 20
#: The reach of a band below and above the median, in robust deviations, and the least deviation.
LOWER_WIDTH, UPPER_WIDTH, LEAST_DEVIATION = 6.0, 3.5, 0.02
#: Quartiles are of perplexities rounded to this step.
STEP = 0.0005
#: A text of a third of this many bytes has a mean twice as noisy as a very long one.
NOISE_BYTES = 1800.0

MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[10] = False


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of each 5-gram: its five bytes."""
    data, offsets = buffers(text)
    blank = SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    stream = np.where(blank, np.uint8(32), data)[keep].astype(np.uint64)
    left = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=left[1:])
    at = left[offsets]
    if len(stream) < ORDER:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = np.zeros(len(stream) - ORDER + 1, np.uint64)
    for i in range(ORDER):
        key = (key << np.uint64(8)) | stream[i : len(stream) - ORDER + 1 + i]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = row[: len(key)] == row[ORDER - 1 :]
    return row[: len(key)][inside], key[inside]


def count_grams(docs: DataFrame) -> DataFrame:
    """(text, model) -> key, n of every 5-gram of each model: tasks count what they read, Spark adds up by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(where, np.concatenate(counts)).astype(np.int64)

        def out(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 16)].view(np.int64)), pa.array(n[a : a + (1 << 16)])], names=["key", "n"])

        for part in slices(batches, "text"):
            row, gram = grams(part.column(0))
            key, which = distinct(in_model(gram, part.column(1).to_numpy()[row]))
            keys.append(key)
            counts.append(np.bincount(which, minlength=len(key)))
            held += len(key)
            if held > TASK_GRAMS:
                key, n = merged()
                if len(key) > TASK_GRAMS // 2:
                    yield from out(key, n)
                    key, n = key[:0], n[:0]
                keys, counts, held = [key], [n], len(key)
        if held:
            yield from out(*merged())

    counts = docs.select("text", "model").mapInArrow(run, "key long, n long")
    return counts.groupBy("key").agg(F.sum("n").alias("n"))


def in_model(gram: np.ndarray, model: np.ndarray) -> np.ndarray:
    return gram | (model.astype(np.uint64) << np.uint64(MODEL_AT))


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, and which of them each key is."""
    found = pa.array(key).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False), found.indices.to_numpy(zero_copy_only=False)


def discounts(seen: dict[int, int]) -> list[float]:
    """Modified Kneser-Ney's discounts of counts 1, 2 and more, from how many grams have counts 1 to 4."""
    n = [max(1.0, float(seen.get(i, 0))) for i in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.1), i - 0.1) for i in (1, 2, 3)]


def fit(counts: DataFrame) -> DataFrame:
    """key, logp of every entry of the models: probabilities interpolated over all orders, computed by Spark.

    A level holds the grams of an order with their counts, or below the highest with how many
    different bytes come before them.  A context has at most 256 grams, and so has a suffix.
    Entries are the grams' probabilities and the contexts' weights for the order below; PLAIN
    scores only what it counted, so it needs its 5-grams alone.
    """
    levels = {ORDER: materialise(counts, "grams")}
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("key").bitwiseAND(F.lit((1 << (8 * order)) - 1 | MODEL_BITS))
        levels[order] = materialise(levels[order + 1].groupBy(suffix.alias("key")).agg(F.count(F.lit(1)).alias("n")), "grams")
    seen: dict[tuple[int, int], dict[int, int]] = {}
    rare = [level.where("n <= 4").selectExpr(f"{order} AS level", f"shiftright(key, {MODEL_AT}) AS model", "n") for order, level in levels.items()]
    for row in functools.reduce(DataFrame.union, rare).groupBy("level", "model", "n").count().collect():  # at most 20 rows a model
        seen.setdefault((row.level, row.model), {})[row.n] = row["count"]
    below, entries = None, []
    for order in range(1, ORDER + 1):
        cut = "".join(
            " WHEN {} THEN CASE n WHEN 1 THEN {}D WHEN 2 THEN {}D ELSE {}D END".format(model, *discounts(seen.get((order, model), {}))) for model in range(max(FOLDS, PLAIN) + 1)
        )
        context = f"(shiftright(key, 8) & {(1 << (8 * (order - 1))) - 1}) | (key & {MODEL_BITS})"
        level = levels[order].selectExpr("key", "n", f"least(CASE shiftright(key, {MODEL_AT}){cut} END, n) AS less", f"{context} AS context")
        contexts = level.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("less") / F.sum("n")).alias("gamma"))
        level = level.join(contexts, "context")
        if below is None:
            level = level.withColumn("lower", F.lit(1 / 256))
        else:
            level = level.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1 | MODEL_BITS))).join(below, "suffix")
        smooth = materialise(level.selectExpr("key", "context", "gamma", "(n - less) / total + gamma * lower AS p"), "smooth")
        below = smooth.selectExpr("key AS suffix", "p AS lower")
        release(counts.sparkSession)
        lacks = f"shiftright(key, {MODEL_AT}) < {FOLDS}"
        entries.append((smooth if order == ORDER else smooth.where(lacks)).selectExpr(f"key | {order << WHAT_AT} AS key", "ln(p) AS logp"))
        entries.append(smooth.where(lacks).selectExpr(f"context | {(OF_CONTEXT + order) << WHAT_AT} AS key", "ln(gamma) AS logp").distinct())
    return functools.reduce(DataFrame.union, entries).selectExpr("key", "CAST(logp AS FLOAT) AS logp")


class Model:
    """Sorted hash arrays of entries with log probabilities, broadcast in shards of bounded size.

    A worker with one shard keeps it; of several it loads one after the other for each slice of
    texts, so memory is bounded whatever the model's size.
    """

    def __init__(self, table: DataFrame, shard_grams: int):
        spark = table.sparkSession
        table = materialise(table, "model")
        release(spark)  # the driver's memory is the model's from here on, shard by shard
        self.n = max(1, -(-table.count() // shard_grams))
        place = F.expr(f"pmod(shiftright(pmod(key, {SHARD_PRIME}) * {SHARD_FACTOR}, {SHARD_SHIFT}), {self.n})")
        self.shards = []
        for i in range(self.n):
            found = table.where(place == i).toArrow()
            hashed = mix(found.column("key").to_numpy().view(np.uint64))
            order = np.argsort(hashed)
            self.shards.append(spark.sparkContext.broadcast((hashed[order], found.column("logp").to_numpy()[order])))

    def close(self) -> None:
        """Take the shards from the driver and the workers; no text can be scored after."""
        for shard in self.shards:
            shard.destroy()

    def find(self, key: np.ndarray) -> np.ndarray:
        """Log probabilities of the entries; NaN where there is none."""
        out = np.full(len(key), np.nan)
        signed = key.astype(np.int64)
        place = ((signed % SHARD_PRIME * SHARD_FACTOR) >> SHARD_SHIFT) % self.n
        for i, shard in enumerate(self.shards):
            mine = np.flatnonzero(place == i)
            if not len(mine):
                continue
            hashed, logp = shard.value
            if len(hashed):
                wanted = mix(key[mine])
                at = np.minimum(np.searchsorted(hashed, wanted), len(hashed) - 1)
                out[mine] = np.where(hashed[at] == wanted, logp[at], np.nan)
            if self.n > 1:
                vars(shard).pop("_value", None)
        return out

    def __call__(self, key: np.ndarray) -> np.ndarray:
        """Log probabilities of 5-grams, each in the model it names; unseen ones by their lower orders."""
        out = self.find(key | np.uint64(ORDER << WHAT_AT))
        lost = np.flatnonzero(np.isnan(out))
        if not len(lost):
            return out
        asked = []
        for order in range(ORDER, 0, -1):
            mask = np.uint64((1 << (8 * order)) - 1)
            model, gram = key[lost] & np.uint64(MODEL_BITS), key[lost] & mask
            asked.append(gram | model | np.uint64(order << WHAT_AT))
            asked.append((gram >> np.uint64(8)) | model | np.uint64((OF_CONTEXT + order) << WHAT_AT))
        found = self.find(np.concatenate(asked)).reshape(len(asked), len(lost))
        total, open_ = np.zeros(len(lost)), np.ones(len(lost), bool)
        for gram, weight in zip(found[::2], found[1::2]):
            here = open_ & ~np.isnan(gram)
            total[here] += gram[here]
            open_ &= ~here
            total[open_] += np.nan_to_num(weight[open_])  # a context never seen leaves all to the order below
        total[open_] -= np.log(256)
        out[lost] = total
        return out


def base_columns(text: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    words = Words(text)
    data, offsets = words.data, words.offsets

    def total(mark: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mark, out=sums[1:])
        return sums

    solid = total(~SPACE[data])
    chars = total(~SPACE[data] & ((data & 0xC0) != 0x80))[offsets]
    symbols = total(SYMBOLS[data])[offsets]

    lines = Words(text, NOT_NEWLINE)
    full = solid[lines.ends] > solid[lines.starts]
    _, first = np.unique(mix(lines.hashes[full] + mix(lines.doc[full].astype(np.uint64))), return_index=True)
    again = np.ones(int(full.sum()), bool)
    again[first] = False
    dup_lines = np.bincount(lines.doc[full][again], minlength=len(text))

    at, h = words.windows(WINDOW)
    _, inverse, times = np.unique(mix(h + mix(words.doc[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    cover = np.zeros(words.n + 1, np.int64)
    twice = at[times[inverse] > 1]
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    covered = np.zeros(words.n + 1, np.int64)
    np.cumsum(np.cumsum(cover[:-1]) > 0, out=covered[1:])
    return {
        "n_words": words.counts,
        "word_chars": np.diff(chars),
        "n_symbols": np.diff(symbols),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.diff(covered[words.first]),
    }


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", lower: float = LOWER_WIDTH, upper: float = UPPER_WIDTH, carry: tuple[str, ...] = (),
    shard_grams: int = SHARD_GRAMS, plain: bool = True,
) -> DataFrame:
    """doc_id, the base columns, base_failed, held_out (log perplexity per byte), kept, and the columns to carry.

    With ``plain``, also log_perplexity by the model of all rows, which judges nothing.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("digest"), *carry)
    fold = F.expr(f"CAST(pmod(xxhash64(text), {FOLDS}) AS INT) AS model")
    counted = count_grams(rows.select("text").distinct().select("text", fold))
    if plain:
        counted = counted.unionByName(count_grams(rows.select("text", F.lit(PLAIN).alias("model"))))
    model = Model(fit(counted), shard_grams)
    scores = ("held_out", "log_perplexity") if plain else ("held_out",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES * min(model.n, 4)):
            text = part.column(1)
            base = base_columns(text)
            row, gram = grams(text)
            n = np.bincount(row, minlength=len(text))
            means = []
            for score in scores:
                by = (part.column(3).to_numpy() + 1) % FOLDS if score == "held_out" else np.full(len(text), PLAIN)
                key, which = distinct(in_model(gram, by[row]))
                means.append(-np.bincount(row, model(key)[which], len(text)) / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(2), part.column(0), part.column(3), *(pa.array(base[c], pa.int64()) for c in BASE), pa.array(n, pa.int64()),
                    *(pa.array(mean, mask=n == 0) for mean in means), *part.columns[4:],
                ],
                names=["doc_id", "lang", "digest", *BASE, "n_grams", *scores, *carry],
            )

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, digest long, " + ", ".join(f"{c} long" for c in (*BASE, "n_grams"))
    schema += "".join(f", {c} double" for c in scores)
    schema += "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    scored = materialise(rows.mapInArrow(run, schema), "quality")
    model.close()
    release(docs.sparkSession)
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")
    scored = scored.withColumn("base_failed", failed)
    # Quartiles by language over every distinct text that passes the base rules: from counts by step, so reruns agree.
    bands = (
        scored.where("NOT base_failed AND held_out IS NOT NULL")
        .groupBy("lang", "digest")
        .agg(F.min(F.round(F.col("held_out") / STEP).cast("long")).alias("step"))
        .groupBy("lang", "step")
        .agg(F.count(F.lit(1)).alias("texts"))
        .groupBy("lang")
        .agg(F.expr(f"transform(percentile(step, array(0.25D, 0.5D, 0.75D), texts), x -> x * {STEP}D)").alias("q"))
        .selectExpr("lang AS band_lang", "q[1] AS middle", f"greatest((q[2] - q[0]) / 1.349, {LEAST_DEVIATION}) AS deviation")
    )
    noise = f"deviation * sqrt(1 + {NOISE_BYTES} / greatest(n_grams, 1))"
    judged = scored.join(bands, F.col("lang").eqNullSafe(F.col("band_lang")), "left").withColumn(
        "kept",
        F.expr(f"NOT base_failed AND coalesce(held_out BETWEEN middle - {lower} * {noise} AND middle + {upper} * {noise}, true)"),
    )
    return judged.select("doc_id", "lang", *BASE, "base_failed", "n_grams", *scores, "kept", *carry)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = quality(docs, plain=False).withColumnRenamed("held_out", "log_perplexity")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")
