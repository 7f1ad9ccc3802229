"""Mixing sources to target weights by Pareto order sampling, in DataFrame expressions only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
``budget`` times all sizes; no target exceeds ``cap`` times its source's size, and what is
cut off is shared again by weight until nothing is above.  That is water-filling: with
sources in order of cap*size/weight there is one level L with target = min(cap*size, L*weight).

Sampling: a source with target t and size s takes every document floor(t/s) times with
certainty.  The words that remain go to a sample of one more copy, in which a document of n
words is included with probability p = min(1, L * n**``POWER``): longer documents are likelier,
and those whose probability reaches 1 are certain.  L makes the expected words of the sample
what remains; it comes from counts by size, largest first.  Documents rank by Pareto order,
(u/(1-u)) / (p/(1-p)) with u from a hash of the document's id and its place in the files, and
the smallest ranks fill what remains.

The cut is found by blocks of q/(1+q): sums per (source, block) tell which blocks lie wholly
under it, and only the block it falls in is sorted.  The cut lies near q = 1, where such a
block holds at most about ``BLOCK_ROWS`` rows whatever the probabilities are, and whatever ids
and rows are null or repeated, as no two rows share a place.  They are walked through in order
of rank, and each document that still fits is taken.

Defined results: null text has size 0; documents of size 0 are included like an average word;
null source is a source of its own; null and repeated ids and equal rows are documents of their
own; very long texts are one document like others; empty tables give none; other columns pass
by name where carried and else are ignored.  A rerun over the same files gives the same mix.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.session import materialise, release

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET, CAP = 1.5, 2
#: A document's probability of one more copy grows with its size to this power.
POWER = 0.5
BLOCK_ROWS = 4096
SEED = "mix-1"


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the key, the same in any SQL engine: 48 bits of MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


#: The column with a row's draw by its place: a name that no table has.
PLACE = "__drawn_by_place__"


def drawn(docs: DataFrame, id_col: str, *names: str) -> DataFrame:
    """The id and the named columns of each row, and ``PLACE``'s draw u: from the id, the row's number in its file and the file's name, less what a rewrite of the same parts gives anew.

    Rows that come from no files have their place in a table that is written here.
    """
    columns = list(dict.fromkeys((id_col, *names)))
    name = F.regexp_replace(F.col("_metadata.file_name"), "-[0-9a-f]{8}-[0-9a-f-]{27}", "")
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), name, F.col("_metadata.row_index").cast("string"))
    try:
        return docs.select(*columns, uniform(key).alias(PLACE))
    except AnalysisException:
        return materialise(docs.select(*columns), "rows").select("*", uniform(key).alias(PLACE))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """(source, source_size, n) -> with target.  One row a source: a dimension, ordered in one place."""
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {} {} END".format(
        len(weights), " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    )
    ranked = sources.selectExpr("source", "source_size", "n", f"{weight} AS w")
    ranked = ranked.selectExpr("*", f"CAST({cap} * source_size AS DOUBLE) / w AS r")
    before = "OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    levels = ranked.selectExpr(
        "*",
        f"({budget}D * sum(source_size) OVER () - coalesce({cap} * sum(source_size) {before}, 0)) / (sum(w) OVER () - coalesce(sum(w) {before}, 0)) AS level",
    )
    # The first source whose level is no more than its own cap fixes L; later levels are smaller.
    return levels.selectExpr("*", "max(CASE WHEN level <= r THEN level END) OVER () AS L").selectExpr(
        "source", "source_size", "n", f"CASE WHEN L IS NULL OR r < L THEN CAST({cap} * source_size AS DOUBLE) ELSE L * w END AS target"
    )


def inclusion_levels(sized: DataFrame, targets: DataFrame, power: float) -> DataFrame:
    """(source, L): the factor of size**power that makes the sample's expected words what remains of the target.

    Sizes of a source in order from the largest: as long as L would lift one above probability 1,
    its documents are certain and the rest shares what they leave.  Rows are distinct sizes, not documents.
    """
    sizes = sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.join(targets.selectExpr("source AS t_source", "rest"), F.col("source").eqNullSafe(F.col("t_source")))
    by_size = "PARTITION BY source ORDER BY size DESC ROWS BETWEEN"
    levels = sizes.selectExpr(
        "source", "size",
        f"(rest - coalesce(sum(size * m) OVER ({by_size} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) "
        f"/ sum(m * power(size, {1 + power}D)) OVER ({by_size} CURRENT ROW AND UNBOUNDED FOLLOWING) AS L",
    )
    return levels.where(f"L * power(size, {power}D) <= 1").groupBy("source").agg(F.max_by("L", "size").alias("L"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET,
    cap: int = CAP,
    block_rows: int = BLOCK_ROWS,
    power: float = POWER,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix takes the document), taken, inclusion (its probability of one copy more), and columns to carry."""
    sized = materialise(
        drawn(docs, id_col, text_col, source_col, *carry).select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.col(PLACE).alias("u"),
            *carry,
        ),
        "mix",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(sources, weights, budget, cap).selectExpr(
        "source",
        "source_size",
        "target",
        f"greatest(1, n div {block_rows}) AS blocks",
        "CASE WHEN source_size = 0 THEN 0L ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole",
    )
    targets = targets.selectExpr("*", "target - whole * source_size AS rest")
    levels = inclusion_levels(sized, targets, power).withColumnRenamed("source", "l_source")
    targets = targets.join(levels, F.col("source").eqNullSafe(F.col("l_source")), "left").drop("l_source").withColumnRenamed("source", "s_source")
    # Written, a table of one row a source has a known size, by which Spark decides to broadcast it.
    targets = materialise(targets, "targets")
    release(docs.sparkSession)
    share = f"CASE WHEN rest <= 0 OR source_size = 0 THEN 0D WHEN size = 0 THEN rest / source_size ELSE least(1D, L * power(size, {power}D)) END"
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("s_source"))).selectExpr("*", f"{share} AS p")
    rows = rows.selectExpr("*", "CASE WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS q").selectExpr(
        "doc_id", "source", "size", "source_size", "target", "whole", "rest", "p", "q", *carry, "CAST(floor(coalesce(q / (1 + q), 0D) * blocks) AS INT) AS block"
    )
    sums = rows.groupBy("source", "block", "rest").agg(F.sum("size").alias("block_size"))
    cuts = sums.selectExpr(
        "source AS c_source",
        "block AS c_block",
        "rest - coalesce(sum(block_size) OVER (PARTITION BY source ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room",
        "block_size",
    )
    cut = rows.join(cuts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("block") == F.col("c_block")))
    keep = ["doc_id", "source", "size", "source_size", "target", "whole", "p", *carry]
    clear = cut.where("q IS NULL OR room <= 0 OR block_size <= room").selectExpr(*keep, "CAST(q IS NOT NULL AND room > 0 AS INT) AS more")
    # One block of each source at most, so what is collected and walked through here has a bounded size.
    fields = ["q", "doc_id", "size", *[c for c in keep if c not in ("doc_id", "size", "source")]]
    at = cut.where("q IS NOT NULL AND room > 0 AND block_size > room").groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("ranked"), F.max("room").alias("room")
    )
    fits = "x.size <= acc.room"
    taken = (
        "aggregate(ranked, named_struct('room', room, 'more', CAST(array() AS array<int>)), "
        f"(acc, x) -> named_struct('room', CASE WHEN {fits} THEN acc.room - x.size ELSE acc.room END, 'more', concat(acc.more, array(CAST({fits} AS INT)))), acc -> acc.more)"
    )
    at = at.selectExpr("source", "ranked", f"{taken} AS more").selectExpr("source", "inline(arrays_zip(ranked, more))").selectExpr("source", "ranked.*", "more")
    return clear.unionByName(at.select(*keep, "more")).selectExpr(
        "doc_id", "source", "size", "source_size", "target", "whole + more AS copies", "(whole + more) * size AS taken", "p AS inclusion", *carry
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
