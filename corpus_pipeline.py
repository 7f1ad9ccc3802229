"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), calls one operator of ``palisade.llm`` on all rows its
predecessor kept, applies the decisions, and returns a DataFrame; all but the last return the
columns of documents.  Between stages the rows are written as Parquet and read again, and
what the driver keeps of the stage before is let go.

Rows are told apart by their place in the input files, not by doc_id, so null and repeated
doc_ids lose nothing: quality keeps or drops each row by itself; of rows with equal texts one
stays; of near duplicates one stays; the mix repeats a row as often as it takes it; packing
gives every row's pieces a place.  Columns with any name pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.exact_dedup import exact_dedup
from palisade.llm.mixing import mix
from palisade.llm.near_dedup import near_duplicates
from palisade.llm.packing import pack
from palisade.llm.quality import quality
from palisade.session import materialise, release, ship

ROW = ("row_file", "row_index")
#: The near-dedup stage's threshold; op2's own contract has 85.
NEAR_PERCENT = 80


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows with plain column names c0, c1, ... and their place in the files; and the real names."""
    names = docs.columns
    try:
        place = docs.select("*", F.xxhash64("_metadata.file_path"), "_metadata.row_index")
    except AnalysisException:  # not read from files
        place = materialise(docs.toDF(*[f"c{i}" for i in range(len(names))]), "rows")
        place = place.select("*", F.xxhash64("_metadata.file_path"), "_metadata.row_index")
    return place.toDF(*[f"c{i}" for i in range(len(names))], *ROW), names


def _column(names: list[str], name: str) -> str:
    return f"c{names.index(name)}"


def _named(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and their language's perplexity band.

    Null and empty texts fail the base rules; equal rows are judged alike and all stay or go; a
    null language is a language; a null doc_id changes nothing.
    """
    release(spark)
    ship(spark)
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    rows = docs.toDF(*plain)
    judged = quality(rows, _column(names, "doc_id"), _column(names, "text"), _column(names, "lang"), carry=tuple(plain), plain=False)
    return _named(judged.where("kept"), names)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, one with the largest doc_id.

    A null text is an empty one; null doc_ids come before all others; of several rows with that
    doc_id the first in the files stays.
    """
    release(spark)
    ship(spark)
    rows, names = _numbered(docs)
    judged = exact_dedup(rows, id_col=_column(names, "doc_id"), text_col=_column(names, "text"), carry=ROW)
    kept = judged.where("kept").groupBy("digest").agg(F.min(F.struct(*ROW)).alias("row")).select("row.*")
    return _named(rows.join(kept, list(ROW), "left_semi"), names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (0.8 and more in five-word shingles), the one with the smallest doc_id; texts without words all stay.

    A null doc_id comes after all others; of several rows with the kept doc_id the first in the
    files stays.
    """
    release(spark)
    ship(spark)
    rows, names = _numbered(docs)
    judged = near_duplicates(rows, _column(names, "doc_id"), _column(names, "text"), percent=NEAR_PERCENT, carry=ROW).where("kept")
    kept = judged.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(*ROW)).alias("row")).select("row.*")
    kept = kept.unionByName(judged.where("component IS NULL").select(*ROW))
    return _named(rows.join(kept, list(ROW), "left_semi"), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it.

    A null source is a source; null texts have no words and come as often as their source is
    taken whole; repeated rows are taken one by one.
    """
    release(spark)
    rows, names = _numbered(docs)
    mixed = mix(rows, _column(names, "doc_id"), _column(names, "text"), _column(names, "source"), carry=ROW).where("copies > 0")
    taken = rows.join(mixed.select(*ROW, "copies"), list(ROW))
    return _named(taken.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))), names)


def pack_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row with their sequences.

    A null text is an empty one, a piece of one id; a row that stands twice is packed twice.
    """
    release(spark)
    ship(spark)
    return pack(docs, "word_bpe_49k.json")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_rows),
]

#: The language model and the tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
