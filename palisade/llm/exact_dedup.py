"""Exact dedup over a persistent digest index, bucketed and sorted by digest.

The index holds one row per distinct text: digest, keep_id (the largest doc_id that
carries it) and group_size.  It lives at a path as a bucketed, sorted Parquet table.
New data is reduced to one row per digest (partial aggregation first, so a text copied a
billion times sends one row per task), anti-joined to the index by sort-merge, and what
is new is appended; a digest the index has already keeps its row.

Defined results: a null text is an empty one.  Null doc_ids count in group_size, and a
group without any doc_id keeps a null keep_id.  Rows that repeat a doc_id and text count
separately; all rows with the kept doc_id are marked kept.  Empty and very long texts are
texts like others; empty tables give none; other columns pass by name where carried and else
are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.session import materialise, scratch_path


#: A text with so large a share (1 of HOT) of all rows is looked up by broadcast: there are HOT of them at most.
HOT = 1000


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class DigestIndex:
    """Digests seen so far, at ``path``; open it again with the same path and buckets.

    Without a number, there are as many buckets as the session's shuffle partitions, so
    that appending writes one file a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        if not spark.catalog.tableExists(self.table):
            spark.sql(
                f"CREATE TABLE {self.table} (digest STRING, keep_id BIGINT, group_size BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
            )

    def read(self) -> DataFrame:
        """As a bucketed table: joins on digest need no shuffle or sort of this side."""
        return self.spark.table(self.table)

    def rows(self) -> DataFrame:
        """The same files without their bucketing, for joins in which Spark may split a frequent digest."""
        return self.spark.read.schema("digest STRING, keep_id BIGINT, group_size BIGINT").parquet(self.path)

    def unseen(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row for each digest of ``docs`` that the index lacks."""
        groups = (
            docs.select(F.col(id_col).cast("long").alias("id"), digest(F.col(text_col)).alias("digest"))
            .groupBy("digest")
            .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        )
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            groups = materialise(groups, "digests")  # written, a row for each text is dealt to the index's buckets, and the index stays
        # The count in the condition keeps the join above the sums: on digests alone Spark would push it below them, to every row.
        seen = self.read().select(F.col("digest").alias("seen")).hint("merge")
        return groups.join(seen, (F.col("digest") == F.col("seen")) & (F.col("group_size") > 0), "left_anti")

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add what the index lacks."""
        (
            self.unseen(docs, id_col, text_col)
            .repartition(self.buckets, "digest")
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Take the index out of the session's catalog; its files stay, and opening the path again reads them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_dedup(
    docs: DataFrame,
    index_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Every row of ``docs`` with its group: id, digest, keep_id, group_size, kept, and the columns to carry.

    With an ``index_path`` from earlier data, groups and kept rows are those of the first
    batch that brought the text, so a text seen before keeps no row of this batch.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, index_path or scratch_path(spark, "digests"), buckets)
    index.append(docs, id_col, text_col)
    index.close()
    groups = index.rows()
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    hot = F.col("group_size") * HOT >= total
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"), *carry)
    # Rows of hot texts meet their group where they are, and go to the other join under a name of their own, which no task has many of.
    rows = rows.join(F.broadcast(groups.where(hot).selectExpr("digest AS h_digest", "keep_id AS h_keep", "group_size AS h_size")), F.col("digest") == F.col("h_digest"), "left")
    rows = rows.withColumn("_key", F.when(F.col("h_digest").isNull(), F.col("digest")).otherwise(F.monotonically_increasing_id().cast("string")))
    rows = rows.join(groups.where(~hot).withColumnRenamed("digest", "_key"), "_key", "left")
    met = F.col("h_digest").isNotNull()
    rows = rows.withColumns({"keep_id": F.when(met, F.col("h_keep")).otherwise(F.col("keep_id")), "group_size": F.when(met, F.col("h_size")).otherwise(F.col("group_size"))})
    return rows.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), *carry)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
