"""MinHash near-dedup with odd sketches.

1. Every document becomes a shingle set, named by a hash of the set; documents with equal
   sets share the name and go on as one.  MinHash samples give ``BANDS`` band keys and, folded
   into a parity bitmap, an odd sketch.  24 bands of 5 samples miss a pair at similarity 0.85
   with probability (1 - 0.85**5)**24 < 1e-6.
2. Sets that share a band key form a bucket.  Buckets with the same members (a cluster meets
   in many bands) are tested once.
3. A bucket's members come together with their full sets, and links are confirmed on those.
   Odd sketches and sizes rule pairs out first.  What is needed is which members hang
   together, not all pairs: links join members into clusters, only members outside the largest
   cluster are compared with the rest, and a bucket ends when nothing is left outside.  Links
   leave as a spanning forest, so a bucket of m sends fewer than m rows.
   A bucket over ``BLOCK`` members is cut into blocks, and each block meets the bucket's
   representative, which most near copies hang together with.  Only members that are not in
   its cluster then meet every block, in blocks of their own: no link is lost, and a bucket
   of near copies of one text costs in proportion to its members.
4. Components of the links, by large-star and small-star steps, give each document the
   smallest doc_id it can reach.

Defined results: null and empty texts, and texts without words, have no shingles and are
linked with nothing; a null doc_id takes part and is never a component's id unless its
component has no other; rows that repeat a doc_id share its verdict, and repeated rows are one
text; very long texts are whole sets; empty tables give none; other columns pass by name where
carried and else are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.components import connected_components
from palisade.llm.kernel import slices
from palisade.llm.shingles import BANDS, ROWS, SHINGLE, SKETCH_BITS, Shingles, bands, largest_xor, odd_sketches
from palisade.session import materialise, release

#: Linked: 100 * common >= PERCENT * union.
PERCENT = 85
#: How far below the threshold a sketch's estimate still leads to an exact test (five deviations).
MARGIN = 0.20
BLOCK = 2048
#: A member's block.
OWN = "CAST(pmod(xxhash64(node, 7), g) AS INT) AS own"


def features(rows: DataFrame, k: int) -> DataFrame:
    """(text, doc_id, tkey, ...) -> node, n, bands, sketch, doc_id, tkey, ..."""
    others = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = Shingles(part.column(0), k)
            full = sets.sizes > 0
            signatures = sets.signatures()
            keys = bands(signatures).view(np.int64)
            place = np.cumsum(full) - 1
            ends = np.zeros(len(full) + 1, np.int32)
            np.cumsum(full * keys.shape[1], out=ends[1:])
            sketches = iter(odd_sketches(signatures))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sets.names().view(np.int64)),
                    pa.array(sets.sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1))),
                    pa.array([next(sketches).tobytes() if f else None for f in full.tolist()], pa.binary()),
                    *part.columns[1:],
                ],
                names=["node", "n", "bands", "sketch", *names],
            )

    names = [f.name for f in others]
    schema = "".join(f", {f.name} {f.dataType.simpleString()}" for f in others)
    return rows.select("text", *names).mapInArrow(run, f"node long, n long, bands array<long>, sketch binary{schema}")


def full_sets(rows: DataFrame, k: int) -> DataFrame:
    """(text, node, n, sketch) -> node, n, sketch, hashes (sorted, as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = Shingles(part.column(0), k)
            hashes = [np.sort(sets.hashes[a:b]).tobytes() for a, b in zip(sets.first[:-1].tolist(), sets.first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), pa.array(hashes, pa.binary())], names=["node", "n", "sketch", "hashes"])

    return rows.select("text", "node", "n", "sketch").mapInArrow(run, "node long, n long, sketch binary, hashes binary")


def one_each(sets: DataFrame) -> DataFrame:
    """One row a node; tasks drop their own copies before anything is shuffled."""
    return sets.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "hashes")])


def links_within(
    node: np.ndarray, sketch: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, percent: int, far: int, joined: np.ndarray | None = None
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links among members, as pairs (i, j) of their places, and each member's cluster.

    ``joined``: members that are known to hang together; no links among them are looked for.
    """
    m = len(node)
    _, ids = np.unique(hashes, return_inverse=True)
    starts = np.zeros(m, np.int64)
    np.cumsum(sizes[:-1], out=starts[1:])
    mark = np.zeros(int(ids.max()) + 1, bool)
    cluster, tested, out = np.arange(m), np.zeros(m, bool), []
    home = None
    if joined is not None and joined.any():
        home = int(joined.argmax())
        cluster[joined], tested[joined] = home, True
    while True:
        most = cluster[home] if home is not None else np.bincount(cluster, minlength=m).argmax()
        outside = np.flatnonzero((cluster != most) & ~tested)
        if not len(outside):
            return out, cluster
        p = int(outside[0])
        tested[p] = True
        near = (cluster != cluster[p]) & (100 * np.minimum(sizes, sizes[p]) >= percent * np.maximum(sizes, sizes[p]))
        near &= np.bitwise_count(sketch ^ sketch[p]).sum(axis=1) <= far
        if not near.any():
            continue
        mine = ids[starts[p] : starts[p] + sizes[p]]
        mark[mine] = True
        common = np.add.reduceat(mark[ids].astype(np.int64), starts)
        mark[mine] = False
        for j in np.flatnonzero(near & (100 * common >= percent * (sizes + sizes[p] - common))).tolist():
            if cluster[j] != cluster[p]:
                out.append((p, j))
                cluster[cluster == cluster[j]] = cluster[p]


def bucket_links(table: pa.Table, percent: int, far: int) -> pa.Table:
    """(node, n, sketch, hashes, bkey, lead, joined) of a group -> links a, b; and with a ``lead``, the members outside its cluster as a, null, bkey."""
    node = table.column("node").to_numpy()
    # A node that is there twice: as the lead, and as no joined member, comes first.
    order = np.lexsort((table.column("joined").to_numpy(zero_copy_only=False), ~table.column("lead").to_numpy(zero_copy_only=False), node))
    node, first = np.unique(node[order], return_index=True)
    table = table.take(pa.array(order[first]))
    sizes = table.column("n").to_numpy()
    hashes = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
    pairs, cluster = links_within(node, sketch, hashes, sizes, percent, far, table.column("joined").to_numpy(zero_copy_only=False))
    at = np.array(pairs, np.int64).reshape(-1, 2)
    lead = np.flatnonzero(table.column("lead").to_numpy(zero_copy_only=False))
    alone = node[cluster != cluster[lead[0]]] if len(lead) else node[:0]
    bkey = table.column("bkey")[0].as_py()
    return pa.table(
        {
            "a": np.concatenate([node[at[:, 0]], alone]),
            "b": pa.array(np.concatenate([node[at[:, 1]], alone]), mask=np.arange(len(at) + len(alone)) >= len(at)),
            "bkey": pa.array([None] * len(at) + [bkey] * len(alone), pa.int64()),
        }
    )


def visits(members: DataFrame, alone: DataFrame, block: int) -> DataFrame:
    """Groups in which the members outside their lead's cluster, in blocks, meet every block of their bucket."""
    turns = alone.groupBy("bkey").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("turns"))
    told = members.where("g > 1").join(turns, "bkey").join(alone.withColumn("alone", F.lit(True)), ["node", "bkey"], "left")
    told = materialise(told.selectExpr("node", "bkey", "g", "turns", OWN, "alone IS NULL AS joined"), "told")
    blocks = told.selectExpr("node", "bkey", "own", "explode(sequence(0, turns - 1)) AS turn", "joined")
    visitors = told.where("NOT joined").selectExpr("node", "bkey", "explode(sequence(0, g - 1)) AS own", "CAST(pmod(xxhash64(node, 11), turns) AS INT) AS turn", "joined")
    return blocks.unionByName(visitors).withColumn("lead", F.lit(False))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, component (a name for it; null for empty sets), and the columns to carry."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tkey"), *carry)
    feats = materialise(features(rows, k), "features")
    nodes = feats.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "tkey")).alias("rep"))

    # One row for each band of each distinct set.
    banded = (
        feats.where("n > 0")
        .join(nodes.select("node", F.col("rep.doc_id").alias("r_id"), F.col("rep.tkey").alias("r_key")), "node")
        .where("doc_id <=> r_id AND tkey = r_key")
    )
    keys = materialise(banded.select("node", F.explode("bands").alias("bkey")).distinct(), "bands")
    release(docs.sparkSession)
    buckets = (
        keys.groupBy("bkey")
        .agg(F.count(F.lit(1)).alias("m"), F.sum(F.shiftright(F.xxhash64("node"), 20)).alias("members"), F.max("node").alias("top"))
        .where("m > 1")
        .groupBy("m", "members", "top")
        .agg(F.min("bkey").alias("bkey"))
        .selectExpr("bkey", "top AS lead", f"CAST(ceil(m / {block}) AS INT) AS g")
    )
    members = materialise(keys.join(buckets, "bkey"), "members")
    release(docs.sparkSession)

    wanted = members.select("node").distinct()
    reps = nodes.join(wanted, "node", "left_semi").select("node", F.col("rep.doc_id").alias("r_id"), F.col("rep.tkey").alias("r_key"))
    parts = feats.where("n > 0").select("doc_id", "tkey", "node", "n", "sketch")
    chosen = parts.join(reps, "node").where("doc_id <=> r_id AND tkey = r_key").select("r_id", "r_key", "node", "n", "sketch").distinct()
    texts = rows.select("text", "doc_id", "tkey").join(chosen, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("tkey") == F.col("r_key")))
    # Rows that repeat a node's id and text are one set from here on: a bucket never holds copies.
    sets = one_each(full_sets(texts, k))

    far = largest_xor(percent / 100 - MARGIN, BANDS * ROWS, SKETCH_BITS)

    def linked(dealt: DataFrame) -> DataFrame:
        groups = dealt.join(sets, "node").groupBy("bkey", "own", "turn")
        return materialise(groups.applyInArrow(lambda table: bucket_links(table, percent, far), "a long, b long, bkey long"), "links")

    # A small bucket is its only block; each block of a large one has its lead with it.
    small = members.where("g = 1").selectExpr("node", "bkey", "0 AS own", "false AS lead")
    large = members.where("g > 1").selectExpr("node", "bkey", OWN, "node = lead AS lead")
    leads = members.where("g > 1 AND node = lead").selectExpr("node", "bkey", "explode(sequence(0, g - 1)) AS own", "true AS lead")
    first = linked(small.unionByName(large).unionByName(leads).selectExpr("*", "0 AS turn", "false AS joined"))
    release(docs.sparkSession)

    alone = first.where("b IS NULL").selectExpr("a AS node", "bkey").distinct()
    links = first.where("b IS NOT NULL").select("a", "b")
    if not alone.isEmpty():
        links = links.unionByName(linked(visits(members, alone, block)).select("a", "b"))
    labels = connected_components(links)
    release(docs.sparkSession)

    named = (
        feats.where("n > 0")
        .groupBy("node")
        .agg(F.min("doc_id").alias("least"))
        .join(labels, "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"), "least")
    )
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select(F.col("node").alias("c_node"), "component_id", "component")
    size, nothing = F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component")
    single = feats.where("n = 0").select("doc_id", size, F.col("doc_id").alias("component_id"), nothing, *carry)
    grouped = feats.where("n > 0").join(named, F.col("node") == F.col("c_node")).select("doc_id", size, "component_id", "component", *carry)
    return grouped.unionByName(single).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")
