"""A trie of conversations by chained prefix digests.

A turn's digest is the SHA-256 of its role and text.  Along a conversation the digests are
chained, so the digest of a prefix of d turns stands for all of them: nodes of the trie are
groups of (depth, digest), and no text or sequence is compared or moved.

Subtree sums: every node is exploded to all of its ancestors.  The nodes that a conversation is
the least member of lie on its own path, from some depth down to its end, as members of a deeper
node are members of those above.  So the explosion goes along that one path: a running sum from
its end up gives each ancestor what the path's own nodes add to it.  That is one row for each
prefix, where a row for each node and ancestor would grow with the square of the length.

A node that many conversations pass through, such as the root, is summed in part by every task
before it is shuffled.  Children look up their parent: the at most 1,000 parents that have a
thousandth of all nodes for children are broadcast, the others joined.  The ids that end in a
node are sorted by ranges, written out in runs of bounded bytes, and the runs of a node are
hashed in order by one task that holds a hash state and no list.

Defined results: a null role or text is an empty one.  Turns are ordered by turn, null first;
equal turns by their digest; repeated rows are turns of their own.  Rows without a conv_id
belong to no conversation and make no node.  Very long texts are digested where they stand.  An
empty table has no nodes, not even a root.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.session import materialise

#: Bytes of a chained digest that are kept as its name: 128 bits.
NAME = 16
ROOT = hashlib.sha256(b"").digest()
#: Bytes of ids in one run.
RUN_BYTES = 1 << 16
#: A parent with so large a share (1 of HOT) of all nodes for children is looked up by broadcast: there are HOT of them at most.
HOT = 1000


def turn_digests(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (from 0), turn_digest and n_bytes (of the text) of every turn."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    told = F.concat(F.octet_length(empty(role_col)).cast("string"), F.lit(":"), empty(role_col), empty(text_col))
    turns = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.unhex(F.sha2(told, 256)).alias("turn_digest"), F.octet_length(empty(text_col)).cast("long").alias("n_bytes")
    ).where("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_digest")
    return turns.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "turn_digest", "n_bytes")


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent, digest, n_bytes, ends of every prefix of every conversation; a row without a turn_digest only tells that the conversation is there."""
    names = ["conv_id", "depth", "parent", "digest", "n_bytes", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, chain = None, None, ROOT
        for batch in batches:
            out = []
            for c, d, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if c != conv:
                    if held:
                        out.append((*held, True))
                    conv, chain, held = c, ROOT, (c, 0, None, ROOT[:NAME], 0)
                if d is not None:
                    out.append((*held, False))
                    above, chain = chain, hashlib.sha256(chain + d).digest()
                    held = (c, held[1] + 1, above[:NAME], chain[:NAME], n)
            yield made(out)
        if held:
            yield made([(*held, True)])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "turn_digest", "n_bytes")
    return ordered.mapInArrow(run, "conv_id long, depth long, parent binary, digest binary, n_bytes long, ends boolean")


def _ends(prefixes: DataFrame) -> DataFrame:
    """digest, ends_sha256: of the ids of the conversations that end in a node, ascending and joined by commas."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for d, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if d != node or size > RUN_BYTES:
                    if ids:
                        out.append((node, first, ",".join(ids)))
                    node, first, ids, size = d, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield told(out)
        if ids:
            yield told([(node, first, ",".join(ids))])

    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.string()))], names=["digest", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for d, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if d == node:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    out.append((node, state.hexdigest()))
                node, state = d, hashlib.sha256(ids.encode())
            yield named(out)
        if state:
            yield named([(node, state.hexdigest())])

    def named(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.string()))], names=["digest", "ends_sha256"])

    ended = prefixes.where("ends").select("digest", "conv_id")
    sorted_ids = ended.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    pieces = sorted_ids.mapInArrow(runs, "digest binary, first long, ids string")
    return pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(hashed, "digest binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of ``turns`` (conv_id, place, turn_digest, n_bytes; see ``turn_digests``).

    conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, (n_convs - 1) * n_bytes), ends_sha256, digest.
    """
    prefixes = materialise(_prefixes(turns), "prefixes")
    nodes = prefixes.groupBy("depth", "digest").agg(
        F.min("conv_id").alias("conv_id"), F.min("parent").alias("parent"), F.max("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_convs")
    )
    nodes = materialise(nodes, "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(nodes.join(children, ["depth", "digest"], "left").fillna(0, ["n_children"]), "nodes")

    # Each conversation's path from its end up; before a prefix stands the node that the conversation owns there.
    none = F.lit(0).cast("long")
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    own = nodes.select("conv_id", "depth", F.lit(None).cast("binary").alias("digest"), saved.alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), F.lit(1).alias("owned"))
    path = own.unionByName(prefixes.select("conv_id", "depth", "digest", none.alias("saved"), none.alias("leaves"), F.lit(0).alias("owned")))
    upward = Window.partitionBy("conv_id").orderBy(F.col("depth").desc(), F.col("owned").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = path.select("depth", "digest", *[F.sum(c).over(upward).alias(c) for c in ("saved", "leaves", "owned")]).where("digest IS NOT NULL AND owned > 0")
    subtrees = sums.groupBy("depth", "digest").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    parents = nodes.select(F.col("digest").alias("above"), F.col("conv_id").alias("above_conv_id"), "n_children").where("n_children > 0")
    hot = F.col("n_children") * HOT >= nodes.count()
    known = nodes.join(F.broadcast(parents.where(hot).select(F.col("above").alias("parent"), F.col("above_conv_id").alias("hot_conv_id"))), "parent", "left")
    # A node whose parent was found goes to the other join under its own name, so that its siblings don't meet in one task.
    known = known.withColumn("above", F.when(F.col("hot_conv_id").isNotNull() | F.col("parent").isNull(), F.col("digest")).otherwise(F.col("parent")))
    known = known.join(parents.where(~hot).drop("n_children"), "above", "left")
    parent = F.when(F.col("parent").isNotNull(), F.coalesce("hot_conv_id", "above_conv_id"))
    nobody = hashlib.sha256(b"").hexdigest()
    known = known.select("depth", "digest", "conv_id", parent.alias("parent_conv_id"), "n_convs", "n_children")
    return (
        known.join(subtrees, ["depth", "digest"])
        .join(_ends(prefixes), "digest", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"), "digest")
    )


# The conversations of op12: shared openings make a trie with deep common prefixes.
FAMILY, SPAN = 5, 9


def _opening(conv: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % SPAN


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation's own turns after its first h, and before them the first h of its family's first conversation, where there is one.

    Families are c - c % 5 (of a negative c the multiple of 5 at or below it).  Every conv_id
    gets a row without a turn, so that one left without turns is known.
    """
    step = F.pmod(F.col("conv_id"), F.lit(FAMILY))
    own = turns.where((step == 0) | (F.col("place") >= _opening(F.col("conv_id"))))
    there = turns.select("conv_id").distinct()
    heads = turns.where((step == 0) & (F.col("place") < SPAN - 1))
    heads = heads.withColumn("conv_id", F.explode(F.sequence(F.col("conv_id") + 1, F.col("conv_id") + FAMILY - 1)))
    heads = heads.where(F.col("place") < _opening(F.col("conv_id"))).join(there, "conv_id", "left_semi")
    marks = there.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn_digest"), F.lit(0).cast("long").alias("n_bytes"))
    return own.unionByName(heads).unionByName(marks)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialise(turn_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return prefix_trie(rebuilt(turns)).drop("digest")


# DuckDB has no crc32: eight steps for each byte of the decimal.
_BYTE = "list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda s, b: {_BYTE}))"
OP12_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place,
         {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
turns AS (
  SELECT v.c, t.place, t.t FROM convs AS v JOIN t ON t.c = v.base AND t.place < v.h
  UNION ALL SELECT v.c, t.place, t.t FROM convs AS v JOIN t ON t.c = v.c AND t.place >= v.h),
paths AS (SELECT v.c, coalesce(p.path, []) AS path FROM convs AS v LEFT JOIN (SELECT c, list(t ORDER BY place) AS path FROM turns GROUP BY c) AS p USING (c)),
prefixes AS (SELECT c, d, path[1:d] AS p, d = len(path) AS ends FROM (SELECT c, path, unnest(range(len(path) + 1)) AS d FROM paths)),
nodes AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(p[d].text) END AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY d, p),
leaves AS (SELECT n.*, (SELECT count(*) FROM nodes AS k WHERE k.d = n.d + 1 AND k.p[1:n.d] = n.p) AS n_children FROM nodes AS n)
SELECT n.conv_id, n.d AS depth, any_value(u.conv_id) AS parent_conv_id, n.n_convs, n.n_children,
       count(*) FILTER (s.n_children = 0) AS n_leaves, CAST(sum(s.saved) AS BIGINT) AS saved_tokens, n.ends_sha256
FROM leaves AS n JOIN leaves AS s ON s.d >= n.d AND s.p[1:n.d] = n.p LEFT JOIN nodes AS u ON u.d = n.d - 1 AND u.p = n.p[1:n.d - 1]
GROUP BY n.d, n.p, n.conv_id, n.n_convs, n.n_children, n.ends_sha256
"""
