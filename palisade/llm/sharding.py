"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each level every child of the node draws an
exponential variate from a hash of the row's key and the child's name, divided by the
child's weight; the smallest draw wins, so a child wins in proportion to its weight.
A draw depends on the key and that child alone: raising one weight moves rows only into
that child's subtree, lowering it only out of it, and siblings exchange nothing.

New shards open a region of their own, so growth moves rows into the new shard only
(law ``key``).  Defined results: a null key hashes to a fixed value; equal keys share a
shard, and repeated rows have slots of their own there; null and empty texts have size 1 and
checksum 0; very long texts are one row like others; empty tables give none; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.session import materialise

SEED = 20_240_229
#: Blocks a shard's rows are numbered in; each block is sorted by itself.
BLOCKS = 4096
#: Copies of a row that one row of a task becomes.
COPIES = 8192


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; only shards have a weight of their own and a number."""

    name: str
    children: tuple["Node", ...] = ()
    own_weight: float = 0.0
    shard: int = -1

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def leaf(shard: int, weight: float = 1.0) -> Node:
    return Node(f"shard-{shard}", (), weight, shard)


@dataclass(frozen=True)
class HashTree:
    regions: tuple[Node, ...]

    @staticmethod
    def of(shards: int, per_rack: int = 2, racks: int = 2) -> "HashTree":
        """Equal shards in full racks and regions, as far as they go; the rest in regions of their own."""
        whole = shards - shards % (per_rack * racks)
        regions = []
        for r in range(0, whole, per_rack * racks):
            kids = tuple(Node(f"rack-{k}", tuple(leaf(s) for s in range(k, k + per_rack))) for k in range(r, r + per_rack * racks, per_rack))
            regions.append(Node(f"region-{r}", kids))
        tree = HashTree(tuple(regions))
        for s in range(whole, shards):
            tree = tree.grown(s)
        return tree

    def grown(self, shard: int, weight: float = 1.0) -> "HashTree":
        """With one more shard, in a region and rack of its own."""
        return HashTree((*self.regions, Node(f"region-{shard}", (Node(f"rack-{shard}", (leaf(shard, weight),)),))))

    def place(self, key: Column, seed: int = SEED) -> Column:
        """The shard of a key, as one expression."""
        return _descend(self.regions, key, seed)


def _draw(key: Column, node: Node, seed: int) -> Column:
    """An exponential variate with the node's weight as its rate; 53 bits, never 0 or 1."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}:{node.name}"), key), 11).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(node.weight)


def _descend(nodes: tuple[Node, ...], key: Column, seed: int) -> Column:
    live = [n for n in nodes if n.weight > 0]
    below = lambda n: _descend(n.children, key, seed) if n.children else F.lit(n.shard)
    if len(live) == 1:
        return below(live[0])
    winner = F.array_min(F.array(*[F.struct(_draw(key, n, seed).alias("d"), F.lit(i).alias("i")) for i, n in enumerate(live)]))["i"]
    chosen = F.when(winner == 0, below(live[0]))
    for i, n in enumerate(live[1:], 1):
        chosen = chosen.when(winner == i, below(n))
    return chosen


def shard_rows(docs: DataFrame, tree: HashTree, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    Equal rows are counted first, in part by every task, and only their count moves on; their
    slots follow one another, so it makes no difference which of them gets which.  Slots are
    dealt by block, a share of a shard that a hash of the row gives: counts are summed up for
    each block, blocks of a shard follow one another, and a block numbers its own rows.  Last,
    a count becomes rows again, ``COPIES`` at a time in any task.  No task sorts a whole shard or
    holds what one id has, and the text never leaves the scan.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    rows = docs.select(key.alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    placed = rows.withColumns({"shard": tree.place(F.col("doc_id")), "_block": F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(blocks)).cast("int")})
    placed = materialise(placed, "shards")
    counts = placed.groupBy("shard", "_block").agg(F.sum("_n").alias("_rows"))
    # At most shards x blocks rows, whatever the input: safe to order and to broadcast.
    starts = counts.selectExpr("shard", "_block", "sum(_rows) OVER (PARTITION BY shard ORDER BY _block) - _rows AS _start")
    numbered = placed.join(F.broadcast(starts), ["shard", "_block"]).selectExpr(
        "doc_id", "size", "text_crc32", "shard", "_n", "_start + sum(_n) OVER (PARTITION BY shard, _block ORDER BY doc_id, text_crc32, size) - _n AS _first"
    )
    chunks = numbered.selectExpr("*", f"explode(sequence(0, (_n - 1) div {COPIES})) AS _chunk")
    # Chunks of one row's copies are dealt out anew; most rows are one chunk and stay where they are.
    dealt = chunks.where("_chunk = 0").unionByName(chunks.where("_chunk > 0").repartition("doc_id", "_chunk"))
    copies = f"explode(sequence(_chunk * {COPIES}, least(_n, (_chunk + 1) * {COPIES}) - 1))"
    return dealt.selectExpr("doc_id", "size", "text_crc32", "shard", "_first", f"{copies} AS _copy").selectExpr("doc_id", "size", "text_crc32", "shard", "_first + _copy AS slot")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tree = HashTree.of(8)
    return shard_rows(docs, tree).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        tree.grown(8).place(F.col("doc_id")).alias("grown_shard"),
    )
