"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a minimum per node (partially aggregated, so a hub sends one row a task) and a
join back, and its result is written to the shared folder.  No node, edge or label reaches
the driver; it sees one count and checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.session import materialise, release


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to its least neighbour: the larger ones, or itself and the smaller ones."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long names -> (node, component), the component named by its least node.

    Nodes without a link to another one are absent.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        now = materialise(_step(_step(now, True), False), "edges")
        release(edges.sparkSession)  # a round is some ten shuffles, and what the driver keeps of each adds up
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20)).alias("s")).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
