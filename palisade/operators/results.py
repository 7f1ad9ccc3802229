"""The result record every detector returns, and how the best of several is chosen.

A detector's result is a struct column, null where nothing was detected.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT = "struct<threat_type:string,threat_source:string,confidence_score:int,matched_pattern:string,payload_snippet:string,bot_category:string,bot_label:string>"


def result(
    threat_type: Column, source: Column, score: Column, pattern: Column, snippet: Column | None = None, category: Column | None = None, label: Column | None = None
) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        threat_type.cast("string").alias("threat_type"),
        source.cast("string").alias("threat_source"),
        score.cast("int").alias("confidence_score"),
        pattern.cast("string").alias("matched_pattern"),
        (none if snippet is None else snippet).cast("string").alias("payload_snippet"),
        (none if category is None else category).cast("string").alias("bot_category"),
        (none if label is None else label).cast("string").alias("bot_label"),
    )


def each(found: Column) -> Column:
    """One row for each result that is there.  A filter on it would be pushed under the projection, and its detectors run twice."""
    return F.explode(F.array_compact(F.array(found)))


def nothing() -> Column:
    return F.lit(None).cast(RESULT)


def best(*candidates: Column) -> Column:
    """The highest score; of equal ones the first.  Null if no candidate is there."""
    if not candidates:
        return nothing()
    ranked = F.transform(
        F.array(*[c.cast(RESULT) for c in candidates]),
        lambda c, i: F.when(c.isNotNull(), F.struct(c["confidence_score"].alias("score"), (-i).alias("ord"), c.alias("r"))),
    )
    return F.array_max(F.array_compact(ranked))["r"]
