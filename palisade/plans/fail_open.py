"""Fail open: rows that break a detector are set aside, their requests pass, and all other rows are judged.

A detector is a column expression, and one row on which it fails fails its whole stage.  So the
rows are judged together first; only where that fails are they split, again and again, until
the rows that fail stand alone.  A batch without such rows is judged once and costs no more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.config import Config
from palisade.plans import pipeline
from palisade.session import discard, materialise
from palisade.sources.threat_log import DEAD

#: Parts that failing rows are split into.
PARTS = 16
#: Failing parts that are split at most; what is left then is set aside as it is.
SPLITS = 64


def fail_open(rows: DataFrame, judge: Callable[[DataFrame], DataFrame], phase: int = 0, key: str = "request_id", parts: int = PARTS, splits: int = SPLITS) -> tuple[DataFrame, DataFrame]:
    """``judge`` of all rows on which it works, written; and dead letters of those on which it fails.

    A judge that fails without any row is broken, and its error is raised.  No row is lost: each is
    judged or is a dead letter.  ``judge`` must treat rows one by one.
    """
    try:
        return materialise(judge(rows), "judged"), rows.sparkSession.createDataFrame([], DEAD)
    except Exception:
        materialise(judge(rows.where(F.lit(False))), "judged")
    # What arrives is read once from here on.
    given = materialise(rows.withColumn("_deal", F.xxhash64(key, F.monotonically_increasing_id())), "given")
    plain = given.drop("_deal")
    good: list[DataFrame] = []
    dead: list[DataFrame] = []
    waiting, split = [(given, 0, None)], 0
    while waiting:
        part, depth, size = waiting.pop()
        told = part.drop("_deal")
        try:
            good.append(materialise(judge(told), "judged"))
            continue
        except Exception as e:
            why = str(e).strip().split("\n")[0][:500]
        if split >= splits or depth > 14 or size == 1:
            letter = told.select(F.col(key).cast("long").alias("request_id"), F.lit(phase).alias("phase"), F.lit(why).alias("error"), F.to_json(F.struct(*plain.columns)).alias("row"))
            dead.append(letter)
            continue
        split += 1
        turn = F.pmod(F.shiftright("_deal", 4 * depth), F.lit(parts))
        waiting += [(part.where(turn == r.turn), depth + 1, r["count"]) for r in part.groupBy(turn.alias("turn")).count().collect()]
    found = good[0] if good else materialise(judge(plain.where(F.lit(False))), "judged")
    for more in good[1:]:
        found = found.unionByName(more)
    # None where the first failure did not come from a row, as when a machine was lost.
    letters = rows.sparkSession.createDataFrame([], DEAD)
    for more in dead:
        letters = letters.unionByName(more)
    letters = materialise(letters, "dead")
    discard(given)
    return found, letters


def outcomes(requests: DataFrame, responses_df: DataFrame | None = None, config: Config = Config(), robots_text: str | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """``pipeline.outcomes`` and dead letters: a request or a response that cannot be judged counts as clean."""
    found, dead = fail_open(requests, lambda rows: pipeline.verdicts_of(rows, config, robots_text))
    leaks = None
    if responses_df is not None:
        leaks, more = fail_open(responses_df, lambda rows: pipeline.leaking(rows, config), 1)
        dead = dead.unionByName(more)
    return pipeline.answers(requests, found, leaks, config), dead
