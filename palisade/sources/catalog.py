"""The bot signature catalogue: ordered categories of ordered needles, read from a text file.

A line ``[name | label | confidence | threat type]`` begins a category, and each line
``"needle"`` after it adds a needle; both are in evaluation order.  Other lines are comments.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from palisade.config import SIGNATURES


@dataclass(frozen=True)
class Signature:
    ord: int
    category: str
    label: str
    confidence: int
    threat_type: str
    needle: str


@functools.cache
def signatures(path: str = SIGNATURES) -> tuple[Signature, ...]:
    out: list[Signature] = []
    with open(path, encoding="utf-8") as f:
        for line in f.read().split("\n"):
            if line[:1] == "[" and line[-1:] == "]":
                category, label, confidence, threat_type = (x.strip() for x in line[1:-1].split("|"))
            elif len(line) > 2 and line[0] == line[-1] == '"':
                out.append(Signature(len(out) + 1, category, label, int(confidence), threat_type, line[1:-1]))
    return tuple(out)


def categories(path: str = SIGNATURES) -> dict[str, list[Signature]]:
    out: dict[str, list[Signature]] = {}
    for s in signatures(path):
        out.setdefault(s.category, []).append(s)
    return out


def signature_table(spark: SparkSession, path: str = SIGNATURES) -> DataFrame:
    """ord, category, label, confidence, threat_type, needle."""
    rows = [(s.ord, s.category, s.label, s.confidence, s.threat_type, s.needle) for s in signatures(path)]
    return spark.createDataFrame(rows, "ord int, category string, label string, confidence int, threat_type string, needle string")
