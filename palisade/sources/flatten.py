"""Nested request inputs to ordered leaves: JSON text to an array of path and value, in document order.

Only string leaves are kept; the form tokens ``_token`` and ``_method`` at the top are not.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LEAVES = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))


def leaves(value: object) -> list[dict[str, str]]:
    """String leaves depth first; iterative, so nesting depth is no limit."""
    out: list[dict[str, str]] = []
    stack: list[tuple[str, object]] = [("", value)]
    while stack:
        path, now = stack.pop()
        if isinstance(now, str):
            out.append({"path": path, "value": now})
        elif isinstance(now, dict | list):
            items = list(now.items()) if isinstance(now, dict) else list(enumerate(now))
            for key, child in reversed(items):
                if path == "" and key in ("_token", "_method"):
                    continue
                stack.append((f"{path}.{key}" if path else str(key), child))
    return out


def flatten_json(rows: DataFrame, column: str, into: str = "inputs") -> DataFrame:
    """Add the leaves of a JSON column; text that is no JSON, and null, give none."""
    names = [f.name for f in rows.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(batch.schema.get_field_index(column)).to_pylist():
                try:
                    found.append(leaves(json.loads(text)) if text else [])
                except (ValueError, RecursionError):
                    found.append([])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, LEAVES)], names=[*names, into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{into}` array<struct<path:string,value:string>>")
