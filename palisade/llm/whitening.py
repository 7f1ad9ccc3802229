"""Whitening of embeddings by merged moments.

Every task reduces its vectors to a count, a local mean and a scatter about that mean; two such
triples merge by Chan's formula, pairwise in ``treeReduce``, so the driver gets one matrix of
dimension by dimension, whatever the number of rows.  ``eigh`` runs there.  A second pass
projects every vector, gathers the moments of the projections in the same way, and so measures
how far their covariance is from the identity; the last pass writes the rows.

Vectors are taken as whole numbers, x = floor(scale * c) + shift, so that counts and sums are exact.

Defined results: rows whose vector is null, or holds a null, NaN or infinite entry or one whose x
is beyond 2**53, give no rows.  The fit list has the vectors of the most frequent length (of
equally frequent ones the longest); vectors of other lengths are returned with a null deviation
and null whitened values.  A component without variance (fewer vectors than dimensions, constant
or repeated entries) has null whitened values and is left out of the identity error.  A deviation
beyond a long is null, and whole in ``deviation_decimal`` up to 38 digits.  Null, equal and
repeated ids are passed on row by row; repeated rows count each; an empty table, or one without
vectors, gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Of the trace: an eigenvalue at or below it is that of no variance, given what doubles resolve.
FLAT = 1e-14
LARGEST = float(1 << 53)

#: (count, mean, scatter about the mean, exact sums as Python integers)
Moments = tuple[int, np.ndarray, np.ndarray, list[int]]


def moments(rows: np.ndarray, sums: list[int] | None = None) -> Moments:
    """Of a block of rows: its mean, and the scatter corrected for what rounding left in the mean."""
    mean = rows.mean(axis=0)
    centred = rows - mean
    slip = centred.mean(axis=0)
    scatter = centred.T @ centred - len(rows) * np.outer(slip, slip)
    return len(rows), mean + slip, scatter, sums or []


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's pairwise formula."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    mean = a[1] + gap * (b[0] / n)
    scatter = a[2] + b[2] + np.outer(gap, gap) * (a[0] * (b[0] / n))
    return n, mean, scatter, [x + y for x, y in zip(a[3], b[3])]


class Vectors:
    """The valid vectors of an Arrow column, by length: rows (places in the batch) and whole numbers."""

    def __init__(self, column: pa.Array, scale: int, shift: int):
        flat, lengths = column.flatten(), np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
        held = np.maximum(lengths, 0)
        ends = np.cumsum(held)
        entries = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(invalid="ignore", over="ignore"):
            entries = np.floor(entries * scale) + shift
        bad = np.zeros(len(entries) + 1, np.int64)
        np.cumsum(~(np.abs(entries) <= LARGEST), out=bad[1:])
        self.valid = (lengths >= 0) & (bad[ends] == bad[ends - held])
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(lengths[self.valid]).tolist():
            rows = np.flatnonzero(self.valid & (lengths == n))
            cells = (ends[rows] - n)[:, None] + np.arange(n)
            self.by_length[n] = rows, entries[cells].reshape(len(rows), n).astype(np.int64)


def _reduced(rows: DataFrame, block: Callable[[pa.RecordBatch], dict[int, Moments]]) -> dict[int, Moments]:
    """Moments by length over all rows: merged within a task, then from task to task in a tree."""
    schema = "size long, n long, mean binary, scatter binary, sums array<string>"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, Moments] = {}
        for batch in batches:
            for size, found in block(batch).items():
                have[size] = merged(have[size], found) if size in have else found
        for size, (n, mean, scatter, sums) in have.items():
            yield pa.RecordBatch.from_pylist(
                [{"size": size, "n": n, "mean": mean.tobytes(), "scatter": scatter.tobytes(), "sums": [str(s) for s in sums]}],
                schema=pa.schema([("size", pa.int64()), ("n", pa.int64()), ("mean", pa.binary()), ("scatter", pa.binary()), ("sums", pa.list_(pa.string()))]),
            )

    def opened(row: object) -> dict[int, Moments]:
        mean = np.frombuffer(row.mean)
        return {row.size: (row.n, mean, np.frombuffer(row.scatter).reshape(len(mean), len(mean)), [int(s) for s in row.sums])}

    def both(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
        return {size: merged(a[size], b[size]) if size in a and size in b else a.get(size) or b[size] for size in {**a, **b}}

    parts = rows.mapInArrow(local, schema).rdd.map(opened)
    # A first, empty part: treeReduce wants one.
    return parts.context.union([parts.context.parallelize([{}], 1), parts]).treeReduce(both, 3)


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT
) -> DataFrame:
    """vec_id, component, n, deviation, deviation_decimal, whitened, explained, identity_error: a row for each vector and component."""
    given = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind = given.schema["id"].dataType
    schema = f"vec_id {kind.simpleString()}, component int, n long, deviation long, deviation_decimal decimal(38,0), whitened double, explained double, identity_error double"

    def fitted(batch: pa.RecordBatch) -> dict[int, Moments]:
        vectors = Vectors(batch.column(0), scale, shift)
        return {size: moments(x.astype(np.float64), [int(s) for s in x.sum(axis=0, dtype=object)]) for size, (_, x) in vectors.by_length.items()}

    found = _reduced(given.select("vector"), fitted)
    if not found:
        return rows.sparkSession.createDataFrame([], schema)
    size = max(found, key=lambda k: (found[k][0], k))
    n, _, scatter, sums = found[size]
    value, axes = np.linalg.eigh(scatter / n) if size else (np.zeros(0), np.zeros((0, 0)))
    value, axes = value[::-1][:components].copy(), axes[:, ::-1][:, :components].copy()
    trace = float(np.trace(scatter / n))
    live = value > FLAT * trace if trace > 0 else np.zeros(len(value), bool)
    explained = [float(e / trace) if trace > 0 else None for e in value]
    weights = axes[:, live] / np.sqrt(value[live])

    def centred(x: np.ndarray) -> np.ndarray:
        """n * x - S: whole numbers, as int64 where they surely fit, else as Python integers."""
        bound = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
        kind = np.int64 if bound < 1 << 62 else object
        return n * x.astype(kind) - np.array(sums, kind)

    def projected(batch: pa.RecordBatch) -> dict[int, Moments]:
        vectors = Vectors(batch.column(0), scale, shift)
        if size not in vectors.by_length:
            return {}
        return {size: moments((centred(vectors.by_length[size][1]).astype(np.float64) / n) @ weights)}

    checked = _reduced(given.select("vector"), projected)[size]
    error = float(np.abs(checked[2] / n - np.eye(len(checked[1]))).max(initial=0.0))
    places = np.flatnonzero(live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(value)
        for batch in batches:
            vectors = Vectors(batch.column(1), scale, shift)
            deviation: list[int | None] = [None] * batch.num_rows
            whitened = np.full((batch.num_rows, k), np.nan)
            if size in vectors.by_length:
                at, x = vectors.by_length[size]
                gaps = centred(x)
                whitened[at[:, None], places] = (gaps.astype(np.float64) / n) @ weights
                most = int(np.abs(gaps).max(initial=0))
                squares = gaps if most * most * max(size, 1) < 1 << 63 else gaps.astype(object)
                for i, total in zip(at.tolist(), (squares * squares).sum(axis=1).tolist()):
                    deviation[i] = int(total)
            valid = np.flatnonzero(vectors.valid)
            rows_at = np.repeat(valid, k)
            cells = whitened[valid].reshape(-1)
            told = [deviation[i] for i in valid.tolist() for _ in range(k)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows_at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(valid))),
                    pa.array(np.full(len(rows_at), n, np.int64)),
                    pa.array([d if d is not None and d < 1 << 63 else None for d in told], pa.int64()),
                    pa.array([Decimal(d) if d is not None and d < 10**38 else None for d in told], pa.decimal128(38, 0)),
                    pa.array(cells, mask=np.isnan(cells)),
                    pa.array(explained * len(valid), pa.float64()),
                    pa.array(np.full(len(rows_at), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "deviation_decimal", "whitened", "explained", "identity_error"],
            )

    return given.mapInArrow(run, schema)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
