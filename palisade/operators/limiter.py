"""The rate limiter: a fixed window that the first hit opens, for each address and user agent.

Batch: rows go to their key's partition, sorted by time, and one pass with a few bytes of state
gives each its verdict; no group is held in memory.  A key with more attempts than one task
should take is cut into slices of time, which many tasks work on (``hot_verdicts``).  Streaming:
a key's window is Spark's state (``limit_stream``).

Defined results: an attempt without a time is in no window; it passes and counts for none.  A
null key is a key.  Attempts of equal time are in the order of their request_id, equal ids in
any order.  Repeated rows are attempts of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palisade.config import Config
from palisade.session import materialise


def rate_key() -> Column:
    ua = F.coalesce(F.col("user_agent"), F.lit(""))
    return F.concat(F.lit("limit:"), F.coalesce(F.col("ip"), F.lit("")), F.lit(":"), F.substring(F.md5(ua.cast("binary")), 1, 8))


def verdicts(times: np.ndarray, opened: int | None, hits: int, most: int, decay: int) -> tuple[np.ndarray, int | None, int]:
    """Which of a key's sorted attempts (microseconds) pass, given its open window and the hits in it; and those afterwards.

    One step for each window: past the limit an attempt changes nothing.
    """
    allowed, at, n = np.zeros(len(times), bool), 0, len(times)
    while at < n:
        if opened is None or times[at] >= opened + decay:
            opened, hits = int(times[at]), 0
        end = int(np.searchsorted(times, opened + decay, "left"))
        taken = max(0, min(most - hits, end - at))
        allowed[at : at + taken] = True
        hits, at = hits + taken, max(end, at + 1)
    return allowed, opened, hits


#: A key with more attempts than this is judged slice by slice.
SLICE_ROWS = 1_000_000
#: Nodes of the scan over a key's cells that one task walks through.
FAN = 64
#: No window is open: one that expired before any time.
EXPIRED = -(1 << 62)


def limit(
    attempts: DataFrame, config: Config = Config(), counted: str | None = None, carry: tuple[str, ...] = (), slice_rows: int = SLICE_ROWS  # noqa: B008
) -> DataFrame:
    """(request_id, ts, rate_key) -> request_id, rate_key, allowed, and the columns to carry.

    ``counted`` names a boolean column: rows where it isn't true are no attempts, and their
    verdict is null.  An attempt without a time is in no window: it is allowed and counts for none.
    Keys with more than ``slice_rows`` attempts are cut into slices of about that many.
    """
    rows = attempts.select("request_id", "ts", "rate_key", (F.lit(True) if counted is None else F.coalesce(F.col(counted), F.lit(False))).alias("counted"), *carry)
    # Written once: attempts are what detection found, and they are counted before they are judged.
    rows = materialise(rows, "attempts")
    timed = F.col("counted") & F.col("ts").isNotNull()
    if rows.where(timed).count() <= slice_rows:
        return _whole_keys(rows, config, carry)
    # At most one in ``slice_rows`` attempts names a key here, so the list of hot keys is small beside the attempts.
    hot = rows.where(timed).groupBy("rate_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > slice_rows).select(F.col("rate_key").alias("hot_key"))
    hot = materialise(hot, "hot_keys")
    if hot.isEmpty():
        return _whole_keys(rows, config, carry)
    same = F.col("rate_key").eqNullSafe(F.col("hot_key"))
    busy = rows.join(F.broadcast(hot), same, "left_semi")
    untimed = busy.where(~timed).select("request_id", "rate_key", F.when(F.col("counted"), F.lit(True)).alias("allowed"), *carry)
    sliced = hot_verdicts(busy.where(timed), config, carry, slice_rows)
    return _whole_keys(rows.join(F.broadcast(hot), same, "left_anti"), config, carry).unionByName(untimed).unionByName(sliced)


def _whole_keys(rows: DataFrame, config: Config, carry: tuple[str, ...]) -> DataFrame:
    """Each key in one task, in order of time."""
    most, decay = config.max_attempts, config.decay_minutes * 60_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, opened, hits = None, None, 0
        for batch in batches:
            times = batch.column(1).cast(pa.timestamp("us")).cast(pa.int64())
            attempt = batch.column(3).to_numpy(zero_copy_only=False)
            timed = times.is_valid().to_numpy(zero_copy_only=False) & attempt
            times = times.fill_null(0).to_numpy()
            keys = np.array(batch.column(2).to_pylist(), object)
            allowed = np.ones(len(keys), bool)
            edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
            for a, b in zip(edges, [*edges[1:], len(keys)]):
                if keys[a] != key:
                    key, opened, hits = keys[a], None, 0
                mine = a + np.flatnonzero(timed[a:b])
                allowed[mine], opened, hits = verdicts(times[mine], opened, hits, most, decay)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(allowed, mask=~attempt), *batch.columns[4:]], names=names)

    names = ["request_id", "rate_key", "allowed", *carry]
    sorted_rows = rows.repartition("rate_key").sortWithinPartitions("rate_key", "ts", "request_id")
    carried = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return sorted_rows.mapInArrow(run, f"request_id long, rate_key string, allowed boolean{carried}")


def hot_verdicts(rows: DataFrame, config: Config, carry: tuple[str, ...] = (), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The same for keys whose attempts are too many for one task: (request_id, ts, rate_key), every row an attempt with a time.

    Attempts are sorted by key and time into slices.  Time is also cut into cells as long as a
    window, so at most one window opens in a cell: the first attempt of the cell at or after the
    end of the window that was open when the cell began.  A cell is therefore a map from the
    window open at its entry to the one open at its exit.  Such maps compose, and a tree of them
    gives each cell its true entry (``_entries``).  Then every attempt knows its window, and its
    place in it is its place in the slice plus what earlier slices hold of that window.

    A task holds a slice of rows, or the distinct times of one cell and the map of some cells.
    """
    spark = rows.sparkSession
    most, decay = config.max_attempts, config.decay_minutes * 60_000_000
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = rows.select("request_id", "rate_key", us.alias("us"), *carry).withColumn("cell", F.floor(F.col("us") / decay))
    slices = max(1, -(-timed.count() // slice_rows))
    timed = materialise(timed.repartitionByRange(slices, "rate_key", "us", "request_id").withColumn("slice", F.spark_partition_id()), "slices")

    times = timed.select("rate_key", "cell", "us").distinct().groupBy("rate_key", "cell").agg(F.array_sort(F.collect_list("us")).alias("times"))
    cells = materialise(_entries(times, decay), "cells")
    # The cells of a slice: a slice looks up no more than it has, and no two slices meet in a task.
    held = timed.groupBy("slice", "rate_key", "cell").agg(F.count(F.lit(1)).alias("n")).drop("n")
    held = held.join(cells, F.expr("rate_key <=> cell_key AND cell = cell_of")).select("slice", F.col("rate_key").alias("held_key"), F.col("cell").alias("held_cell"), "open_before", "opens_at")
    placed = timed.alias("t").join(held.alias("h"), F.expr("t.slice = h.slice AND t.cell = h.held_cell AND t.rate_key <=> h.held_key"))
    window = F.when(F.col("us") >= F.col("opens_at"), F.col("opens_at")).otherwise(F.col("open_before"))
    placed = placed.select("t.slice", "request_id", "rate_key", "us", window.alias("opened"), *carry)
    order = Window.partitionBy("slice", "rate_key", "opened").orderBy("us", "request_id")
    placed = placed.withColumn("place", F.row_number().over(order))
    sizes = placed.groupBy("rate_key", "opened", "slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("rate_key", "opened").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("slice").alias("of_slice"), F.col("rate_key").alias("of_key"), F.col("opened").alias("of_opened"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = placed.join(sizes, F.expr("slice = of_slice AND opened = of_opened AND rate_key <=> of_key"))
    return ranked.select("request_id", "rate_key", (F.col("place") + F.col("before") <= most).alias("allowed"), *carry)


def _entries(cells: DataFrame, decay: int) -> DataFrame:
    """(rate_key, cell, times: sorted) -> cell_key, cell_of, open_before (the window open at the cell's entry), opens_at (the one that opens in it, or null).

    A node stands for up to FAN nodes in a row of the level below.  Its map: for each place among
    its first cell's times at which the window open before it can end (one more for "after them
    all"), the window open at its exit.  Going up, maps are composed; the top is walked through
    from no window at all; going down, each node's children are.
    """
    numbered = cells.withColumn("at", F.row_number().over(Window.partitionBy("rate_key").orderBy("cell")) - 1)
    leaf = numbered.select("rate_key", F.col("at").cast("long").alias("at"), "cell", "times", F.concat("times", F.array(F.lit(EXPIRED))).alias("exits"))
    levels = [materialise(leaf, "maps")]
    schema = "rate_key string, at long, times array<long>, exits array<long>"

    def step(state: np.ndarray, times: np.ndarray, exits: np.ndarray) -> np.ndarray:
        """The windows open after a node, given those open before it; one that ends beyond the node's first cell has ended at its end."""
        return exits[np.searchsorted(times, state + decay, "left")]

    def parts(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for row in range(batch.num_rows):
            yield tuple(c[row].values.to_numpy() if pa.types.is_list(c.type) else c[row].as_py() for c in columns)

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, state = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"rate_key": node[0], "at": node[1], "times": first, "exits": state}], schema=kinds)

        for batch in batches:
            for key, at, times, exits in parts(batch, "rate_key", "at", "times", "exits"):
                if node != (key, at // FAN):
                    if node is not None:
                        yield done()
                    node, first, state = (key, at // FAN), times, exits
                else:
                    state = step(state, times, exits)
        if node is not None:
            yield done()

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for key, at, times, exits, entry in parts(batch, "rate_key", "at", "times", "exits", "entry"):
                if node != (key, at // FAN):
                    node, state = (key, at // FAN), np.array([EXPIRED if entry is None else entry])
                out.append((key, at, int(state[0])))
                state = step(state, times, exits)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["rate_key", "at", "entry"])

    kinds = pa.schema([("rate_key", pa.string()), ("at", pa.int64()), ("times", pa.list_(pa.int64())), ("exits", pa.list_(pa.int64()))])
    grouped = lambda rows: rows.withColumn("node", F.floor(F.col("at") / FAN)).repartition("rate_key", "node").sortWithinPartitions("rate_key", "at")
    most = levels[0].agg(F.max("at")).first()[0] or 0
    while most >= FAN:
        levels.append(materialise(grouped(levels[-1].select("rate_key", "at", "times", "exits")).drop("node").mapInArrow(up, schema), "maps"))
        most //= FAN
    entries = None
    for level in reversed(levels):
        rows = level.select("rate_key", "at", "times", "exits")
        if entries is None:
            rows = rows.withColumn("entry", F.lit(None).cast("long"))
        else:
            above = entries.select(F.col("rate_key").alias("above_key"), F.col("at").alias("above"), "entry")
            rows = rows.join(above, F.expr("rate_key <=> above_key AND floor(at / %d) = above" % FAN)).drop("above_key", "above")
        entries = grouped(rows).drop("node").mapInArrow(down, "rate_key string, at long, entry long")
    told = levels[0].select(F.col("rate_key").alias("cell_key"), F.col("at").alias("cell_at"), F.col("cell").alias("cell_of"), "times")
    told = told.join(entries, F.expr("rate_key <=> cell_key AND at = cell_at"))
    opens = F.get(F.filter("times", lambda t: t >= F.col("entry") + decay), F.lit(0))
    return told.select("cell_key", "cell_of", F.col("entry").alias("open_before"), opens.alias("opens_at"))


class Judge(StatefulProcessor):
    """The limiter of one key on a stream: its open window and the hits in it are a value that a timer clears at the window's end.

    Rows come in chunks, as Spark hands them over, and no micro-batch of a key is held together.
    Where verdicts wait, a chunk's attempts go to a map from their time to their request_ids;
    what the watermark has passed is judged in order of time and leaves the map.
    """

    def __init__(self, most: int, decay: int, wait: bool):
        self.most, self.decay, self.wait = most, decay, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened long, hits long")
        if self.wait:
            self.waiting = handle.getMapState("waiting", "us long", "ids string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for chunk in rows:
            timed = chunk["ts"].notna()
            if not timed.all():
                yield pd.DataFrame({"request_id": chunk["request_id"][~timed], "rate_key": key[0], "allowed": True})
            chunk = chunk[timed].assign(us=lambda c: c["ts"].astype("datetime64[us]").astype("int64")).sort_values(["us", "request_id"])
            if chunk.empty:
                continue
            if not self.wait:
                yield self._judged(key, chunk["us"].to_numpy(), chunk["request_id"])
                continue
            for us, ids in chunk.groupby("us")["request_id"]:
                at = (int(us),)
                before = self.waiting.getValue(at)[0] + "," if self.waiting.containsKey(at) else ""
                self.waiting.updateValue(at, (before + ",".join(map(str, ids)),))
            self._wake(int(chunk["us"].iloc[0]) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs() * 1000
        if self.wait:
            due = sorted(us for (us,) in self.waiting.keys() if us < until)
            for us in due:
                ids = sorted(map(int, self.waiting.getValue((us,))[0].split(",")))
                self.waiting.removeKey((us,))
                yield self._judged(key, np.full(len(ids), us), ids)
            later = min((us for (us,) in self.waiting.keys()), default=None)
            if later is not None:
                self._wake(later + 1)
                return
        if self.window.exists() and self.window.get()[0] + self.decay <= until:
            self.window.clear()

    def _judged(self, key: tuple, times: np.ndarray, ids: object) -> pd.DataFrame:
        opened, hits = self.window.get() if self.window.exists() else (None, 0)
        allowed, opened, hits = verdicts(times, opened, hits, self.most, self.decay)
        self.window.update((int(opened), int(hits)))
        self._wake(int(opened) + self.decay)
        return pd.DataFrame({"request_id": ids, "rate_key": key[0], "allowed": allowed})

    def _wake(self, us: int) -> None:
        """Come back once the watermark has reached a time."""
        self.handle.registerTimer(-(-us // 1000))

    def close(self) -> None:
        pass


def limit_stream(attempts: DataFrame, config: Config = Config(), lateness: str = "10 minutes", wait: bool = False) -> DataFrame:  # noqa: B008
    """The same on a stream with a timestamp ``ts``: a verdict at once, in order of arrival (chunks of a key's rows, each in order of time).

    With ``wait`` a verdict comes when the watermark has passed its attempt: then verdicts are
    those of the batch limiter over all rows, in whatever order they arrive within ``lateness``.
    What is later than the watermark allows is dropped by Spark.  State is a key's window and its
    hits, which go at the window's end, and the attempts that wait; it needs Spark's RocksDB store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    judge = Judge(config.max_attempts, config.decay_minutes * 60_000_000, wait)
    rows = attempts.select("request_id", "ts", "rate_key").withWatermark("ts", lateness).groupBy("rate_key")
    return rows.transformWithStateInPandas(judge, "request_id long, rate_key string, allowed boolean", "append", "EventTime")
