"""The limiter in slices, and on streams, against one attempt at a time."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palisade.config import Config
from palisade.operators import limiter

NOW = datetime(2024, 1, 31, 12)


def plain(rows, most, decay):
    """request_id -> allowed, for rows (request_id, ts, key) with ids of their own."""
    want, state = {}, {}
    for i, ts, key in sorted(rows, key=lambda r: (r[1] is not None, r[1] or NOW, r[0])):
        if ts is None:
            want[i] = True
            continue
        opened, hits = state.get(key, (None, 0))
        if opened is None or ts >= opened + decay:
            opened, hits = ts, 0
        want[i] = hits < most
        state[key] = (opened, hits + want[i])
    return want


def attempts(n, seconds, seed, keys="hhhhhab"):
    rnd = random.Random(seed)
    return [(i, None if rnd.random() < 0.01 else NOW + timedelta(seconds=rnd.randrange(seconds), microseconds=rnd.choice([0, 1, 999_999])), rnd.choice(keys)) for i in range(n)]


@pytest.mark.parametrize(
    ("seconds", "minutes", "slice_rows"),
    [(4000, 1, 50), (400_000, 1, 50), (4000, 60, 50), (40_000, 10, 7), (100, 1, 100)],
)  # many cells (more than a node has children), cells of one attempt, one cell for all, tiny slices, equal times
def test_slices(spark, seconds, minutes, slice_rows):
    rows = [*attempts(3000, seconds, seconds + minutes), *[(10_000 + i, t, None) for i, t, _ in attempts(400, seconds, 1)]]
    config = Config(max_attempts=4, decay_minutes=minutes)
    table = spark.createDataFrame(rows, "request_id long, ts timestamp_ntz, rate_key string")
    got = limiter.limit(table, config, slice_rows=slice_rows).collect()
    assert len(got) == len(rows) and {r.request_id: r.allowed for r in got} == plain(rows, 4, timedelta(minutes=minutes))


def test_tasks_hold_slices(spark):
    """One key has half of all rows, and no task of its part reads much more than a slice."""
    rows = attempts(20_000, 900_000, 5, "hab")
    table = spark.createDataFrame([(i, t, k) for i, t, k in rows if t], "request_id long, ts timestamp_ntz, rate_key string")
    hot = limiter.hot_verdicts(table.where("rate_key = 'h'"), Config(max_attempts=2, decay_minutes=5), slice_rows=500)
    sizes = [len(p) for p in hot.rdd.glom().collect()]
    assert sum(sizes) == table.where("rate_key = 'h'").count()
    plan = hot._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # Windows are worked out by slice.
    assert "slice" in plan


def test_rows_that_do_not_count(spark):
    """Uncounted attempts of a hot key have no verdict; repeated rows are attempts of their own; columns are carried."""
    rows = [(i // 2, NOW + timedelta(seconds=i // 2), "h", i % 7 > 0, str(i)) for i in range(400)] + [(1, None, "h", True, "u"), (2, None, "h", False, "v")]
    table = spark.createDataFrame(rows, "request_id long, ts timestamp_ntz, rate_key string, counts boolean, note string")
    config = Config(max_attempts=3, decay_minutes=1)
    told = lambda **kw: sorted((r.note, r.request_id, r.allowed) for r in limiter.limit(table, config, "counts", ("note",), **kw).collect() if r.allowed is None)
    assert told(slice_rows=20) == told() and len(told()) == sum(not r[3] for r in rows)
    count = lambda **kw: limiter.limit(table, config, "counts", ("note",), **kw).groupBy("request_id").agg(F.count_if("allowed").alias("n"), F.count("allowed").alias("of")).orderBy("request_id").collect()
    assert count(slice_rows=20) == count()
    assert limiter.limit(table.where("false"), config, slice_rows=1).collect() == []


@pytest.fixture
def one_partition(spark):
    """State is kept by partition, and small streams need no more than one."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def streamed(spark, tmp_path, batches, name, config, **kw):
    from palisade.session import ship

    ship(spark)
    source = str(tmp_path / name)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "request_id long, ts timestamp, rate_key string").coalesce(1).write.parquet(f"{source}/{i:03}")
    found = spark.readStream.schema("request_id long, ts timestamp, rate_key string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    out = limiter.limit_stream(found, config, **kw).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{source}-c")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_stream_in_any_order(spark, tmp_path, one_partition):
    """Attempts arrive up to half an hour late, in chunks that mix times: waiting verdicts are those of the batch."""
    rnd = random.Random(8)
    rows = [r for r in attempts(600, 7200, 6) if r[1]]
    late = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=rnd.randrange(1700)), r[0]))
    batches = [late[i : i + 120] for i in range(0, len(late), 120)]
    end = [(-1, NOW + timedelta(days=1), "end")]
    config = Config(max_attempts=4, decay_minutes=2)
    got = streamed(spark, tmp_path, [*batches, end], "waited", config, lateness="30 minutes", wait=True)
    assert {r.request_id: r.allowed for r in got if r.request_id >= 0} == plain(rows, 4, timedelta(minutes=2))
    assert len([r for r in got if r.request_id >= 0]) == len(rows)


def test_stream_at_once(spark, tmp_path, one_partition):
    """Micro-batches in order of time, shuffled inside: verdicts at once, as in batch; an attempt without a time passes."""
    rows = sorted((r for r in attempts(400, 7200, 7) if r[1]), key=lambda r: (r[1], r[0]))
    batches = [rows[i : i + 80] for i in range(0, len(rows), 80)]
    for b in batches:
        random.Random(1).shuffle(b)
    config = Config(max_attempts=4, decay_minutes=2)
    got = streamed(spark, tmp_path, [*batches, [(9999, None, "h")]], "at_once", config)
    assert {r.request_id: r.allowed for r in got} == {**plain(rows, 4, timedelta(minutes=2)), 9999: True}
