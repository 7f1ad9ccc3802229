"""Responses on streams, what cannot be judged, and a log that loses and doubles no batch."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_detectors import requests

from palisade.config import Config
from palisade.operators.results import each
from palisade.plans import fail_open, pipeline
from palisade.sources.threat_log import ThreatLog
from palisade.streaming import live

NOW = datetime(2024, 1, 31, 12)
BLOCK = Config(mode="block", response_enabled=True, whitelist_ips=("9.9.9.9",))


@pytest.fixture(autouse=True)
def one_partition(spark):
    """State is kept by partition, and small streams need no more than one."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def traffic(spark):
    """Requests a minute apart: crawlers, plain ones and a whitelisted one; and what was sent to each: leaks, clean texts, late and missing responses."""
    rows = [
        {"agent": "GPTBot/1.0" if i % 5 == 0 else "Mozilla", "language": "" if i % 7 == 3 else "en", "ip": "9.9.9.9" if i == 11 else "1.1.1.1", "ts": NOW + timedelta(minutes=i)}
        for i in range(30)
    ]
    asked = requests(spark, rows)
    sent = []
    for i in range(1, 31):
        at = NOW + timedelta(minutes=i - 1, seconds=20)
        if i == 20:
            continue  # never answered
        if i == 22:
            at += timedelta(minutes=30)  # beyond the time in which a response belongs to its request
        if i == 24:
            at -= timedelta(minutes=1)  # before its request
        sent.append((i, None if i == 26 else at, "image/png" if i == 8 else "text/plain", "write to a.bc@d.org" if i % 2 == 0 or i == 12 else "nothing here"))
    sent.append((999, NOW, "text/plain", "a.bc@d.org"))  # to nobody
    return asked, spark.createDataFrame(sent, live.RESPONSE)


def by_batches(rows, path, key, size, order):
    """Files in the order of time, or turned round within ten minutes."""
    parts = sorted(rows.collect(), key=order)
    for n, at in enumerate(range(0, len(parts), size)):
        rows.sparkSession.createDataFrame(parts[at : at + size], rows.schema).coalesce(1).write.parquet(f"{path}/{n:03}")


def streamed(spark, out, name, checkpoint):
    out.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_responses_on_a_stream(spark, traffic, tmp_path):
    """Answers and outbound rows are those of the batch, whichever side comes first; responses without their request in time change nothing."""
    asked, sent = traffic
    end = NOW + timedelta(days=1)  # lets the watermark pass
    last = requests(spark, [{"agent": "Mozilla", "language": "en", "ts": end}]).withColumn("request_id", F.lit(5000).cast("long"))
    close = spark.createDataFrame([(5001, end, "text/plain", "a.bc@d.org")], live.RESPONSE)
    turned = lambda r: ((r.ts or NOW).hour, (r.ts or NOW).minute // 10, -(r.ts or NOW).minute)
    by_batches(asked, str(tmp_path / "asked"), "request_id", 7, turned)
    by_batches(sent, str(tmp_path / "sent"), "request_id", 4, lambda r: (turned(r), r.request_id))
    last.coalesce(1).write.parquet(str(tmp_path / "asked" / "999"))
    close.coalesce(1).write.parquet(str(tmp_path / "sent" / "999"))
    stream = lambda schema, folder: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / folder))
    both = lambda: (stream(live.REQUEST, "asked"), stream(live.RESPONSE, "sent"))

    on_time = sent.where("ts IS NOT NULL AND request_id NOT IN (22, 24)")
    want = {r.request_id: (r.threat_type, r.confidence_score, r.action_taken, r.http_status) for r in pipeline.outcomes(asked, on_time, BLOCK).collect()}
    got = streamed(spark, live.outcome_stream(*both(), BLOCK, lateness="40 minutes"), "answers", str(tmp_path / "c1"))
    mine = [r for r in got if r.request_id < 5000]
    assert {r.request_id: (r.threat_type, r.confidence_score, r.action_taken, r.http_status) for r in mine} == want and len(mine) == 30
    assert {s for *_, s in want.values()} == {200, 403, 500}

    rows = streamed(spark, live.outbound_stream(*both(), BLOCK, lateness="40 minutes"), "outbound", str(tmp_path / "c2"))
    batch = pipeline.threats(asked, on_time, BLOCK).where("id % 2 = 1")
    shown = ("id", "ip_address", "threat_type", "matched_pattern", "payload_snippet", "action_taken", "created_at")
    assert sorted(tuple(r[c] for c in shown) for r in rows) == sorted(tuple(r[c] for c in shown) for r in batch.collect()) and len(rows) > 8


def test_a_request_without_a_time(spark, tmp_path):
    rows = requests(spark, [{"agent": "GPTBot/1.0", "ts": None}])
    rows.write.parquet(str(tmp_path / "asked"))
    spark.createDataFrame([], live.RESPONSE).write.parquet(str(tmp_path / "sent"))
    got = streamed(spark, live.outcome_stream(live.read_requests(spark, str(tmp_path / "asked")), live.read_responses(spark, str(tmp_path / "sent")), BLOCK), "untimed", str(tmp_path / "c"))
    assert [(r.request_id, r.http_status) for r in got] == [(1, 403)]


BREAKS = "breaks the parser"


def picky(rows):
    """A judge that fails on one text, as an expression does: the whole stage fails with it."""
    value = F.coalesce(F.get("inputs", F.lit(0))["value"], F.lit(""))
    checked = F.when(value == BREAKS, F.raise_error(F.lit("no such value"))).otherwise(F.lit(0))
    found = pipeline.verdicts_of(rows.withColumn("request_id", F.col("request_id") + checked.cast("int")))
    return found


def test_fail_open(spark):
    """The rows that break a judge are dead letters; all others are judged; a judge that is broken itself says so."""
    rows = requests(spark, [{"agent": "GPTBot/1.0" if i % 3 == 0 else "Mozilla", "language": "en", "inputs": [("m", BREAKS if i in (4, 9) else "x")]} for i in range(40)])
    found, dead = fail_open.fail_open(rows, picky)
    assert sorted(r.request_id for r in found.collect()) == [i + 1 for i in range(40) if i % 3 == 0 and i != 9]
    letters = dead.collect()
    assert sorted(r.request_id for r in letters) == [5, 10] and all(BREAKS in r.row and r.error and r.phase == 0 for r in letters)
    # When too many rows fail, what is left is set aside, not lost.
    found, dead = fail_open.fail_open(rows, picky, parts=2, splits=3)
    assert {r.request_id for r in dead.collect()} >= {5, 10} and found.count() + dead.where("(request_id - 1) % 3 = 0").count() == 14
    clean, none = fail_open.fail_open(rows.where("request_id < 4"), picky)
    assert clean.count() == 1 and none.isEmpty()
    with pytest.raises(Exception, match="(?i)no_such"):
        fail_open.fail_open(rows, lambda part: part.select("no_such_column"))


def test_a_poisoned_row_passes(spark, monkeypatch):
    """A request and a body that break their detectors get 200 and dead letters; the other answers stand."""
    rows = requests(spark, [{"agent": "GPTBot/1.0", "inputs": [("m", BREAKS)]}, {"agent": "GPTBot/1.0"}, {"agent": "Mozilla", "language": "en"}, {"agent": "Mozilla", "language": "en"}])
    sent = spark.createDataFrame([(3, "text/plain", BREAKS), (4, "text/plain", "a.bc@d.org")], "request_id long, content_type string, body string")
    judged, leaking = pipeline.verdicts_of, pipeline.leaking
    broken = lambda c: F.when(c == BREAKS, F.raise_error(F.lit("no such value"))).otherwise(F.lit(0)).cast("long")
    value = F.coalesce(F.get("inputs", F.lit(0))["value"], F.lit(""))
    monkeypatch.setattr(pipeline, "verdicts_of", lambda part, *a: judged(part.withColumn("request_id", F.col("request_id") + broken(value)), *a))
    monkeypatch.setattr(pipeline, "leaking", lambda part, *a: leaking(part.withColumn("request_id", F.col("request_id") + broken(F.col("body"))), *a))
    answers, dead = fail_open.outcomes(rows, sent, BLOCK)
    assert {r.request_id: r.http_status for r in answers.collect()} == {1: 200, 2: 403, 3: 200, 4: 500}
    assert sorted((r.request_id, r.phase) for r in dead.collect()) == [(1, 0), (3, 1)]


def test_dead_letters_of_a_stream(spark, tmp_path, monkeypatch):
    rows = requests(spark, [{"agent": "GPTBot/1.0", "ts": NOW, "inputs": [("m", BREAKS if i == 3 else "x")]} for i in range(6)])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    threats = pipeline.threats
    value = F.coalesce(F.get("inputs", F.lit(0))["value"], F.lit(""))
    broken = F.when(value == BREAKS, F.raise_error(F.lit("no such value"))).otherwise(F.lit(0)).cast("long")
    monkeypatch.setattr(pipeline, "threats", lambda part, *a: threats(part.withColumn("request_id", F.col("request_id") + broken), *a))
    log = ThreatLog(spark, str(tmp_path / "log"))
    live.request_writer(live.read_requests(spark, str(tmp_path / "in")), log, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in log.read().collect()) == [2, 4, 6, 10, 12]
    assert [(r.request_id, r.phase) for r in log.dead_letters().collect()] == [(4, 0)]


def threats(spark, ids):
    made = requests(spark, [{"agent": "GPTBot/1.0", "ts": NOW + timedelta(hours=i)} for i in range(max(ids))])
    return pipeline.threats(made).where(F.col("id").isin([2 * i for i in ids]))


def ids(log):
    return sorted(r.id // 2 for r in log.read().collect())


def test_batches_of_several_writers(spark, tmp_path, monkeypatch):
    """Writers count their batches each for themselves; a batch that was cut short is completed; nothing is read again for a batch that was not."""
    log = ThreatLog(spark, str(tmp_path / "log"))
    log.append_batch(threats(spark, [1, 2]), 0, "a", "e1")
    log.append_batch(threats(spark, [3, 4]), 0, "b", "e1")
    log.append_batch(threats(spark, [3, 4]), 0, "b", "e1")
    # Equal ids of another source are other rows.
    log.append_batch(threats(spark, [1]), 1, "b", "e1")
    assert ids(log) == [1, 1, 2, 3, 4]
    # Cut short while its files were moved in: the rerun replaces them.
    moved = ThreatLog._file_system

    class Cut:
        def __init__(self, files):
            self.files, self.left = files, 1

        def __getattr__(self, name):
            return getattr(self.files, name)

        def rename(self, a, b):
            if not self.left:
                raise OSError("cut short")
            self.left -= 1
            return self.files.rename(a, b)

    def cut(self):
        files, place = moved(self)
        return Cut(files), place

    monkeypatch.setattr(ThreatLog, "_file_system", cut)
    with pytest.raises(OSError, match="cut short"):
        log.append_batch(threats(spark, [5, 30, 60]), 2, "b", "e1")
    monkeypatch.setattr(ThreatLog, "_file_system", moved)
    spark.catalog.refreshByPath(log.rows_path)
    assert len(ids(log)) == 6
    unlogged = ThreatLog._unlogged
    monkeypatch.setattr(ThreatLog, "_unlogged", lambda *a: pytest.fail("ids were read again"))
    log.append_batch(threats(spark, [5, 30, 60]), 2, "b", "e1")
    assert ids(log) == [1, 1, 2, 3, 4, 5, 30, 60]
    # A new checkpoint of b reads its source again, in other batches.
    monkeypatch.setattr(ThreatLog, "_unlogged", unlogged)
    log.append_batch(threats(spark, [1, 3]), 0, "b", "e2")
    log.append_batch(threats(spark, [2, 4, 5, 61]), 1, "b", "e2")
    assert ids(log) == [1, 1, 2, 2, 3, 4, 5, 30, 60, 61]


def test_two_streams_and_a_new_checkpoint(spark, tmp_path):
    log = ThreatLog(spark, str(tmp_path / "log"))
    for name, mine in (("one", [1, 2]), ("two", [3, 4])):
        made = requests(spark, [{"agent": "GPTBot/1.0", "ts": NOW}] * 4)
        made.where(F.col("request_id").isin(mine)).coalesce(1).write.parquet(str(tmp_path / name))

    def run(name, checkpoint):
        writer = live.log_writer(live.threat_stream(live.read_requests(spark, str(tmp_path / name))), log, str(tmp_path / checkpoint), writer=name)
        writer.trigger(availableNow=True).start().awaitTermination()

    run("one", "c1")
    run("two", "c2")
    run("one", "c1")
    run("two", "c3")
    assert ids(log) == [1, 2, 3, 4]


def test_pages_and_lookups(spark, tmp_path):
    """A page reads the days it touches; one row is found by its file's ids."""
    from palisade.plans import stats

    log = ThreatLog(spark, str(tmp_path / "log"))
    made = requests(spark, [{"agent": ("GPTBot/1.0", "curl/8")[i % 2], "ts": NOW - timedelta(hours=i)} for i in range(600)])
    rows = pipeline.threats(made)
    log.append(rows)
    log.mark(spark.createDataFrame([(8,), (10,)], "id long"))
    for page in (1, 3, 12, 99):
        for kind in (None, "ai_crawler"):
            got = [r.id for r in log.page(NOW, 700, 20, page, kind).collect()]
            assert got == [r.id for r in stats.threat_page(log.read(NOW, 700), NOW, 700, 20, page, kind).collect()], page
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(log.page(NOW, 700, 20, 12)).count("2024-01-") > 0
    files = log.page(NOW, 700, 20, 12)
    files.collect()
    scans = [n for n in _scans(files._jdf.queryExecution().executedPlan()) if n is not None]
    assert max(scans) <= 3
    found = log.read().where("id = 400")
    assert [r.id for r in found.collect()] == [400]
    assert "EqualTo(id,400)" in plan(found)


def _scans(plan):
    """How many files each scan of the plan has read."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        yield from _scans(plan.executedPlan())
        return
    if "QueryStage" in name:
        yield from _scans(plan.plan())
        return
    if name.startswith("Scan parquet"):
        found = plan.metrics().get("numFiles")
        yield found.get().value() if found.isDefined() else None
    children = plan.children()
    for i in range(children.size()):
        yield from _scans(children.apply(i))


def test_a_failure_that_no_row_caused(spark, monkeypatch):
    """What fails once and then works gives all rows and no dead letter."""
    rows = requests(spark, [{"agent": "GPTBot/1.0"}] * 3)
    failed = []

    def once(part):
        if not failed:
            failed.append(True)
            raise OSError("a machine was lost")
        return pipeline.verdicts_of(part)

    found, dead = fail_open.fail_open(rows, once)
    assert found.count() == 3 and dead.count() == 0
