"""Reports from partial counts, and a service that is asked once for each text."""

import os
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_detectors import requests

from palisade.operators import ml
from palisade.plans import pipeline, stats
from palisade.sources.threat_log import ThreatLog

NOW = datetime(2024, 1, 31, 12, 34, 56)


def same_reports(log, as_of, hours):
    rows = log.read(as_of, hours)
    want = {
        "summary": stats.summary(rows, as_of, hours), "top_ips": stats.top_ips(rows, as_of, 10, hours), "top_sources": stats.top_sources(rows, as_of, 10, hours),
        "timeline": stats.timeline(rows, as_of, hours), "confidence": stats.confidence_breakdown(rows, as_of, hours),
    }
    got = stats.rolled_reports(log.rolled(as_of, hours))
    for name, report in want.items():
        assert [tuple(r) for r in got[name].select(*report.columns).collect()] == [tuple(r) for r in report.collect()], name


def test_reports_from_partials(spark, tmp_path):
    """Equal to those from rows: windows that begin within an hour, late rows, a batch that runs twice, marks, null times, and what a flush leaves."""
    log = ThreatLog(spark, str(tmp_path / "log"))
    same_reports(log, NOW, 24)
    agents = ("GPTBot/1.0", "curl/8", "AhrefsBot/7", "sqlmap/1.7")
    rows = [{"agent": agents[i % 4], "ip": f"10.0.0.{i % 7}", "ts": None if i % 50 == 0 else NOW - timedelta(minutes=i * 11)} for i in range(400)]
    made = pipeline.threats(requests(spark, rows))
    log.append(made.where("id % 4 = 0"))
    for _ in range(2):
        log.append_batch(made.where("id % 4 = 2"), 0, "w", "e")
    log.mark(spark.createDataFrame([(4,), (6,)], "id long"))
    assert log.read().count() == 400
    for as_of, hours in ((NOW, 24), (NOW, 1), (NOW.replace(minute=0, second=0), 30), (NOW + timedelta(hours=3), 8760)):
        same_reports(log, as_of, hours)
    assert log.flush(NOW, "yes", 30) > 0
    same_reports(log, NOW, 24)
    same_reports(log, NOW, 8760)
    log.append(made.where("id % 4 = 2 AND id < 100"))
    same_reports(log, NOW, 40)
    # A window that begins on the hour reads no row of the log.
    files = stats.rolled_reports(log.rolled(NOW.replace(minute=0, second=0, microsecond=0), 24))["summary"].inputFiles()
    assert files and all("/log/rollup/" in f for f in files)
    log.flush(NOW, "yes")
    same_reports(log, NOW, 24)


def test_each_text_once(spark, tmp_path):
    """A service that fails on one text and is slow on another, and counts its calls."""
    from palisade.session import ship

    ship(spark)
    calls = str(tmp_path)

    def service(text):
        with open(os.path.join(calls, str(abs(hash(text)))), "a") as f:
            f.write(text + "\n")
        if text == "bad":
            raise ValueError("no")
        if text == "slow":
            time.sleep(3)
        return f'{{"score": {len(text)}}}'

    texts = ["a", "bad", "cc", "slow", None, "a", "cc", "a"] * 20
    rows = spark.createDataFrame(list(enumerate(texts)), "request_id int, said string").repartition(4)
    found = ml.score_distinct(rows, service, F.col("said"), concurrency=2, deadline=1.0)
    for _ in range(2):
        got = {(r.said, r.ml_response, r.ml_error) for r in found.collect()}
    assert got == {("a", '{"score": 1}', None), ("cc", '{"score": 2}', None), ("bad", None, "ValueError: no"), ("slow", None, ml.LATE), (None, None, None)}
    assert found.count() == len(texts)
    said = sorted(line for name in os.listdir(calls) for line in open(os.path.join(calls, name)).read().splitlines())
    assert said == ["a", "bad", "cc", "slow"]


def test_a_service_that_is_down_is_left_alone(spark, tmp_path):
    from palisade.session import ship

    ship(spark)
    calls = str(tmp_path / "calls")

    def down(text):
        with open(calls, "a") as f:
            f.write("x")
        raise OSError("down")

    rows = spark.range(500).select(F.concat(F.lit("t"), "id").alias("said")).coalesce(1)
    found = ml.score_distinct(rows, down, F.col("said"), concurrency=1, trip=3, rest=600).collect()
    assert len(found) == 500 and all(r.ml_response is None and r.ml_error for r in found)
    tasks = spark.sparkContext.defaultParallelism
    assert os.path.getsize(calls) <= 3 * tasks
    breaker = ml.Breaker(2, 0.05)
    breaker.told(True)
    assert breaker.closed()
    breaker.told(True)
    assert not breaker.closed()
    time.sleep(0.06)
    assert breaker.closed()
    breaker.told(False)
    assert breaker.closed()
