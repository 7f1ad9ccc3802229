"""The pipeline on streams: requests and responses in, threat rows, alerts, answers and limiter verdicts out.

Detection is stateless: each request is judged by itself, user agents included, so a stream
needs no state and a lost batch is judged again alike.  Two operators have state: the limiter,
and the join of responses with their requests.  A response comes at or after its request and
within a bounded time (``within``), so Spark drops a request once the watermark has passed that
time, and a leaking response (no other is kept) once its request can no longer come.  Rows reach
the threat log once, however often a batch is run.
"""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from palisade.config import Config
from palisade.operators import detectors, limiter
from palisade.operators.results import each
from palisade.operators.robots import read_robots
from palisade.plans import pipeline
from palisade.plans.fail_open import fail_open
from palisade.sources.threat_log import ThreatLog

REQUEST = (
    "request_id long, ts timestamp_ntz, ip string, method string, url string, path string, user_agent string, headers array<struct<name:string,value:string>>, "
    "inputs array<struct<path:string,value:string>>, query array<struct<path:string,value:string>>, raw_body string"
)
RESPONSE = "request_id long, ts timestamp_ntz, content_type string, body string"
log = logging.getLogger(__name__)


def read_requests(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of requests from Parquet files that arrive in a folder."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def read_responses(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of responses, with the time they were sent, from Parquet files that arrive in a folder."""
    return spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def _leaks(responses: DataFrame, config: Config, lateness: str) -> DataFrame:
    sent = responses.withColumn("sent_at", F.col("ts").cast("timestamp")).where("sent_at IS NOT NULL").withWatermark("sent_at", lateness)
    return pipeline.leaking(sent, config, "sent_at").select(F.col("request_id").alias("of_request"), "sent_at", F.col("threat").alias("leak"))


def _met(within: str) -> Column:
    return F.expr(f"request_id = of_request AND sent_at BETWEEN asked_at AND asked_at + INTERVAL {within}")


def outbound_stream(requests: DataFrame, responses: DataFrame, config: Config = Config(), lateness: str = "10 minutes", within: str = "5 minutes") -> DataFrame:  # noqa: B008
    """Threat rows of responses that leak, with what their requests tell.  A response without a time, or without its request in time, gives none."""
    asked = requests.where(~detectors.whitelisted(config)).withColumn("asked_at", F.col("ts").cast("timestamp")).withWatermark("asked_at", lateness)
    met = asked.join(_leaks(responses, config, lateness), _met(within)).drop("of_request", "sent_at", "asked_at").withColumnRenamed("leak", "threat")
    return pipeline.log_rows(met, 1, config)


def outcome_stream(
    requests: DataFrame, responses: DataFrame, config: Config = Config(), robots_text: str | None = None, lateness: str = "10 minutes", within: str = "5 minutes"  # noqa: B008
) -> DataFrame:
    """What each request comes to: request_id, threat_type, confidence_score, action_taken, http_status.

    A request is answered for when its response has leaked, or when the watermark has passed the
    time in which it could.  A request without a time waits for no response.  In rate_limit mode
    the limiter's verdicts are ``verdict_stream``'s, and 429 is not given here.
    """
    spared = detectors.whitelisted(config) if config.enabled else F.lit(True)
    found = F.when(~spared, pipeline.inbound(config, robots_text))
    # Spread out, a result is worked out once; an array of one null is one row.
    told = detectors.judge_agents(requests, config).select("request_id", F.col("ts").cast("timestamp").alias("asked_at"), spared.alias("spared"), F.explode(F.array(found)).alias("threat"))
    score = F.col("threat.confidence_score")
    told = told.select(
        "request_id", "asked_at", "spared", F.col("threat.threat_type").alias("threat_type"), score.alias("confidence_score"),
        F.when(score.isNotNull(), pipeline.action(config, score)).alias("action_taken"), pipeline.http_status(config, score).alias("http_status"),
    )
    shown = ("request_id", "threat_type", "confidence_score", "action_taken")
    met = told.where("asked_at IS NOT NULL").withWatermark("asked_at", lateness).join(_leaks(responses, config, lateness), _met(within), "leftOuter")
    replaced = F.coalesce(F.when(~F.col("spared"), pipeline.response_outcome(F.col("leak"), config)), F.col("http_status"))
    met = met.select(*shown, F.when(F.col("http_status") == 200, replaced).otherwise(F.col("http_status")).alias("http_status"))
    return met.unionByName(told.where("asked_at IS NULL").select(*shown, "http_status"))


def threat_stream(requests: DataFrame, config: Config = Config(), robots_text: str | None = None, ml_score: Column | None = None) -> DataFrame:  # noqa: B008
    """Threat rows of a stream of requests."""
    return pipeline.threats(requests, None, config, robots_text, ml_score)


def verdict_stream(
    requests: DataFrame, config: Config = Config(), robots_text: str | None = None, lateness: str = "10 minutes", wait: bool = False  # noqa: B008
) -> DataFrame:
    """The limiter's verdicts on detected requests at or above the threshold: request_id, rate_key, allowed."""
    found = pipeline.detect(requests, config, robots_text)
    counted = found.select("request_id", F.col("ts").cast("timestamp").alias("ts"), limiter.rate_key().alias("rate_key"), each(F.col("threat")).alias("threat"))
    counted = counted.where(F.col("threat.confidence_score") >= config.confidence_threshold)
    return limiter.limit_stream(counted, config, lateness, wait)


def request_writer(
    requests: DataFrame, threat_log: ThreatLog, checkpoint: str, config: Config = Config(), robots_path: str | None = None, send: Callable[[DataFrame], None] | None = None, writer: str | None = None  # noqa: B008
) -> DataStreamWriter:
    """Judge requests batch by batch and log the threats: robots.txt is read anew for each, and a batch's user agents are judged once each.

    Requests that cannot be judged pass, and are set aside in the log as dead letters.
    """

    def judge(rows: DataFrame, batch_id: int) -> None:
        text = None if robots_path is None else read_robots(rows.sparkSession, robots_path)
        found, dead = fail_open(rows, lambda part: pipeline.threats(part, None, config, text))
        if not dead.isEmpty():
            threat_log.set_aside(dead, f"{_writer(checkpoint, writer)}-{_epoch(rows.sparkSession, checkpoint)}-{batch_id}")
        _store(found, batch_id, threat_log, config, send, checkpoint, writer)

    return requests.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)


def hourly_stream(threats: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Threats an hour and type as a stream: an hour is final once the watermark has passed it."""
    timed = threats.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", "1 hour").alias("hour"), "threat_type").agg(F.count(F.lit(1)).alias("total")).select("hour.start", "threat_type", "total")


def log_writer(
    threats: DataFrame, threat_log: ThreatLog, checkpoint: str, config: Config = Config(), send: Callable[[DataFrame], None] | None = None, writer: str | None = None  # noqa: B008
) -> DataStreamWriter:
    """Write threat rows to the log, and hand each batch's alerts to ``send``.  Alerts that can't be sent stop nothing.

    ``writer`` names what is read, where a new checkpoint may read it again; without it the
    checkpoint's place does.  Streams of one writer must not share ids unless they are the same rows.
    """
    return threats.writeStream.foreachBatch(lambda rows, batch_id: _store(rows, batch_id, threat_log, config, send, checkpoint, writer)).option("checkpointLocation", checkpoint)


def _writer(checkpoint: str, name: str | None) -> str:
    return name or hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def _epoch(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that a checkpoint belongs to: Spark writes it when the checkpoint begins and keeps it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def _store(rows: DataFrame, batch_id: int, threat_log: ThreatLog, config: Config, send: Callable[[DataFrame], None] | None, checkpoint: str, writer: str | None) -> None:
    rows = rows.persist()
    try:
        threat_log.append_batch(rows, batch_id, _writer(checkpoint, writer), _epoch(rows.sparkSession, checkpoint))
        if send is not None:
            try:
                send(pipeline.alerts(rows, config))
            except Exception:  # the hook is the user's, and optional
                log.warning("alerts of batch %s were not sent", batch_id, exc_info=True)
    finally:
        rows.unpersist()
