"""Questions over the threat table.  Time is a parameter: ``as_of`` stands for now."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.config import SIGNATURES, Config
from palisade.functions.patterns import INJECTIONS, PII
from palisade.functions.text import upper_first
from palisade.sources.catalog import categories, signatures

#: What the list's filters accept; other values are ignored.
FILTER_TYPES = ("ai_crawler", "prompt_injection", "data_harvester", "api_abuser")
FILTER_ACTIONS = ("blocked", "rate_limited", "logged")
SUMMARY_TYPES = (
    ("ai_crawlers", "ai_crawler"), ("prompt_injections", "prompt_injection"), ("data_harvesters", "data_harvester"),
    ("honeypot_traps", "honeypot_trap"), ("pii_leaks", "pii_leak"), ("bad_bots", "bad_bot"), ("scrapers", "scraper"),
)
ACTION_LABELS = {"blocked": "Blocked", "rate_limited": "Rate Limited", "logged": "Logged Only"}
TYPE_LABELS = {
    "ai_crawler": "AI Crawler", "prompt_injection": "Prompt Injection", "data_harvester": "Data Harvester", "api_abuser": "API Abuser",
    "honeypot_trap": "Honeypot Trap", "pii_leak": "PII Leak", "robots_txt_violation": "Robots.txt Violation",
    "suspicious_fingerprint": "Suspicious Fingerprint", "seo_bot": "SEO Bot", "scraper": "Web Scraper", "bad_bot": "Malicious Bot",
    "search_engine": "Search Engine",
}


def of_type(kind: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.where(F.col("threat_type") == kind)


ai_crawlers, prompt_injections, data_harvesters = of_type("ai_crawler"), of_type("prompt_injection"), of_type("data_harvester")
honeypot_traps, pii_leaks, bad_bots, scrapers = of_type("honeypot_trap"), of_type("pii_leak"), of_type("bad_bot"), of_type("scraper")


def with_action(name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.where(F.col("action_taken") == name)


blocked, rate_limited = with_action("blocked"), with_action("rate_limited")


def high_confidence(rows: DataFrame, least: int = 70) -> DataFrame:
    return rows.where(F.col("confidence_score") >= least)


def recent(rows: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Rows not older than this, the bound included; a null time is in no window."""
    return rows.where(F.col("created_at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(hours)} HOURS"))


def by_ip(rows: DataFrame, ip: str) -> DataFrame:
    return rows.where(F.col("ip_address") == ip)


def not_false_positive(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("is_false_positive"))


def clamp(value: object, default: int, most: int) -> int:
    """A parameter as its leading integer, from 1 to ``most``; text that is no number counts as 0."""
    if value is None:
        return default
    digits = str(value).strip()
    sign, digits = (digits[0], digits[1:]) if digits[:1] in "+-" and digits else ("", digits)
    head = digits[: next((i for i, c in enumerate(digits) if not ("0" <= c <= "9")), len(digits))]
    return max(1, min(int(sign + head) if head else 0, most))


def hours_of(value: object = None) -> int:
    return clamp(value, 24, 8760)


def limit_of(value: object = None, default: int = 50) -> int:
    return clamp(value, default, 200)


def summary(rows: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Ten counts in one pass; false positives count."""
    kinds = [F.count_if(F.col("threat_type") == kind).alias(name) for name, kind in SUMMARY_TYPES]
    actions = [F.count_if(F.col("action_taken") == a).alias(a) for a in ("blocked", "rate_limited")]
    return recent(rows, as_of, hours).agg(F.count(F.lit(1)).alias("total"), *kinds, *actions)


def top_ips(rows: DataFrame, as_of: datetime, limit: int = 10, hours: int = 24) -> DataFrame:
    """Most frequent addresses; ties by address, null first."""
    counted = recent(rows, as_of, hours).groupBy("ip_address").agg(F.count(F.lit(1)).alias("total"), F.max("confidence_score").alias("confidence_score"))
    return counted.orderBy(F.desc("total"), F.asc_nulls_first("ip_address")).limit(limit)


def top_sources(rows: DataFrame, as_of: datetime, limit: int = 10, hours: int = 24) -> DataFrame:
    """Most frequent sources; a null source is a group; ties by source, null first."""
    counted = recent(rows, as_of, hours).groupBy("threat_source").agg(F.count(F.lit(1)).alias("total"))
    return counted.orderBy(F.desc("total"), F.asc_nulls_first("threat_source")).limit(limit)


def timeline(rows: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Threats an hour; hours without any are absent."""
    hour = F.date_format("created_at", "yyyy-MM-dd HH:00:00").alias("hour")
    return recent(rows, as_of, hours).groupBy(hour).agg(F.count(F.lit(1)).alias("total")).orderBy("hour")


def confidence_breakdown(rows: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    s = F.col("confidence_score")
    return recent(rows, as_of, hours).agg(F.count_if(s >= 90).alias("high"), F.count_if(s.between(70, 89)).alias("medium"), F.count_if(s < 70).alias("low"))


def rolled_reports(partials: DataFrame, limit: int = 10) -> dict[str, DataFrame]:
    """The five reports from a log's partial counts (``ThreatLog.rolled``), equal to those from its rows."""
    total = F.coalesce(F.sum("total"), F.lit(0))
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("total"))), F.lit(0))
    kinds = [of(F.col("threat_type") == kind).alias(name) for name, kind in SUMMARY_TYPES]
    actions = [of(F.col("action_taken") == a).alias(a) for a in ("blocked", "rate_limited")]
    top = lambda key, *more: partials.groupBy(key).agg(total.alias("total"), *more).orderBy(F.desc("total"), F.asc_nulls_first(key)).limit(limit)
    return {
        "summary": partials.agg(total.alias("total"), *kinds, *actions),
        "top_ips": top("ip_address", F.max("confidence_score").alias("confidence_score")),
        "top_sources": top("threat_source"),
        "timeline": partials.groupBy(F.date_format("hour", "yyyy-MM-dd HH:00:00").alias("hour")).agg(total.alias("total")).orderBy("hour"),
        "confidence": partials.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("high", "medium", "low")]),
    }


def recent_threats(rows: DataFrame, as_of: datetime, limit: int = 20) -> DataFrame:
    """The newest of the last day that are no false positives; ties by id, newest first."""
    return not_false_positive(recent(rows, as_of)).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def filtered(rows: DataFrame, as_of: datetime, hours: object, threat_type: str | None, action: str | None) -> DataFrame:
    """The window's rows that are no false positives, of a type and an action where those are known ones."""
    out = not_false_positive(recent(rows, as_of, hours_of(hours)))
    if threat_type in FILTER_TYPES:
        out = out.where(F.col("threat_type") == threat_type)
    if action in FILTER_ACTIONS:
        out = out.where(F.col("action_taken") == action)
    return out


def threat_page(
    rows: DataFrame, as_of: datetime, hours: object = None, limit: object = None, page: int = 1, threat_type: str | None = None, action: str | None = None
) -> DataFrame:
    """One page of the list, newest first; ties by id."""
    n = limit_of(limit)
    return filtered(rows, as_of, hours, threat_type, action).orderBy(F.desc("created_at"), F.desc("id")).offset((max(1, page) - 1) * n).limit(n)


def threat_count(rows: DataFrame, as_of: datetime, hours: object = None, threat_type: str | None = None, action: str | None = None) -> DataFrame:
    return filtered(rows, as_of, hours, threat_type, action).agg(F.count(F.lit(1)).alias("total"))


def find(rows: DataFrame, id: int) -> DataFrame:  # noqa: A002
    """The row with this id; an error where there is none."""
    found = rows.where(F.col("id") == id)
    if found.isEmpty():
        raise PySparkValueError(f"no threat with id {id}")
    return found


def action_label() -> Column:
    c, out = F.col("action_taken"), None
    for name, label in ACTION_LABELS.items():
        out = F.when(c == name, label) if out is None else out.when(c == name, label)
    return out.otherwise(upper_first(c))


def type_label() -> Column:
    c, out = F.col("threat_type"), None
    for name, label in TYPE_LABELS.items():
        out = F.when(c == name, label) if out is None else out.when(c == name, label)
    return out.otherwise(upper_first(F.replace(F.coalesce(c, F.lit("Unknown")), F.lit("_"), F.lit(" "))))


def severity() -> Column:
    s = F.col("confidence_score")
    return F.when(s >= 90, "red").when(s >= 70, "yellow").otherwise("green")


def labelled(rows: DataFrame) -> DataFrame:
    """Rows as they are shown: labels, badge colour, clock time, and a name for a missing source."""
    return rows.select(
        "id",
        type_label().alias("type_label"),
        action_label().alias("action_label"),
        severity().alias("severity"),
        (F.col("confidence_score") >= 70).alias("is_high_confidence"),
        F.coalesce("threat_source", F.lit("Unknown")).alias("source"),
        F.date_format("created_at", "HH:mm:ss").alias("clock"),
    )


def dashboard(rows: DataFrame, as_of: datetime) -> dict[str, DataFrame]:
    return {
        "stats": summary(rows, as_of),
        "recent": recent_threats(rows, as_of),
        "top_sources": top_sources(rows, as_of),
        "top_ips": top_ips(rows, as_of),
        "timeline": timeline(rows, as_of),
        "confidence": confidence_breakdown(rows, as_of),
    }


def stats_report(rows: DataFrame, as_of: datetime, hours: int = 24) -> dict[str, DataFrame]:
    """The console report: six of the counts, five addresses, five sources, and the breakdown."""
    shown = ("total", "ai_crawlers", "prompt_injections", "data_harvesters", "blocked", "rate_limited")
    return {
        "summary": summary(rows, as_of, hours).select(*shown),
        "top_ips": top_ips(rows, as_of, 5, hours),
        "top_sources": top_sources(rows, as_of, 5, hours).withColumn("threat_source", F.coalesce("threat_source", F.lit("Unknown"))),
        "confidence": confidence_breakdown(rows, as_of, hours),
    }


def as_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON objects in a success envelope each."""
    return rows.select(F.to_json(F.struct(F.struct("*").alias("data"), F.lit("success").alias("status"))).alias("json"))


def page_json(
    rows: DataFrame, as_of: datetime, hours: object = None, limit: object = None, page: int = 1, threat_type: str | None = None, action: str | None = None
) -> DataFrame:
    """One page of the list in a success envelope: its rows, newest first, and where it stands.  A page holds at most 200 rows."""
    n = limit_of(limit)
    shown = threat_page(rows, as_of, hours, limit, page, threat_type, action)
    listed = shown.agg(F.collect_list(F.struct(F.col("created_at"), F.col("id"), F.struct("*").alias("row"))).alias("found"))
    newer = lambda a, b: F.when(a["created_at"] > b["created_at"], -1).when(a["created_at"] < b["created_at"], 1).otherwise(F.signum(b["id"] - a["id"]).cast("int"))
    newest = F.transform(F.array_sort("found", newer), lambda x: x["row"])
    total = threat_count(rows, as_of, hours, threat_type, action)
    place = F.struct(
        newest.alias("data"), F.lit(max(1, page)).alias("current_page"), F.lit(n).alias("per_page"), "total", F.greatest(F.ceil(F.col("total") / n), F.lit(1)).alias("last_page")
    )
    # One row beside one row.
    both = listed.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one")
    return both.select(F.to_json(F.struct(place.alias("data"), F.lit("success").alias("status"))).alias("json"))


def flush_survivors(rows: DataFrame, as_of: datetime, confirm: str | None, hours: int | None = None) -> DataFrame:
    """What a flush leaves: rows of the last ``hours``, or none.  Rows without a time are not older, and stay."""
    if confirm != "yes":
        raise PySparkValueError("a flush needs confirm=yes")
    if hours is None:
        return rows.where(F.lit(False))
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours_of(hours)} HOURS")
    return rows.where(F.coalesce(F.col("created_at") >= cutoff, F.lit(True)))


def with_false_positives(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows with those in ``marks`` (id) marked as false positives.  Marks are appended, never updated in place."""
    marked = marks.select(F.col("id").alias("mark_id")).distinct()
    out = rows.join(marked, F.col("id") == F.col("mark_id"), "left")
    return out.withColumn("is_false_positive", F.col("is_false_positive") | F.col("mark_id").isNotNull()).drop("mark_id")


def detector_info(spark: SparkSession, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Counts and flags of the detectors, one row."""
    known = signatures(config.signatures_path)
    info = {
        "crawler_patterns_count": len(config.crawlers),
        "harvester_patterns_count": len(config.harvesters),
        "bot_signatures_count": len(known),
        "bot_categories_count": len(categories(config.signatures_path)),
        "ai_crawlers_enabled": config.crawlers_enabled,
        "data_harvesters_enabled": config.harvesters_enabled,
        "prompt_patterns": len(INJECTIONS),
        "pii_patterns": len(PII),
        "trap_paths": len(config.trap_paths),
        "honeypot_enabled": config.honeypot_enabled,
        "response_scanning_enabled": config.response_enabled,
        "robots_txt_enabled": config.robots_enabled,
        "fingerprinting_enabled": config.fingerprint_enabled,
        "ml_enabled": config.ml.enabled,
        "ml_driver": config.ml.driver,
    }
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in info.items()])


def feature_status(spark: SparkSession, config: Config = Config(), path: str = SIGNATURES) -> DataFrame:  # noqa: B008
    return spark.range(1).select(
        F.lit(config.enabled).alias("enabled"),
        F.lit(config.mode).alias("mode"),
        F.struct(
            F.lit(config.signatures_enabled).alias("enabled"), F.lit(len(signatures(path))).alias("total_bots"), F.lit(len(categories(path))).alias("categories")
        ).alias("bot_signatures"),
        F.lit(config.crawlers_enabled).alias("ai_crawlers"),
        F.lit(config.injection_enabled).alias("prompt_injection"),
        F.lit(config.harvesters_enabled).alias("data_harvesters"),
        F.lit(config.honeypot_enabled).alias("honeypot"),
        F.lit(config.response_enabled).alias("response_scanning"),
        F.lit(config.robots_enabled).alias("robots_txt"),
        F.lit(config.fingerprint_enabled).alias("fingerprinting"),
        F.struct(F.lit(config.ml.enabled).alias("enabled"), F.lit(config.ml.driver).alias("driver")).alias("ml_detection"),
    )
