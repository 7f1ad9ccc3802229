"""From requests and responses to threat rows: one narrow stage for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import Config
from palisade.functions.patterns import LOGGED_HEADERS
from palisade.functions.text import byte_head
from palisade.operators import detectors, limiter, ml, responses, robots
from palisade.operators.results import best, each, nothing


def inbound(config: Config, robots_text: str | None = None, ml_score: Column | None = None, rule: Column | None = None) -> Column:
    """The strictly highest of honeypot, bot (with its robots.txt boost), injection (with its model score) and fingerprint.

    ``rule``: the rule of robots.txt that the request breaks, where that is known already.
    """

    def judged(heads: Column) -> Column:
        bot = detectors.bot(config, heads)
        if config.robots_enabled:
            broken = robots.violation(config, robots_text, F.col("agent")["bot"]) if rule is None else rule
            bot = robots.boosted(bot, broken, config.robots_boost)
        injection = detectors.injection(config)
        if config.ml.enabled and ml_score is not None:
            injection = ml.refined(injection, ml_score, config)
        return best(detectors.honeypot(config), bot, injection, detectors.fingerprint(config, heads))

    return detectors.with_headers(judged)


def action(config: Config, score: Column) -> Column:
    over = score >= config.confidence_threshold
    named = {"block": "blocked", "rate_limit": "rate_limited"}.get(config.mode)
    return F.when(over, F.lit(named)).otherwise("logged") if named else F.lit("logged")


def detect(
    requests: DataFrame, config: Config = Config(), robots_text: str | None = None, ml_score: Column | None = None, versions: robots.Versions | None = None  # noqa: B008
) -> DataFrame:
    """Requests that are not whitelisted, with ``threat`` (null: clean).

    ``versions``: in place of one text, the rules that held at each request's time.
    """
    if not config.enabled:
        return requests.where(F.lit(False)).withColumn("threat", nothing())
    live = detectors.judge_agents(requests.where(~detectors.whitelisted(config)), config)
    if config.robots_enabled and versions is None and not requests.isStreaming and robots.rule_count(robots_text) > robots.INLINE_RULES:
        versions = [(None, robots_text)]
    if versions is not None:
        live = robots.broken_rules(live, versions, config, "_broken")
        return live.withColumn("threat", inbound(config, None, ml_score, F.col("_broken"))).drop("agent", "_broken")
    return live.withColumn("threat", inbound(config, robots_text, ml_score)).drop("agent")


def detect_request(requests: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """The library call: bot and injection alone, injection on a tie; no whitelist and no other detector."""
    # Injection first: ``best`` keeps the first of equal scores.
    found = detectors.with_headers(lambda heads: best(detectors.injection(config), detectors.bot(config, heads)))
    return detectors.judge_agents(requests, config).withColumn("threat", found).drop("agent")


def http_status(config: Config, score: Column, allowed: Column | None = None) -> Column:
    """What the client gets: 403 blocked, 429 over the limit, else 200 (a clean request has a null score)."""
    over = F.coalesce(score >= config.confidence_threshold, F.lit(False))
    if config.mode == "block":
        return F.when(over, 403).otherwise(200)
    if config.mode == "rate_limit" and allowed is not None:
        return F.when(over & ~F.coalesce(allowed, F.lit(True)), 429).otherwise(200)
    return F.lit(200)


def _headers(config: Config) -> Column:
    if not config.log_headers:
        return F.lit(None).cast("map<string,string>")
    return detectors.with_headers(lambda heads: F.create_map(*[x for h in LOGGED_HEADERS for x in (F.lit(h), detectors.header(heads, h))]))


def log_rows(found: DataFrame, phase: int, config: Config) -> DataFrame:
    """Threat rows of detections; ``id`` is the request's twice, plus the phase (0 inbound, 1 outbound)."""
    t = F.col("threat")
    return found.select(*[c for c in found.columns if c != "threat"], each(F.col("threat")).alias("threat")).select(
        (F.col("request_id") * 2 + phase).alias("id"),
        F.col("ip").alias("ip_address"),
        "user_agent",
        t["threat_type"].alias("threat_type"),
        t["threat_source"].alias("threat_source"),
        t["confidence_score"].alias("confidence_score"),
        F.col("url").alias("request_url"),
        F.col("method").alias("request_method"),
        t["matched_pattern"].alias("matched_pattern"),
        byte_head(t["payload_snippet"], config.max_payload_length).alias("payload_snippet"),
        _headers(config).alias("headers_snapshot"),
        action(config, t["confidence_score"]).alias("action_taken"),
        F.lit(False).alias("is_false_positive"),
        F.lit(None).cast("string").alias("country_code"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )


def threats(
    requests: DataFrame, responses_df: DataFrame | None = None, config: Config = Config(), robots_text: str | None = None, ml_score: Column | None = None  # noqa: B008
) -> DataFrame:
    """All threat rows: at most one inbound and one outbound row a request."""
    rows = log_rows(detect(requests, config, robots_text, ml_score), 0, config)
    if responses_df is None or not config.response_enabled or not config.enabled:
        return rows
    out = requests.where(~detectors.whitelisted(config)).join(leaking(responses_df, config), "request_id")
    return rows.unionByName(log_rows(out, 1, config))


def leaking(responses_df: DataFrame, config: Config, *more: str) -> DataFrame:
    """request_id and ``threat`` (and more columns) of the responses that leak; they are few, so their requests are looked up and not the other way round."""
    found = responses.combine(responses.scan_response(F.col("content_type"), F.col("body"), config))
    return responses_df.select("request_id", *more, each(found).alias("threat"))


def response_outcome(found: Column, config: Config) -> Column:
    """A leaking response is replaced (500) in block mode, whatever its score."""
    return F.when(found.isNotNull() & F.lit(config.mode == "block"), 500)


def outcomes(
    requests: DataFrame, responses_df: DataFrame | None = None, config: Config = Config(), robots_text: str | None = None, ml_score: Column | None = None  # noqa: B008
) -> DataFrame:
    """What each request comes to: request_id, threat_type, confidence_score, action_taken (null: clean), allowed, http_status.

    In rate_limit mode the limiter counts the detected requests at or above the threshold alone;
    their log rows say ``rate_limited`` whether or not the limit was reached.  A request that
    passes (200) and whose response leaks is answered with 500 in block mode.
    Whitelisted requests, and all of them while detection is off, pass.
    """
    found = verdicts_of(requests, config, robots_text, ml_score)
    return answers(requests, found, None if responses_df is None else leaking(responses_df, config), config)


def verdicts_of(requests: DataFrame, config: Config = Config(), robots_text: str | None = None, ml_score: Column | None = None) -> DataFrame:  # noqa: B008
    """request_id, ts, rate_key, threat_type, confidence_score of the requests in which something was detected."""
    found = detect(requests, config, robots_text, ml_score)
    threat = found.select("request_id", "ts", limiter.rate_key().alias("rate_key"), each(F.col("threat")).alias("threat"))
    return threat.select("request_id", "ts", "rate_key", "threat.threat_type", "threat.confidence_score")


def answers(requests: DataFrame, threat: DataFrame, leaks: DataFrame | None, config: Config) -> DataFrame:
    """What requests come to, given what was detected in them and which responses leak (request_id and ``threat``)."""
    if config.mode == "rate_limit":
        threat = threat.withColumn("counted", F.col("confidence_score") >= config.confidence_threshold)
        threat = limiter.limit(threat, config, "counted", ("threat_type", "confidence_score"))
    else:
        threat = threat.withColumn("allowed", F.lit(None).cast("boolean"))
    threat = threat.select("request_id", "threat_type", "confidence_score", action(config, F.col("confidence_score")).alias("action_taken"), "allowed")
    out = requests.select("request_id").join(threat, "request_id", "left").withColumn("http_status", http_status(config, F.col("confidence_score"), F.col("allowed")))
    if leaks is not None and config.enabled and config.response_enabled:
        spared = requests.select("request_id", detectors.whitelisted(config).alias("spared"))
        leaks = leaks.select("request_id", response_outcome(F.col("threat"), config).alias("replaced"))
        leaks = leaks.join(spared.where("NOT spared"), "request_id", "left_semi")
        out = out.join(leaks, "request_id", "left")
        out = out.withColumn("http_status", F.when(F.col("http_status") == 200, F.coalesce("replaced", "http_status")).otherwise(F.col("http_status"))).drop("replaced")
    return out


def alerts(rows: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Rows that reach the alert threshold, with the message's fields."""
    return rows.where(F.col("confidence_score") >= config.alert_threshold).select(
        "id", "threat_type", F.col("threat_source").alias("source"), F.col("confidence_score").alias("confidence"), F.col("matched_pattern").alias("pattern")
    )
