"""Inbound detectors: each maps the columns of a request to a result struct.

Requests have request_id, ts, ip, method, url, path, user_agent, headers (ordered array of
name and value, names lower-case), inputs and query (arrays of path and value, in document
order) and raw_body.  Every detector is a column expression: a whole request is judged in one
narrow stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import Config
from palisade.functions.automaton import first_needles
from palisade.functions.patterns import BROWSER_HEADERS, INJECTIONS
from palisade.functions.text import any_regex, ascii_lower, ascii_lower_text, byte_length, contains_ci, first_needle, is_empty, let, pick, snippet
from palisade.operators.results import best, nothing, result
from palisade.sources.catalog import signatures


def with_headers(body: Callable[[Column], Column]) -> Column:
    """``body`` of the request's headers as two arrays, names and values, bound once however often it reads them."""
    both = lambda h: F.struct(F.transform(h, lambda x: x["name"]).alias("names"), F.transform(h, lambda x: x["value"]).alias("values"))
    return let(F.col("headers"), lambda h: let(both(h), body))


def header(heads: Column, name: str) -> Column:
    """The first value of a header; null where it is absent."""
    return F.get(heads["values"], F.array_position(heads["names"], F.lit(ascii_lower_text(name))) - 1)


def agent_text() -> Column:
    return F.coalesce(F.col("user_agent"), F.lit(""))


def normal_path() -> Column:
    """One leading slash and no trailing one."""
    return F.concat(F.lit("/"), F.trim(F.coalesce(F.col("path"), F.lit("")), F.lit("/")))


def whitelisted(config: Config) -> Column:
    ua = agent_text()
    out = F.lit(False)
    if config.whitelist_ips:
        out = out | F.coalesce(F.col("ip").isin(*config.whitelist_ips), F.lit(False))
    for agent in config.whitelist_agents:
        out = out | contains_ci(ua, agent)
    return out


def honeypot(config: Config) -> Column:
    """A trap path requested as a whole, in any case: score 100."""
    if not config.honeypot_enabled or not config.trap_paths:
        return nothing()
    spelled: dict[str, str] = {}
    for trap in config.trap_paths:
        spelled.setdefault(ascii_lower_text(trap), trap)
    traps = F.create_map(*[F.lit(x) for pair in spelled.items() for x in pair])
    hit = F.try_element_at(traps, ascii_lower(normal_path()))
    return F.when(hit.isNotNull(), result(F.lit("honeypot_trap"), F.lit("honeypot"), F.lit(100), hit))


def find_bot(config: Config, agent: Column) -> Column:
    """The place of the first catalogue needle in a user agent, whatever the toggles."""
    return first_needle(agent, [s.needle for s in signatures(config.signatures_path)])


#: From so many needles on, an automaton finds the first.
INLINE_NEEDLES = 2000


def judge_agents(requests: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Requests with ``agent``: the places of the user agent's first needle in catalogue, crawlers and harvesters.

    Agents are few beside requests, so each distinct one is judged once and joined back; Spark
    broadcasts them where their measured size allows it and else splits a frequent agent.  A
    stream has no distinct agents to wait for: there each row is judged by itself.  A few needles
    are tried one by one in the JVM; longer lists go through one automaton.
    """

    lists = {"bot": [s.needle for s in signatures(config.signatures_path)], "crawler": list(config.crawlers), "harvester": list(config.harvesters)}

    def found(agent: Column) -> Column:
        if sum(map(len, lists.values())) > INLINE_NEEDLES:
            return first_needles(agent, lists)
        return F.struct(*[first_needle(agent, needles).alias(name) for name, needles in lists.items()])

    if requests.isStreaming:
        return requests.withColumn("agent", found(agent_text()))
    # The count keeps filters on what is found above the aggregate: on keys alone they would be pushed to every row.
    agents = requests.groupBy(agent_text().alias("agent_text")).agg(F.count(F.lit(1)).alias("n"))
    agents = agents.select("agent_text", F.when(F.col("n") > 0, found(F.col("agent_text"))).alias("agent"))
    return requests.join(agents, agent_text() == F.col("agent_text"), "left").drop("agent_text")


def categorised_bot(config: Config, place: Column) -> Column:
    """The first needle's category, unless that category is off: later needles are not tried."""
    if not config.signatures_enabled:
        return nothing()
    known = signatures(config.signatures_path)
    off = set(config.disabled_categories)
    if not config.crawlers_enabled:
        off |= {"ai_training", "ai_assistants"}
    if not config.harvesters_enabled:
        off |= {"data_harvesters"}
    category = pick(place, [s.category for s in known])
    needle = pick(place, [s.needle for s in known])
    live = place.isNotNull() if not off else place.isNotNull() & ~category.isin(*sorted(off))
    return F.when(
        live,
        result(pick(place, [s.threat_type for s in known]), needle, pick(place, [s.confidence for s in known]), needle, None, category, pick(place, [s.label for s in known])),
    )


def crawler(config: Config, place: Column) -> Column:
    """The first configured crawler needle: score 95."""
    if not config.crawlers_enabled:
        return nothing()
    return let(pick(place, list(config.crawlers)), lambda hit: F.when(hit.isNotNull(), result(F.lit("ai_crawler"), hit, F.lit(95), hit)))


def harvester(config: Config, place: Column, heads: Column) -> Column:
    """The first harvester needle scores 80; an empty Accept-Language adds 20, or stands alone with a null source."""
    if not config.harvesters_enabled:
        return nothing()

    def judged(hit: Column) -> Column:
        score = F.when(hit.isNotNull(), 80).otherwise(0)
        detected, pattern = hit.isNotNull(), hit
        if config.check_accept_language:
            silent = is_empty(header(heads, "Accept-Language"))
            score = F.when(silent, F.least(score + 20, F.lit(100))).otherwise(score)
            detected = detected | silent
            pattern = F.coalesce(hit, F.lit("missing_accept_language"))
        return F.when(detected, result(F.lit("data_harvester"), hit, score, pattern))

    return let(pick(place, list(config.harvesters)), judged)


def bot(config: Config, heads: Column) -> Column:
    """Catalogue, crawler list and harvesters, in this order; the strictly highest score wins."""
    agent = F.col("agent")
    return best(categorised_bot(config, agent["bot"]), crawler(config, agent["crawler"]), harvester(config, agent["harvester"], heads))


def injection_pattern(value: Column) -> Column:
    """The first injection pattern, in list order, that a value contains; null for none.

    One expression tells whether any does; where one does, halving the list finds the first.
    """

    def first(patterns: tuple[str, ...]) -> Column:
        if len(patterns) == 1:
            return F.lit(patterns[0])
        half = len(patterns) // 2
        return F.when(value.rlike(any_regex(patterns[:half])), first(patterns[:half])).otherwise(first(patterns[half:]))

    return F.when(value.rlike(any_regex(INJECTIONS)), first(INJECTIONS))


def scan_value(value: Column, config: Config) -> Column:
    """The result for one text.  Longer than the limit in bytes: not scanned."""
    found = F.when(byte_length(value) <= config.max_input_length, injection_pattern(value))
    cut = snippet(value, config.max_payload_length)
    return let(found, lambda p: F.when(p.isNotNull(), result(F.lit("prompt_injection"), F.lit("prompt_injection_pattern"), F.lit(90), p, cut)))


def detect_text(value: Column, config: Config = Config()) -> Column:  # noqa: B008
    """A prompt injection in any text column."""
    return scan_value(value, config) if config.enabled else nothing()


def scanned_inputs(config: Config) -> Column | None:
    """Inputs less form tokens; where queries are scanned too, a query value replaces the input of its name, and those with numbers for names are added."""
    top = lambda x: F.substring_index(x["path"], ".", 1)
    inputs = F.filter(F.coalesce("inputs", F.array().cast("array<struct<path:string,value:string>>")), lambda x: ~top(x).isin("_token", "_method"))
    query = F.coalesce("query", F.array().cast("array<struct<path:string,value:string>>"))
    if not config.scan_inputs:
        return query if config.scan_query else None
    if not config.scan_query:
        return inputs

    def named(items: Column, kind: str) -> Column:
        key = lambda x: F.concat(F.when(top(x).rlike("^(0|[1-9][0-9]*)$"), F.lit(kind)).otherwise("named"), F.lit(":"), top(x))
        return F.transform(items, lambda x: F.struct(key(x).alias("key"), x.alias("item")))

    def merged(both: Column) -> Column:
        of = lambda items, key: F.transform(F.filter(items, lambda x: x["key"] == key), lambda x: x["item"])
        keys = F.array_distinct(F.concat(both["inputs"]["key"], both["query"]["key"]))
        return F.flatten(F.transform(keys, lambda k: let(of(both["query"], k), lambda found: F.when(F.size(found) > 0, found).otherwise(of(both["inputs"], k)))))

    return let(F.struct(named(inputs, "input").alias("inputs"), named(query, "query").alias("query")), merged)


def injection(config: Config) -> Column:
    """The first scanned value, in document order, that holds a pattern."""
    values = scanned_inputs(config) if config.injection_enabled else None
    if values is None:
        return nothing()
    hits = F.filter(F.transform(values, lambda x: scan_value(x["value"], config)), lambda r: r.isNotNull())
    return F.get(hits, F.lit(0))


def fingerprint(config: Config, heads: Column) -> Column:
    """Five additive signals on headers; under the least score, nothing."""
    if not config.fingerprint_enabled:
        return nothing()
    absent = F.array_except(F.array(*[F.lit(ascii_lower_text(h)) for h in BROWSER_HEADERS]), heads["names"])
    distinct = F.array_distinct(heads["names"])
    accept, connection = header(heads, "Accept"), header(heads, "Connection")
    alone = header(heads, "Sec-Fetch-Site").isNull() & header(heads, "Referer").isNull()
    unsent = accept.isNull() | ((accept == "*/*") & F.coalesce(F.col("method") == "GET", F.lit(False)))
    # Each signal is worked out once: its points and its name, or null.
    signal = lambda test, points, token: F.when(test, F.struct(points.cast("int").alias("points"), token.alias("token")))
    signals = F.array_compact(
        F.array(
            let(F.size(absent), lambda n: signal(n > 4, F.least(n * 5, F.lit(30)), F.concat(F.lit("missing_"), n.cast("string"), F.lit("_browser_headers")))),
            let(distinct, lambda d: signal((F.size(d) >= 3) & (F.array_sort(d) == d), F.lit(15), F.lit("alphabetical_header_order"))),
            signal(unsent, F.lit(15), F.lit("anomalous_accept_header")),
            signal(connection.isNull() | (ascii_lower(connection) == "close"), F.lit(10), F.lit("no_keep_alive")),
            signal(alone, F.lit(5), F.lit("no_navigation_context")),
        )
    )

    def judged(found: Column) -> Column:
        score = F.aggregate(found, F.lit(0), lambda n, s: n + s["points"])
        return F.when(
            score >= config.fingerprint_min_score,
            result(F.lit("suspicious_fingerprint"), F.lit("fingerprint_analysis"), F.least(score, F.lit(100)), F.array_join(found["token"], ", ")),
        )

    return let(signals, judged)


def fingerprint_hash() -> Column:
    """16 hex digits of the MD5 of the headers that tell clients apart."""
    part = lambda c: F.coalesce(c, F.lit(""))

    def joined(heads: Column) -> Column:
        told = [header(heads, h) for h in ("Accept-Language", "Accept-Encoding", "Accept")]
        return F.concat_ws("|", part(F.col("user_agent")), *map(part, told), part(F.array_join(F.array_distinct(heads["names"]), ",")))

    return F.substring(F.md5(with_headers(joined).cast("binary")), 1, 16)
