"""The registered queries in plain SQL, for an engine that checks them."""

from __future__ import annotations

from palisade.config import Config
from palisade.functions.patterns import BROWSER_HEADERS, INJECTIONS, PII, SCANNED_TYPES
from palisade.functions.text import LOWER, UPPER, ascii_lower_text
from palisade.operators.robots import disallowed
from palisade.sources.catalog import signatures
from palisade.sources.derived import HEADERS, REQUESTS_SQL, RESPONSES_SQL, ROBOTS, column_of


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def low(expr: str) -> str:
    return f"translate({expr}, '{UPPER}', '{LOWER}')"


def h(name: str) -> str:
    return column_of(name.lower())


REQ = f"req AS ({REQUESTS_SQL})"
RESP = f"resp AS ({RESPONSES_SQL})"
UA = low("coalesce(user_agent, '')")
PATH = "concat('/', trim(path, '/'))"


def empty(c: str) -> str:
    return f"({c} IS NULL OR {c} IN ('', '0'))"


def values(name: str, columns: str, rows: list[str]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join(rows)})"


def needles(name: str, items: tuple[str, ...]) -> str:
    return values(name, "ord, needle, low", [f"({i}, {q(x)}, {q(ascii_lower_text(x))})" for i, x in enumerate(items, 1)])


def catalogue(config: Config) -> str:
    return values(
        "catalogue",
        "ord, category, label, confidence, threat_type, needle, low",
        [f"({s.ord}, {q(s.category)}, {q(s.label)}, {s.confidence}, {q(s.threat_type)}, {q(s.needle)}, {q(ascii_lower_text(s.needle))})" for s in signatures(config.signatures_path)],
    )


def first(name: str, table: str, columns: str) -> str:
    """A CTE of each request's first needle in a list."""
    return (
        f"{name} AS (SELECT * FROM (SELECT request_id, {columns}, row_number() OVER (PARTITION BY request_id ORDER BY ord) AS rn "
        f"FROM req JOIN {table} AS n ON contains({UA}, n.low)) AS x WHERE rn = 1)"
    )


def place_cte(config: Config) -> str:
    return catalogue(config) + ", " + first("place", "catalogue", "ord, category, label, confidence, threat_type, needle")


def live_category(config: Config) -> str:
    return f"category NOT IN ({', '.join(q(c) for c in config.disabled_categories)})" if config.disabled_categories else "true"


def crawler_ctes(config: Config) -> str:
    return ", ".join(
        [needles("crawlers", config.crawlers), first("crawl", "crawlers", "needle"), needles("harvesters", config.harvesters), first("harvest", "harvesters", "needle")]
    )


HARVEST = f"""
  SELECT r.request_id, 3 AS ord, 'data_harvester' AS threat_type, n.needle AS threat_source,
    least((CASE WHEN n.needle IS NULL THEN 0 ELSE 80 END) + (CASE WHEN {empty("h_accept_language")} THEN 20 ELSE 0 END), 100) AS confidence_score,
    coalesce(n.needle, 'missing_accept_language') AS matched_pattern
  FROM req AS r LEFT JOIN harvest AS n USING (request_id) WHERE n.needle IS NOT NULL OR {empty("h_accept_language")}"""


def bots_cte(config: Config) -> str:
    return f"""{place_cte(config)}, {crawler_ctes(config)}, bots AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY confidence_score DESC, ord) AS rn FROM (
    SELECT request_id, 1 AS ord, threat_type, needle AS threat_source, confidence AS confidence_score, needle AS matched_pattern FROM place WHERE {live_category(config)}
    UNION ALL SELECT request_id, 2, 'ai_crawler', needle, 95, needle FROM crawl
    UNION ALL {HARVEST}) AS c) AS ranked WHERE rn = 1)"""


def injection_case(value: str, config: Config) -> str:
    tests = " ".join(f"WHEN regexp_matches({value}, {q('(?i)' + p)}) THEN {q(p)}" for p in INJECTIONS)
    return f"CASE WHEN {value} IS NULL OR octet_length(encode({value})) > {config.max_input_length} THEN NULL {tests} END"


def snippet(value: str, n: int) -> str:
    """The derived values that are long enough to be cut are ASCII."""
    return f"CASE WHEN octet_length(encode({value})) <= {n} THEN {value} ELSE concat(substr({value}, 1, {n}), '...') END"


def injection_cte(config: Config) -> str:
    return f"""inj AS (SELECT request_id, coalesce(p1, p2, p3) AS matched_pattern,
    CASE WHEN p1 IS NOT NULL THEN {snippet("payload", config.max_payload_length)} WHEN p2 IS NOT NULL THEN {snippet("note", config.max_payload_length)}
      ELSE {snippet("q", config.max_payload_length)} END AS payload_snippet
  FROM (SELECT *, {injection_case("payload", config)} AS p1, {injection_case("note", config)} AS p2, {injection_case("q", config)} AS p3 FROM req) AS x
  WHERE coalesce(p1, p2, p3) IS NOT NULL)"""


def traps_cte(config: Config) -> str:
    return (
        values("traps", "trap, low", [f"({q(t)}, {q(ascii_lower_text(t))})" for t in config.trap_paths])
        + f", honey AS (SELECT request_id, trap FROM req JOIN traps ON {low(PATH)} = traps.low)"
    )


def fingerprint_cte(config: Config) -> str:
    missing = " + ".join(f"(CASE WHEN {h(x)} IS NULL THEN 1 ELSE 0 END)" for x in BROWSER_HEADERS)
    names = lambda order: "[" + ", ".join(f"CASE WHEN {column_of(x)} IS NULL THEN NULL ELSE '{x}' END" for x in order) + "]"
    present = f"list_filter(CASE WHEN sorted_headers = 1 THEN {names(sorted(HEADERS))} ELSE {names(HEADERS)} END, lambda x: x IS NOT NULL)"
    return f"""prints AS (SELECT *, {missing} AS missing, {present} AS names FROM req),
  signals AS (SELECT *,
    CASE WHEN missing > 4 THEN least(missing * 5, 30) ELSE 0 END AS s1,
    CASE WHEN len(names) >= 3 AND list_sort(names) = names THEN 15 ELSE 0 END AS s2,
    CASE WHEN h_accept IS NULL OR (h_accept = '*/*' AND method = 'GET') THEN 15 ELSE 0 END AS s3,
    CASE WHEN h_connection IS NULL OR {low("h_connection")} = 'close' THEN 10 ELSE 0 END AS s4,
    CASE WHEN h_sec_fetch_site IS NULL AND h_referer IS NULL THEN 5 ELSE 0 END AS s5 FROM prints),
  printed AS (SELECT request_id, least(s1 + s2 + s3 + s4 + s5, 100) AS confidence_score,
    concat_ws(', ', CASE WHEN s1 > 0 THEN concat('missing_', missing, '_browser_headers') END, CASE WHEN s2 > 0 THEN 'alphabetical_header_order' END,
      CASE WHEN s3 > 0 THEN 'anomalous_accept_header' END, CASE WHEN s4 > 0 THEN 'no_keep_alive' END, CASE WHEN s5 > 0 THEN 'no_navigation_context' END) AS matched_pattern
    FROM signals WHERE s1 + s2 + s3 + s4 + s5 >= {config.fingerprint_min_score})"""


def robots_cte(config: Config, text: str = ROBOTS) -> str:
    rows, i = [], 0
    for s in signatures(config.signatures_path):
        for i, rule in enumerate(disallowed(text, s.needle), 1):
            prefix = rule.rstrip("*") if rule.endswith("*") else rule
            rows.append(f"({s.ord}, {i}, {q(rule)}, {q('' if rule == '/' else prefix)})")
    return (
        values("rules", "bot, ord, rule, prefix", rows)
        + f""", broken AS (SELECT * FROM (SELECT r.request_id, rules.rule, row_number() OVER (PARTITION BY r.request_id ORDER BY rules.ord) AS rn
    FROM req AS r JOIN place USING (request_id) JOIN rules ON rules.bot = place.ord AND starts_with({PATH.replace("path", "r.path")}, rules.prefix)) AS x WHERE rn = 1)"""
    )


def leaks_cte(config: Config) -> str:
    types = " OR ".join(f"contains({low('coalesce(content_type, chr(32))')}, {q(t)})" for t in SCANNED_TYPES)
    kinds = [p for p in PII if p[0] not in config.pii_disabled]
    part = lambda i: ", ".join(f"CASE WHEN regexp_matches(body, {q(p[3])}) THEN {q(str(p[i]))} END" for p in kinds)
    score = ", ".join(f"CASE WHEN regexp_matches(body, {q(p[3])}) THEN {p[2]} ELSE 0 END" for p in kinds)
    return f"""leaks AS (SELECT * FROM (SELECT request_id, body, greatest({score}) AS confidence_score, concat_ws(', ', {part(0)}) AS matched_pattern,
    concat('PII detected: ', concat_ws(', ', {part(1)})) AS payload_snippet FROM resp WHERE ({types}) AND body <> '') AS x WHERE confidence_score > 0)"""


def action_sql(config: Config) -> str:
    named = {"block": "blocked", "rate_limit": "rate_limited"}.get(config.mode)
    return f"CASE WHEN confidence_score >= {config.confidence_threshold} THEN {q(named)} ELSE 'logged' END" if named else "'logged'"


def threats_ctes(config: Config) -> str:
    """Everything up to ``threats``, with all detectors that the settings turn on."""
    parts = [REQ, RESP, bots_cte(config), injection_cte(config), traps_cte(config)]
    bot = "SELECT b.request_id, 2 AS ord, threat_type, threat_source, confidence_score, matched_pattern, NULL AS payload_snippet FROM bots AS b"
    if config.robots_enabled:
        parts.append(robots_cte(config))
        bot = f"""SELECT b.request_id, 2 AS ord, threat_type, threat_source,
      CASE WHEN rule IS NULL THEN confidence_score ELSE least(confidence_score + {config.robots_boost}, 100) END AS confidence_score,
      CASE WHEN rule IS NULL THEN matched_pattern ELSE concat(matched_pattern, ' + robots.txt disallow: ', rule) END AS matched_pattern,
      NULL AS payload_snippet FROM bots AS b LEFT JOIN broken USING (request_id)"""
    candidates = [
        "SELECT request_id, 1 AS ord, 'honeypot_trap' AS threat_type, 'honeypot' AS threat_source, 100 AS confidence_score, trap AS matched_pattern, NULL AS payload_snippet FROM honey",
        bot,
        "SELECT request_id, 3, 'prompt_injection', 'prompt_injection_pattern', 90, matched_pattern, payload_snippet FROM inj",
    ]
    if config.fingerprint_enabled:
        parts.append(fingerprint_cte(config))
        candidates.append("SELECT request_id, 4, 'suspicious_fingerprint', 'fingerprint_analysis', confidence_score, matched_pattern, NULL FROM printed")
    picked = f"""picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY confidence_score DESC, ord) AS rn
    FROM ({" UNION ALL ".join(candidates)}) AS c) AS ranked WHERE rn = 1)"""
    both = "SELECT request_id, 0 AS phase, threat_type, threat_source, confidence_score, matched_pattern, payload_snippet FROM picked"
    if config.response_enabled:
        parts.append(leaks_cte(config))
        both += " UNION ALL SELECT request_id, 1, 'pii_leak', 'response_scanner', confidence_score, matched_pattern, payload_snippet FROM leaks"
    return ",\n".join(
        [
            *parts,
            picked,
            f"""threats AS (SELECT r.request_id * 2 + t.phase AS id, r.ip AS ip_address, r.user_agent, t.threat_type, t.threat_source, t.confidence_score,
    r.url AS request_url, r.method AS request_method, t.matched_pattern, substr(t.payload_snippet, 1, {config.max_payload_length}) AS payload_snippet,
    {action_sql(config)} AS action_taken, false AS is_false_positive, r.ts AS created_at
  FROM ({both}) AS t JOIN req AS r USING (request_id))""",
        ]
    )
