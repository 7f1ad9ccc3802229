"""Settings with their defaults.  Operators read them when a plan is built, so what is off is absent from the plan."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# The user agents counted as crawlers and as data harvesters unless configured otherwise.
CRAWLERS = (
    "GPTBot", "ChatGPT-User", "Claude-Web", "ClaudeBot", "anthropic-ai", "CCBot", "PerplexityBot", "YouBot", "cohere-ai",
    "AI2Bot", "Bytespider", "Diffbot", "ImagesiftBot", "Omgilibot", "Applebot-Extended", "DataForSeoBot", "PetalBot", "Scrapy",
)
HARVESTERS = ("curl", "python-requests", "Go-http-client", "Java/", "libwww-perl", "Wget", "HTTPie", "axios", "node-fetch")
# Paths no visitor follows.
TRAP_PATHS = (
    "/admin-backup", "/wp-admin", "/wp-login.php", "/administrator", "/admin.php",
    "/api/v1/users.json", "/api/v1/config.json", "/api/internal/debug", "/api/v2/export",
    "/.env", "/.git/config", "/.aws/credentials", "/phpinfo.php", "/server-status", "/debug/vars",
    "/backup.sql", "/database.sql", "/dump.sql", "/users.csv", "/data/export.json",
    "/.svn/entries", "/.hg/store", "/.git/HEAD", "/.gitignore.bak",
    "/config.php.bak", "/web.config", "/crossdomain.xml", "/elmah.axd",
)

MODES = ("log_only", "block", "rate_limit")
#: The signature catalogue is data, read from here unless a path is given.
SIGNATURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data", "signatures.txt")


@dataclass(frozen=True)
class MlConfig:
    enabled: bool = False
    driver: str = "lakera"
    trigger_range: tuple[int, int] = (40, 85)
    regex_weight: float = 0.4
    score_field: str = "score"


@dataclass(frozen=True)
class Config:
    enabled: bool = True
    mode: str = "log_only"
    confidence_threshold: int = 70
    # inbound
    crawlers_enabled: bool = True
    crawlers: tuple[str, ...] = CRAWLERS
    harvesters_enabled: bool = True
    harvesters: tuple[str, ...] = HARVESTERS
    check_accept_language: bool = True
    signatures_enabled: bool = True
    signatures_path: str = SIGNATURES
    disabled_categories: tuple[str, ...] = ("search_engines",)
    injection_enabled: bool = True
    scan_inputs: bool = True
    scan_query: bool = False
    max_input_length: int = 10_000
    honeypot_enabled: bool = True
    trap_paths: tuple[str, ...] = TRAP_PATHS
    robots_enabled: bool = False
    robots_boost: int = 30
    fingerprint_enabled: bool = False
    fingerprint_min_score: int = 30
    ml: MlConfig = field(default_factory=MlConfig)
    # outbound
    response_enabled: bool = False
    max_response_length: int | None = 50_000
    pii_disabled: tuple[str, ...] = ("ip_address",)
    # actions, logging, alerts
    max_attempts: int = 60
    decay_minutes: int = 1
    log_headers: bool = True
    max_payload_length: int = 500
    alert_threshold: int = 90
    # never flagged
    whitelist_ips: tuple[str, ...] = ()
    whitelist_agents: tuple[str, ...] = ()
