"""Patterns for prompt injections and personal data, in the order in which they are tried."""

from __future__ import annotations

# Matched case-insensitively anywhere in a value; the text is what results report.
INJECTIONS = (
    r"ignore previous instructions",
    r"ignore all previous instructions",
    r"disregard (your|all|previous|the above)",
    r"forget (everything|all|your instructions|what)",
    r"override (your|all|previous|the)",
    r"you are now",
    r"act as (a|an|if)",
    r"pretend (you are|to be|that you)",
    r"roleplay as",
    r"your new (role|persona|identity|instructions)",
    r"from now on you (are|will|must)",
    r"(reveal|show|display|print|output|tell me) (your|the) (system prompt|instructions|rules|constraints)",
    r"what (are|were) your (original|initial|system|base) instructions",
    r"repeat (everything|all|your|the) (above|before|prior|previous)",
    r"\bDAN\b",
    r"do anything now",
    r"jailbreak",
    r"bypass (your|all|the|safety|content)",
    r"without (any |your )?(restrictions|limitations|filters|guidelines)",
    r"developer mode",
    r"admin mode",
    r"sudo (mode|access|override)",
    r"maintenance mode",
    r"debug mode",
    r"you are in (developer|admin|sudo|test)",
    r"(output|print|show|display|repeat|dump) (all|every|the) (data|records|entries|users|passwords|keys)",
    r"(ignore|bypass|skip) (validation|sanitization|security|filters)",
    r"<\|im_start\|>",
    r"<\|im_end\|>",
    r"\[INST\]",
    r"\[\/INST\]",
    r"<<SYS>>",
    r"<<\/SYS>>",
)

# Fixed values: (type, label, severity, case-sensitive pattern).
PII = (
    ("email", "Email Address", 70, r"[a-zA-Z0-9._%+\-]{3,}@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"),
    ("phone", "Phone Number", 75, r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"),
    ("credit_card", "Credit Card Number", 95, r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"),
    ("ssn", "Social Security Number", 95, r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b"),
    ("api_key", "API Key", 90, r"(?:sk|pk|api|key|token|secret|password|bearer)[-_]?(?:live|test|prod)?[-_]?[a-zA-Z0-9]{20,}"),
    ("aws_key", "AWS Access Key", 95, r"\b(?:AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16}\b"),
    ("private_key", "Private Key", 95, r"-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----"),
    ("jwt_token", "JWT Token", 85, r"eyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}"),
    ("ip_address", "Internal IP Address", 50, r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b"),
    ("database_url", "Database Connection String", 95, r"(?:mysql|postgres|pgsql|mongodb|redis|sqlite)://[^\s\"'<>]{10,}"),
)

# What a response must be to be scanned, what a browser sends, and what a log row keeps.
SCANNED_TYPES = ("text/html", "application/json", "text/plain", "text/xml", "application/xml")
BROWSER_HEADERS = (
    "Accept", "Accept-Language", "Accept-Encoding", "Sec-CH-UA", "Sec-CH-UA-Mobile", "Sec-CH-UA-Platform", "Sec-Fetch-Dest",
    "Sec-Fetch-Mode", "Sec-Fetch-Site", "Upgrade-Insecure-Requests", "DNT", "Connection",
)
LOGGED_HEADERS = ("User-Agent", "Accept", "Accept-Language", "Accept-Encoding", "Content-Type", "Referer", "X-Forwarded-For", "X-Real-IP")
