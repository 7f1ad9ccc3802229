"""Personal data and secrets in outgoing bodies."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.config import Config
from palisade.functions.patterns import PII, SCANNED_TYPES
from palisade.functions.text import byte_head, byte_length, contains_ci, jvm_regex, let, redact
from palisade.operators.results import result


def _holds(*parts: str) -> Callable[[Column], Column]:
    return lambda seen: functools.reduce(lambda a, b: a | b, [F.contains(seen["head"], F.lit(p)) for p in parts])


#: What a text must hold for a pattern to match: cheap to see, and most texts lack it.  ``digits``: four in a row.
GUARDS: dict[str, Callable[[Column], Column]] = {
    "email": _holds("@"),
    "phone": lambda seen: seen["digits"],
    "credit_card": lambda seen: seen["digits"] & seen["head"].rlike("[0-9]{13}"),
    "ssn": lambda seen: seen["digits"],
    "api_key": lambda seen: seen["head"].rlike("[a-zA-Z0-9]{20}"),
    "aws_key": _holds("AKIA", "ABIA", "ACCA", "ASIA"),
    "private_key": _holds("-----BEGIN "),
    "jwt_token": _holds("eyJ"),
    "ip_address": _holds("10.", "172.", "192.168."),
    "database_url": _holds("://"),
}


def scannable(content_type: Column) -> Column:
    out = F.lit(False)
    for kind in SCANNED_TYPES:
        out = out | contains_ci(F.coalesce(content_type, F.lit("")), kind)
    return out


def leaks(body: Column, config: Config) -> Column:
    """type, label, severity and the redacted first match of each kind found, in table order."""
    kinds = [p for p in PII if p[0] not in config.pii_disabled]

    def one(seen: Column, kind: str, label: str, severity: int, pattern: str) -> Column:
        # No pattern matches nothing, so an empty match is none: each is searched once, and only where it can be.
        found = F.when(GUARDS[kind](seen), F.nullif(F.regexp_extract(seen["head"], jvm_regex(pattern), 0), F.lit("")))
        told = lambda m: F.when(m.isNotNull(), F.struct(F.lit(kind).alias("type"), F.lit(label).alias("label"), F.lit(severity).alias("severity"), redact(m).alias("matched")))
        return let(found, told)

    head = body if config.max_response_length is None else byte_head(body, config.max_response_length)
    both = lambda head: F.struct(head.alias("head"), head.rlike("[0-9]{4}").alias("digits"))
    return let(head, lambda head: let(both(head), lambda seen: F.array_compact(F.array(*[one(seen, *p) for p in kinds]))))


def combine(found: Column) -> Column:
    """One result for a body's leaks: the gravest score, kinds and labels joined; null for none."""

    def joined(x: Column) -> Column:
        score = F.least(F.array_max(x["severity"]), F.lit(100))
        label = F.concat(F.lit("PII detected: "), F.array_join(x["label"], ", "))
        return F.when(F.size(x) > 0, result(F.lit("pii_leak"), F.lit("response_scanner"), score, F.array_join(x["type"], ", "), label))

    return let(found, joined)


def scan_response(content_type: Column, body: Column, config: Config) -> Column:
    """The leaks of a response; an empty array where it is not scanned."""
    empty = F.array().cast("array<struct<type:string,label:string,severity:int,matched:string>>")
    if not config.response_enabled:
        return empty
    return F.when(scannable(content_type) & (F.coalesce(byte_length(body), F.lit(0)) > 0), leaks(body, config)).otherwise(empty)
