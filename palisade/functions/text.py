"""String functions with byte lengths and ASCII-only case folding, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower_text(value: str) -> str:
    return value.translate(str.maketrans(UPPER, LOWER))


def ascii_lower(c: Column) -> Column:
    """Lower A-Z alone: ``lower`` would also fold the Kelvin sign to k."""
    return F.translate(c, UPPER, LOWER)


def contains_ci(hay: Column, needle: str) -> Column:
    return F.contains(ascii_lower(hay), F.lit(ascii_lower_text(needle)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.  Naming a column twice copies its whole expression into the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constants(values: list) -> Column:
    """An array of strings or whole numbers.  Written as one text that Spark splits once, while planning: a column for each value is slow to build."""
    mark = "\x1f"
    texts = F.split(F.lit(mark.join(map(str, values))), mark)
    return texts.cast("array<int>") if isinstance(values[0], int) else texts


def first_needle(hay: Column, needles: list[str]) -> Column:
    """The place (from 1) of the first needle of the list that the text contains; null if none.

    The list is one constant, so the expression stays small however long the list: no join, no shuffle.
    """
    if not needles:
        return F.lit(None).cast("int")
    lows = constants([ascii_lower_text(n) for n in needles])
    place = let(ascii_lower(hay), lambda low: F.array_position(F.transform(lows, lambda n: F.contains(low, n)), True))
    return F.nullif(place, F.lit(0)).cast("int")


def pick(place: Column, values: list) -> Column:
    """The value at a place counted from 1; null for a null place."""
    return F.get(constants(values), place - 1) if values else F.lit(None)


def byte_length(c: Column) -> Column:
    return F.octet_length(c)


def byte_head(c: Column, n: int) -> Column:
    """The first n bytes, less a code point that the cut would split; null for null."""

    def cut(text: Column) -> Column:
        raw = text.cast("binary")
        heads = [F.substring(raw, 1, max(n - k, 0)).cast("string") for k in range(4)]
        whole = F.coalesce(*[F.when(F.is_valid_utf8(h), h) for h in heads], F.lit(""))
        return F.when(byte_length(text) <= n, text).when(text.isNotNull(), whole)

    return let(c, cut)


def snippet(c: Column, n: int) -> Column:
    return F.when(byte_length(c) <= n, c).otherwise(F.concat(byte_head(c, n), F.lit("...")))


def is_empty(c: Column) -> Column:
    """Null, '' and '0' are empty."""
    return c.isNull() | c.isin("", "0")


def upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def redact(c: Column) -> Column:
    """All stars up to 6 bytes; else the first and last three characters and stars between."""
    n = byte_length(c)
    return F.when(n <= 6, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(c, F.lit(3)), F.repeat(F.lit("*"), n - 6), F.right(c, F.lit(3))))


def first_characters(pattern: str) -> str:
    """What a match can begin with: the pattern starts with a literal or with a group of literals, after ``\\b`` perhaps."""
    head = pattern.removeprefix(r"\b")
    group, _, rest = head[1:].partition(")") if head[0] == "(" else (head, "", "")
    found = {x[1] if x[0] == "\\" else x[0] for x in (group.split("|") if head[0] == "(" else [head])}
    return "".join(sorted(found | set(first_characters(rest[1:]) if rest[:1] == "?" else "")))


def any_regex(patterns: tuple[str, ...]) -> str:
    """One regular expression for "one of these occurs", any case of ASCII letters.

    At most places of a text no pattern can begin: a look at the next character passes them by,
    and elsewhere it leaves the few patterns that begin with it.
    """
    by_first: dict[str, list[str]] = {}
    for p in patterns:
        for c in first_characters(p):
            by_first.setdefault(ascii_lower_text(c), []).append(jvm_regex(p))
    among = lambda cs: "[" + "".join("\\" + c if not c.isalnum() else c for c in cs) + "]"
    branches = "|".join(f"(?={among(c)})(?:{'|'.join(ps)})" for c, ps in sorted(by_first.items()))
    return f"(?i)(?={among(sorted(by_first))})(?:{branches})"


def jvm_regex(pattern: str) -> str:
    r"""``\b`` between ASCII words, as byte-wise engines take it: the JVM's looks at all letters."""
    if pattern.startswith(r"\b"):
        pattern = "(?<![A-Za-z0-9_])" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + "(?![A-Za-z0-9_])"
    return pattern
