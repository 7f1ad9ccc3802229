"""robots.txt: parsing, matching, the score boost, and writing one from the catalogue.

A few rules are an expression of the row (``violation``).  Many rules, and rules that change
over time, are a table: a path is spread into its prefixes, as long as rules have, and those are
joined to the rules' prefixes (``broken_rules``), so the plan is as large for 50,000 rules as for
five.  Which version of the file holds for a request goes by its time.
"""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.config import SIGNATURES, Config
from palisade.functions.text import ascii_lower, ascii_lower_text, constants, let, pick
from palisade.operators.detectors import normal_path
from palisade.operators.results import RESULT
from palisade.sources.catalog import signature_table, signatures

ALL = ("ai_training", "ai_assistants", "seo_tools", "scrapers", "bad_bots", "data_harvesters")
DEFAULT = ("ai_training", "ai_assistants")
WELCOME = ("Googlebot", "Bingbot", "*")


def read_robots(spark: SparkSession, path: str) -> str | None:
    """The file's text; null where it is missing or unreadable.  A site's rules are one small file."""
    try:
        found = spark.read.text(path, wholetext=True).first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return found.value if found else ""


def parse_robots(text: str) -> list[tuple[str, list[str]]]:
    """(agent, disallowed paths) of each User-agent line: a line starts a group of its own."""
    groups: list[tuple[str, list[str]]] = []
    for line in text.split("\n"):
        line = line.strip(" \t\n\r\0\x0b")
        low = ascii_lower_text(line)
        if low.startswith("user-agent:"):
            groups.append((line[11:].strip(" \t\n\r\0\x0b"), []))
        elif low.startswith("disallow:") and groups and line[9:].strip(" \t\n\r\0\x0b"):
            groups[-1][1].append(line[9:].strip(" \t\n\r\0\x0b"))
    return groups


def disallowed(text: str | None, bot: str | None) -> list[str]:
    """The rules for a bot, each once: those of ``*`` and of agents whose line contains its name."""
    found: list[str] = []
    for agent, rules in parse_robots(text or ""):
        if agent == "*" or bot is not None and ascii_lower_text(bot) in ascii_lower_text(agent):
            found += rules
    return list(dict.fromkeys(found))


def rules_table(spark: SparkSession, text: str | None) -> DataFrame:
    """agent, ord, rule of every rule line."""
    rows = [(agent, i, rule) for i, (agent, rule) in enumerate(((a, r) for a, rules in parse_robots(text or "") for r in rules), 1)]
    return spark.createDataFrame(rows, "agent string, ord int, rule string")


def path_matches(path: Column, rule: str) -> Column:
    return F.lit(True) if rule == "/" else F.startswith(path, F.lit(matched_prefix(rule)))


def matched_prefix(rule: str) -> str:
    """What a path must begin with to break a rule; every path begins with a slash."""
    return rule.rstrip("*") if rule.endswith("*") else rule


def violation(config: Config, text: str | None, place: Column) -> Column:
    """The first rule against this bot (a catalogue place) that the path breaks; null for none.

    Bots with the same rules share a branch, so the expression has as many as the file has kinds of bots.
    """
    if not config.robots_enabled or text is None:
        return F.lit(None).cast("string")
    kinds: dict[tuple[str, ...], int] = {}
    of = [kinds.setdefault(tuple(disallowed(text, s.needle)), len(kinds)) for s in signatures(config.signatures_path)]
    path, kind = normal_path(), pick(place, of)
    out = F.lit(None).cast("string")
    for rules, k in kinds.items():
        if rules:
            first = F.coalesce(*[F.when(path_matches(path, rule), F.lit(rule)) for rule in rules])
            out = F.when(place.isNotNull() & (kind == k), first).otherwise(out)
    return out


#: Versions of a site's rules: when each came into force (None: from the start) and its text, or None for no file.
Versions = list[tuple[datetime | None, str | None]]
#: From so many rule lines on they are joined, not tried one by one.
INLINE_RULES = 200


def rule_count(text: str | None) -> int:
    return sum(len(rules) for _, rules in parse_robots(text or ""))


def read_versions(rows: DataFrame) -> Versions:
    """The versions in a table (valid_from, text).  A site has few, and each is one small file."""
    return sorted(((r.valid_from, r.text) for r in rows.select("valid_from", "text").collect()), key=lambda v: (v[0] is not None, v[0] or datetime.min))


def rule_tables(spark: SparkSession, versions: Versions, config: Config) -> tuple[DataFrame, DataFrame, list[int]]:
    """Rules (version, grp, prefix, ord, rule), which groups hold for a catalogue place (version, bot, grp), and the lengths of prefixes."""
    rules, members, lengths = [], [], set()
    for v, (_, text) in enumerate(versions):
        at = 0
        agents: dict[str, list[int]] = {}
        for g, (agent, found) in enumerate(parse_robots(text or "")):
            agents.setdefault(ascii_lower_text(agent), []).append(g)
            for rule in found:
                rules.append((v, g, matched_prefix(rule), at, rule))
                lengths.add(len(matched_prefix(rule)))
                at += 1
        for s in signatures(config.signatures_path):
            low = ascii_lower_text(s.needle)
            members += [(v, s.ord, g) for agent, groups in agents.items() if agent == "*" or low in agent for g in groups]
    table = lambda rows, names, kinds: spark.createDataFrame(
        pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})
    )
    number, text = pa.int32(), pa.string()
    return (
        table(rules, ("version", "grp", "prefix", "ord", "rule"), (number, number, text, number, text)),
        table(members, ("version", "bot", "grp"), (number, number, number)),
        sorted(lengths),
    )


def version_of(versions: Versions) -> Column:
    """The version that holds at a row's ``ts``: the last one in force by then; null before the first.  A row without a time has the first without one, if any."""
    starts = [F.lit(t).cast("timestamp_ntz") if t is not None else F.lit(None).cast("timestamp_ntz") for t, _ in versions]
    begun = F.filter(F.array(*starts), lambda t: t.isNull() | F.coalesce(t <= F.col("ts").cast("timestamp_ntz"), F.lit(False)))
    return F.when(F.size(begun) > 0, F.size(begun) - 1)


def broken_rules(judged: DataFrame, versions: Versions, config: Config, into: str = "rule") -> DataFrame:
    """Requests (with ``agent``, see ``judge_agents``) and the first rule that each breaks, or null.

    Each pair of a bot and a path that requests have is looked up once: the path's prefixes meet
    the rules of the bot's groups by equality, the rule that stands first in the file wins, and
    what was found is joined back.
    """
    rows = judged.withColumns({"_version": version_of(versions), "_path": normal_path()}) if config.robots_enabled and versions else None
    if rows is None:
        return judged.withColumn(into, F.lit(None).cast("string"))
    rules, members, lengths = rule_tables(judged.sparkSession, versions, config)
    asked = rows.where("agent.bot IS NOT NULL AND _version IS NOT NULL").groupBy(F.col("_version").alias("version"), F.col("agent.bot").alias("bot"), F.col("_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    fitting = F.filter(constants(lengths), lambda n: n <= F.length("path")) if lengths else F.array().cast("array<int>")
    spread = asked.select("version", "bot", "path", F.explode(fitting).alias("n")).withColumn("prefix", F.expr("left(path, n)"))
    met = spread.join(members, ["version", "bot"]).join(rules, ["version", "grp", "prefix"])
    first = met.groupBy(F.col("version").alias("f_version"), F.col("bot").alias("f_bot"), F.col("path").alias("f_path")).agg(F.min_by("rule", "ord").alias(into))
    on = (F.col("_version") == F.col("f_version")) & (F.col("agent.bot") == F.col("f_bot")) & (F.col("_path") == F.col("f_path"))
    return rows.join(first, on, "left").drop("_version", "_path", "f_version", "f_bot", "f_path")


def boosted(found: Column, rule: Column, boost: int) -> Column:
    """A bot's result with the boost for breaking a rule."""

    def raised(x: Column) -> Column:
        score = F.least(x["r"]["confidence_score"] + boost, F.lit(100))
        pattern = F.concat(x["r"]["matched_pattern"], F.lit(" + robots.txt disallow: "), x["rule"])
        more = x["r"].withField("confidence_score", score).withField("matched_pattern", pattern).cast(RESULT)
        return F.when(x["r"].isNotNull() & x["rule"].isNotNull(), more).otherwise(x["r"])

    return let(F.struct(found.cast(RESULT).alias("r"), rule.alias("rule")), raised)


def selected(option: str | None = None, everything: bool = False) -> list[str]:
    """Categories from a comma-separated list; all but search engines; or the default two."""
    if everything:
        return list(ALL)
    return [c for c in (x.strip() for x in (",".join(DEFAULT) if option is None else option).split(",")) if c]


def generate(spark: SparkSession, as_of: datetime, option: str | None = None, everything: bool = False, path: str = SIGNATURES) -> DataFrame:
    """(ord, line) of a robots.txt that keeps the chosen categories out.

    A table of groups (section, place, agent, rule), ordered and spread over lines: first who
    wrote it and when, then a group for each bot of the chosen categories, then who may enter.
    """
    chosen = selected(option, everything)
    bots = signature_table(spark, path).withColumn("agent", F.rtrim("needle", F.lit("/ -"))).where("agent <> ''")
    order = F.array_position(F.array(*[F.lit(c) for c in chosen]).cast("array<string>"), F.col("category"))
    # A category that is named twice is written twice.
    times = F.filter(F.sequence(F.lit(1), F.lit(max(len(chosen), 1))), lambda i: F.get(F.array(*[F.lit(c) for c in chosen]).cast("array<string>"), i - 1) == F.col("category"))
    groups = bots.where(order > 0).select(F.explode(times).alias("section"), F.col("ord").alias("place"), "label", "agent", F.lit("Disallow: /").alias("rule"))
    of_section = Window.partitionBy("section")
    groups = groups.withColumn("first", F.min("place").over(of_section) == F.col("place")).withColumn("heading", F.format_string("# %s: %d kept out", "label", F.count(F.lit(1)).over(of_section)))
    open_rows = [(len(chosen) + 1, i, None, agent, "Allow: /", i == 1, "# welcome") for i, agent in enumerate(WELCOME, 1)]
    groups = groups.select("section", "place", "label", "agent", "rule", "first", "heading").unionByName(
        spark.createDataFrame(open_rows, "section int, place int, label string, agent string, rule string, first boolean, heading string")
    )
    lines = F.array_compact(F.array(F.when(F.col("first"), F.col("heading")), F.concat(F.lit("User-agent: "), "agent"), F.col("rule"), F.lit("")))
    head = [(0, 0, i, line) for i, line in enumerate((f"# robots.txt, written by palisade at {as_of:%Y-%m-%d %H:%M:%S}", f"# categories kept out: {', '.join(chosen)}", ""))]
    spread = groups.select("section", "place", F.posexplode(lines).alias("part", "line")).unionByName(spark.createDataFrame(head, "section int, place int, part int, line string"))
    # A file of some hundred lines: numbering it in one place is what the file needs.
    return spread.select(F.row_number().over(Window.orderBy("section", "place", "part")).alias("ord"), "line")


def write_robots(lines: DataFrame, path: str, append: bool = False) -> None:
    """The lines as one text file; in place of what is there, or after it and an empty line."""
    spark = lines.sparkSession
    before = read_robots(spark, path) if append else None
    body = [r.line for r in lines.orderBy("ord").collect()]
    text = "\n".join([*([before.rstrip("\n"), ""] if before else []), *body]) + "\n"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = files.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(place, True)
    files.rename(fresh, place)
