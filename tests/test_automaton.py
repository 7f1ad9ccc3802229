"""The automaton against trying needles one by one, and large rule files."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_detectors import requests

from palisade.config import Config
from palisade.operators import detectors, robots
from palisade.plans import pipeline
from palisade.sources.catalog import signatures


def plain(text, needles):
    fold = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    return next((i for i, n in enumerate(needles, 1) if fold(n) in fold(text)), None) if text is not None else None


def test_first_of_lists(spark):
    from palisade.functions.automaton import Automaton, first_needles
    from palisade.session import ship

    ship(spark)
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abAB") for _ in range(n))
    lists = {"x": [word(rnd.randrange(1, 6)) for _ in range(60)], "y": ["ab", "AB", "zz", "K"], "none": []}
    texts = [None, "", "K", "K", "zZ", *[word(rnd.randrange(1, 30)) for _ in range(300)]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.f.x, r.f.y, r.f.none) for r in rows.select("i", first_needles(F.col("t"), lists).alias("f")).collect()}
    assert got == {i: (plain(t, lists["x"]), plain(t, lists["y"]), None) for i, t in enumerate(texts)}
    assert Automaton({"e": ["q", ""]}).first("q") == [1] and Automaton({"e": ["q", ""]}).first("x") == [2]


@pytest.fixture(scope="module")
def large_catalogue(tmp_path_factory):
    """100,000 needles after those of the catalogue, in its format."""
    path = tmp_path_factory.mktemp("catalogue") / "signatures.txt"
    lines = open(Config().signatures_path, encoding="utf-8").read().rstrip("\n").split("\n")
    path.write_text("\n".join([*lines, *[f'"made-up-agent-{i:06}"' for i in range(100_000)]]) + "\n", encoding="utf-8")
    return str(path)


def test_a_catalogue_of_100_000(spark, large_catalogue):
    """The plan does not grow with the catalogue, and the first needle is found all the same."""
    from palisade.session import ship

    ship(spark)
    config = Config(signatures_path=large_catalogue)
    known = signatures(large_catalogue)
    assert len(known) == 100_365
    agents = ["GPTBot/1.0", "x made-up-agent-099999 y", "MADE-UP-AGENT-000007", "Mozilla", "", None, "made-up-agent-000003 curl/8"]
    rows = requests(spark, [{"agent": a, "language": "en"} for a in agents])
    judged = detectors.judge_agents(rows, config)
    assert len(judged._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    needles = [s.needle for s in known]
    got = {r.request_id: r.agent.bot for r in judged.collect()}
    assert got == {i: plain(a or "", needles) for i, a in enumerate(agents, 1)}
    assert {r.request_id: r.threat.threat_source for r in pipeline.detect(rows, config).where("threat IS NOT NULL").collect()}[3] == "made-up-agent-000007"


def test_automaton_and_needles_agree(spark, monkeypatch):
    """The shipped catalogue through the automaton: the same verdicts as needle by needle."""
    from palisade.session import ship

    ship(spark)
    agents = ["GPTBot/1.0", "curl/8 GPTBot/1.0", "Mozilla", "", "SCRAPY/2", "Mozilla/5.0 (compatible; Googlebot/2.1; AhrefsBot/7.0)", "python-requests/2"]
    rows = requests(spark, [{"agent": a} for a in agents])
    told = lambda: sorted((r.request_id, r.agent.bot, r.agent.crawler, r.agent.harvester) for r in detectors.judge_agents(rows).collect())
    one_by_one = told()
    monkeypatch.setattr(detectors, "INLINE_NEEDLES", 0)
    assert told() == one_by_one


RULES = "\n".join(["User-agent: *", *[f"Disallow: /made/{i}/*" for i in range(50_000)], "Disallow: /private", "User-agent: AhrefsBot", "Disallow: /only/ahrefs", "Disallow: *", "User-agent: GPTBot", "Disallow: /"])


def test_a_file_of_50_000_rules(spark):
    """It is planned in a few seconds, and gives what trying each rule gives."""
    paths = ["/made/49999/x", "/made/4999/", "/made/4999", "/private/1", "/only/ahrefs", "/else", "", "//made"]
    rows = requests(spark, [{"agent": a, "language": "en", "path": p} for a in ("AhrefsBot/7", "GPTBot/1", "Mozilla", "curl/8") for p in paths])
    config = Config(robots_enabled=True)
    began = time.time()
    found = robots.broken_rules(detectors.judge_agents(rows, config), [(None, RULES)], config).select("request_id", "agent.bot", "path", "rule")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert time.time() - began < 5 and len(plan) < 100_000
    known = signatures(config.signatures_path)

    def want(bot, path):
        path = "/" + (path or "").strip("/")
        rules = robots.disallowed(RULES, known[bot - 1].needle)
        return next((r for r in rules if r == "/" or path.startswith(r.rstrip("*") if r.endswith("*") else r)), None)

    got = found.collect()
    assert len(got) == len(paths) * 4
    for r in got:
        assert r.rule == (None if r.bot is None else want(r.bot, r.path)), r
    # The pipeline joins such a file by itself.
    threats = {r.request_id: r.threat.matched_pattern for r in pipeline.detect(rows, config, RULES).where("threat IS NOT NULL").collect()}
    assert threats[1] == "AhrefsBot + robots.txt disallow: /made/49999/*" and threats[5] == "AhrefsBot + robots.txt disallow: /only/ahrefs"


def test_rules_of_a_time(spark):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 10)
    versions = [(start, "User-agent: *\nDisallow: /a"), (start + timedelta(hours=1), None), (start + timedelta(hours=2), "User-agent: *\nDisallow: /b")]
    hours = [-1, 0, 0.99, 1, 2, 50, None]
    rows = requests(spark, [{"agent": "AhrefsBot/7", "path": p, "ts": None if h is None else start + timedelta(hours=h)} for h in hours for p in ("/a", "/b")])
    config = Config(robots_enabled=True)
    found = robots.broken_rules(detectors.judge_agents(rows, config), versions, config)
    got = [r.rule for r in found.orderBy("request_id").collect()]
    assert got == [None, None, "/a", None, "/a", None, None, None, None, "/b", None, "/b", None, None]
    table = spark.createDataFrame(list(reversed(versions)), "valid_from timestamp_ntz, text string")
    assert robots.read_versions(table) == versions
    boosted = pipeline.detect(rows, config, versions=versions).orderBy("request_id").collect()
    assert boosted[2].threat.matched_pattern == "AhrefsBot + robots.txt disallow: /a" and boosted[3].threat.matched_pattern == "AhrefsBot"
    assert [r.rule for r in robots.broken_rules(detectors.judge_agents(rows, config), [], config).collect()] == [None] * 14
