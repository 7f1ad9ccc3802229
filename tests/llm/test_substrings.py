"""op8 against its plain version: every route a window can take, and rows that are out of the ordinary."""

import hashlib
import random

import brute
import pytest

SCHEMA = "doc_id long, text string, value string, words string, dk long, copy int"


def plain(rows):
    """(doc_id, n_words, n_removed, kept_sha256) of each row, repeated rows as often as they are there."""
    from palisade.llm.substring_dedup import WINDOW

    seen, out = set(), {}
    for key in sorted({(d is not None, d or 0, t or "") for d, t in rows}):
        words = brute.WORD.findall(key[2])
        gone = set()
        for i in range(len(words) - WINDOW + 1):
            window = tuple(words[i : i + WINDOW])
            if window in seen:
                gone.update(range(i, i + WINDOW))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[key] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return sorted(((d, *out[d is not None, d or 0, t or ""]) for d, t in rows), key=str)


def sample(seed):
    rnd = random.Random(seed)
    word = lambda n=300: f"w{rnd.randrange(n)}"
    prose = lambda n: [word() for _ in range(n)]
    passages = [prose(rnd.choice([20, 25, 60])) for _ in range(4)]
    rows = [(None, None), (None, "a b"), (7, ""), (8, " \n "), (9, " ".join(["again and again"] * 60)), (10, " ".join(["x"] * 50))]
    for i in range(60):
        words = prose(rnd.randrange(0, 40))
        for p in rnd.sample(passages, rnd.randrange(3)):
            words += p[: rnd.choice([len(p), 19, 20])] + prose(rnd.randrange(4))
        rows.append((rnd.choice([None, i, i, i, 100 - i]) if i % 10 == 0 else i + 200, ("\t" if i % 3 else "  ").join(words)))
    rows += [(500 - i, rows[20 + i % 2][1]) for i in range(6)]  # copies, the earliest not first in the table
    rows += [rows[30]] * 3  # whole rows repeated
    return rows


@pytest.mark.parametrize("shard", [1000, 3, 1])
def test_every_route(spark, shard):
    from palisade.llm.substring_dedup import substring_dedup
    from palisade.session import ship

    ship(spark)
    rows = sample(shard)
    ids = [d for d, _ in rows if d is not None]
    one_text = [r for r in rows if ids.count(r[0]) == 1 or r[0] is None and r[1] in (None, "a b") or rows.count(r) > 1]
    table = spark.createDataFrame([(d, t, "v", "w", 1, 0) for d, t in one_text], SCHEMA)  # columns named like the operator's own
    got = substring_dedup(table, shard=shard, with_text=True).collect()
    assert sorted(map(tuple, got), key=str) == [(d, n, r, s, k) for d, n, r, s, k in plain(one_text)]
    assert any(r.n_removed not in (0, r.n_words) for r in got)


def test_ids_that_repeat(spark):
    """Rows with one doc_id (or none) and different texts have an order of their own; a window stays once."""
    from palisade.llm.substring_dedup import substring_dedup

    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None, f"one {passage}"), (None, f"two {passage}"), (4, f"three {passage}"), (4, f"{passage} four"), (4, f"{passage} four")]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    holders = [r for r in got if "p0 p1" in r.kept]
    assert len(got) == 5 and len(holders) == 1 and holders[0].doc_id is None
    assert sorted(r.n_removed for r in got) == [0, 30, 30, 30, 30]


def test_frequent_passage(spark, monkeypatch):
    """A passage in every document comes to rows for its different runs, not for each document and window."""
    from palisade.llm import substring_dedup as module
    from palisade.session import ship

    ship(spark)
    rnd = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(300 - i, f"{'a' + str(rnd.randrange(4))} {passage} {'z' + str(rnd.randrange(4))}" + f" own{i}" * (i % 3)) for i in range(300)]
    made, real = [], module.named_windows

    def counted(*given):
        out = real(*given)
        made.append(out.count())
        return out

    monkeypatch.setattr(module, "named_windows", counted)
    for shard in (40, 2):
        got = module.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shard=shard, with_text=True).collect()
        assert sorted(map(tuple, got), key=str) == plain(rows)
    assert max(made) < 1000, made  # 9,523 when each document had a row for each window


def test_empty_table(spark):
    from palisade.llm.substring_dedup import substring_dedup

    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_automaton():
    """Matching statistics against a search for every stretch."""
    from palisade.llm.substring_dedup import SuffixAutomaton

    rnd = random.Random(5)
    for _ in range(200):
        held, automaton = [], SuffixAutomaton()
        for _ in range(rnd.randrange(1, 6)):
            words = [rnd.choice("abc") for _ in range(rnd.randrange(12))]
            found = automaton.statistics(words)
            want = [max(n for n in range(i + 2) if not n or any("".join(words[i + 1 - n : i + 1]) in h for h in held)) for i in range(len(words))]
            assert found == want
            automaton.add(words)
            held.append("".join(words))
