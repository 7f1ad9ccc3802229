"""Perplexity bands: copies, random texts, and held-out scores against a plain model."""

import math
import random
import string
from collections import Counter

import pytest


SCHEMA = "doc_id long, text string, lang string"


def clean_texts(n, seed=5):
    rnd = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    vocabulary = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 5))) for _ in range(1500)]
    return [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(60, 300))) for _ in range(n)]


def random_texts(n=20, seed=6):
    rnd = random.Random(seed)
    words = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(4, 12))) for _ in range(200))
    printable = [c for c in string.printable if c not in string.whitespace]
    return [f() for f in (lambda: words(string.ascii_letters + string.digits), lambda: words(string.ascii_lowercase), lambda: words(printable)) for _ in range(n)]


def judge(spark, texts):
    from palisade.llm.quality import quality
    from palisade.session import ship

    ship(spark)
    table = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in quality(table, plain=False).collect()}


def test_copies_leave_the_verdicts(spark):
    clean = clean_texts(200)
    alone, among = judge(spark, clean), judge(spark, clean + [clean[7]] * 100)
    assert sum(r.kept for r in alone.values()) >= 190
    assert [among[i].kept for i in range(200)] == [alone[i].kept for i in range(200)]
    assert {among[i].kept for i in range(200, 300)} == {alone[7].kept}


@pytest.mark.parametrize("n", [200, 1200])
def test_random_texts_go(spark, n):
    clean, noise = clean_texts(n), random_texts()
    rows = judge(spark, clean + noise)
    assert sum(rows[i].kept for i in range(n)) >= 0.95 * n
    assert not [i for i in range(n, n + len(noise)) if rows[i].kept]


def held_out(texts, folds, order=5):
    """Mean negative log probability of each text under interpolated modified Kneser-Ney of the other fold's distinct texts."""
    stream = lambda t: " ".join(t.split(" ")).encode()
    models = {}
    for fold in (0, 1):
        levels = [Counter(s[i : i + order] for s in {stream(t) for t, f in zip(texts, folds) if f == fold} for i in range(len(s) - order + 1))]
        for _ in range(order - 1):
            levels.append(Counter(g[1:] for g in levels[-1]))
        made = []
        for level in reversed(levels):
            n = [max(1, sum(c == i for c in level.values())) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            cut = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.1), i - 0.1) for i in (1, 2, 3)]
            total, freed = Counter(), Counter()
            for g, c in level.items():
                total[g[:-1]] += c
                freed[g[:-1]] += min(cut[min(c, 3) - 1], c)
            made.append((level, cut, total, freed))
        models[fold] = made

    def p(g, made):
        if not g:
            return 1 / 256
        level, cut, total, freed = made[len(g) - 1]
        below = p(g[1:], made)
        c = level[g]
        if not total[g[:-1]]:
            return below
        return (c - (min(cut[min(c, 3) - 1], c) if c else 0) + freed[g[:-1]] * below) / total[g[:-1]]

    out = []
    for t, f in zip(texts, folds):
        s = stream(t)
        found = [math.log(p(s[i : i + order], models[1 - f])) for i in range(len(s) - order + 1)]
        out.append(-sum(found) / len(found) if found else None)
    return out


def test_held_out(spark):
    texts = clean_texts(12) + random_texts(1) + ["four", "fiver"]
    texts += [texts[3]] * 4
    rows = judge(spark, texts)
    folds = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").selectExpr("i", "CAST(pmod(xxhash64(t), 2) AS INT) AS f").orderBy("i").select("f").collect()]
    assert set(folds) == {0, 1}
    for i, want in enumerate(held_out(texts, folds)):
        assert rows[i].held_out == (pytest.approx(want, rel=1e-5) if want is not None else None)
