"""Whitening against numpy over the whole table."""

import math
import os
import random

import numpy as np
import pytest

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.01")
SCHEMA = "vec_id long, embedding array<float>, n string, deviation string, size string"


def valid(vector):
    return vector is not None and all(c is not None and math.isfinite(c) for c in vector)


def expected(vectors):
    """Exact sums, covariance in long doubles."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    v = (centred.astype(np.longdouble).T @ centred.astype(np.longdouble) / n).astype(float)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    return n, deviation, centred @ axes[:, :8] / np.sqrt(e[:8]), e[:8] / np.trace(v)


def check(rows, vectors, ids):
    n, deviation, whitened, explained = expected(vectors)
    assert len(rows) == 8 * n
    got = {(r.vec_id, r.component): r for r in rows}
    for k in range(1, 9):
        mine = np.array([got[i, k].whitened for i in ids])
        want = whitened[:, k - 1]
        assert np.allclose(mine, want if mine @ want > 0 else -want, atol=1e-7), k
        assert all(got[i, k].explained == pytest.approx(explained[k - 1], rel=1e-9) and got[i, k].deviation == d for i, d in zip(ids, deviation))
    assert {r.n for r in rows} == {n}
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_given_table(spark):
    import __spark_entry__

    rows = __spark_entry__.queries()["op13_embedding_whitening"](spark, SF).collect()
    given = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if valid(r.embedding)]
    check(rows, [r.embedding for r in given], [r.vec_id for r in given])


def frame(spark, rows, parts=5):
    from palisade.session import ship

    ship(spark)
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(parts)


def test_odd_rows(spark):
    """Null vectors and entries, NaN, infinities, entries too large, other lengths, clashing names, far means: the rest is whitened."""
    from palisade.llm.whitening import whiten

    rnd = random.Random(5)
    good = [(i, [rnd.gauss(900 * (j % 3), 1 + j) for j in range(10)]) for i in range(300)]
    bad = [(900, None), (901, [None] * 10), (902, [1.0] * 9 + [None]), (903, [1.0] * 9 + [math.nan]), (904, [1.0] * 9 + [math.inf]), (905, [1e30] * 10)]
    other = [(910, [1.0, 2.0]), (911, [])]
    rows = whiten(frame(spark, good + bad + other)).collect()
    vectors = [[float(np.float32(c)) for c in v] for _, v in good]
    check([r for r in rows if r.vec_id < 900], vectors, [i for i, _ in good])
    rest = [r for r in rows if r.vec_id >= 900]
    assert sorted((r.vec_id, r.component) for r in rest) == [(i, k) for i in (910, 911) for k in range(1, 9)]
    assert all(r.whitened is None and r.deviation is None and r.n == 300 for r in rest)


def test_repeats_and_flat(spark):
    """Null and equal ids, repeated rows, and fewer directions than dimensions."""
    from palisade.llm.whitening import whiten

    rows = [(None, [1.0, 2.0, 5.0])] * 3 + [(4, [2.0, 4.0, 5.0])] * 2 + [(5, [2.0, 4.0, 5.0])]
    got = whiten(frame(spark, rows)).collect()
    assert len(got) == 18 and {r.component for r in got} == {1, 2, 3}
    assert all((r.whitened is None) == (r.component > 1) for r in got)
    assert {round(abs(r.whitened), 9) for r in got if r.component == 1} == {1.0}
    assert all(r.explained == pytest.approx(1) for r in got if r.component == 1) and got[0].identity_error < 1e-9
    one = whiten(frame(spark, rows[:1])).collect()
    assert [(r.whitened, r.deviation, r.explained) for r in one] == [(None, 0, None)] * 3


def test_empty(spark):
    from palisade.llm.whitening import whiten

    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, None)])).collect() == []


def test_large_deviation(spark):
    """A deviation beyond a long is null there and whole as a decimal."""
    from palisade.llm.whitening import whiten

    vectors = [[float(s * 2**40), 1.0] for s in (0, 1, 3)]
    rows = whiten(frame(spark, list(enumerate(vectors)))).collect()
    _, deviation, _, _ = expected(vectors)
    assert all(r.deviation is None and int(r.deviation_decimal) == deviation[r.vec_id] for r in rows)


def test_merging():
    """Moments of parts, merged, are those of the whole, far from zero too."""
    from palisade.llm.whitening import merged, moments

    x = np.random.default_rng(2).normal(1e6, [1, 2, 3], (1000, 3))
    have = moments(x[:7], [0])
    for a, b in ((7, 8), (8, 500), (500, 1000)):
        have = merged(have, moments(x[a:b], [0]))
    assert have[0] == 1000 and np.allclose(have[1], x.mean(0)) and np.allclose(have[2] / 1000, np.cov(x.T, bias=True), rtol=1e-9)
