"""Near dedup whatever the size of its blocks, and how many pairs its bands and sketches find."""

import random

import brute
import pytest


def table_rows():
    """Clusters around many texts, chains, and members that hang together without their bucket's lead."""
    rnd = random.Random(21)
    word = lambda: f"w{rnd.randrange(3000)}"
    texts = []
    for _ in range(6):
        base = [word() for _ in range(150)]
        texts += [" ".join(base)] * 3
        for _ in range(25):
            words = list(base)
            for _ in range(rnd.randrange(1, 6)):
                words[rnd.randrange(len(words))] = word()
            texts.append(" ".join(words))
        drift = list(base)
        for i in range(0, 60, 3):  # a chain: each like the one before, ends unlike
            drift[i] = word()
            texts.append(" ".join(drift))
    texts += [" ".join(word() for _ in range(rnd.randrange(0, 60))) for _ in range(40)] + [None, ""]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [2048, 7, 2])
def test_blocks(spark, block):
    from palisade.llm.near_dedup import near_duplicates
    from palisade.session import ship

    ship(spark)
    rows = table_rows()
    want = brute.near(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_pairs_found_at_the_threshold():
    """Of random pairs of sets at similarity 0.8 and 0.85, how many share a band and pass the sketch."""
    import numpy as np

    from palisade.llm.near_dedup import MARGIN
    from palisade.llm.shingles import BANDS, ROWS, SKETCH_BITS, bands, largest_xor, multipliers, odd_sketches

    rnd = np.random.default_rng(4)
    for percent in (80, 85):
        n, pairs = 200, 400
        common = round(percent / 100 * 2 * n / (1 + percent / 100))
        signatures = []
        for _ in range(pairs):
            pool = rnd.integers(1, 2**63, 2 * n - common, dtype=np.uint64)
            signatures += [[(s * a).min() for a in multipliers(BANDS * ROWS)] for s in (pool[:n], pool[n - common :])]
        signatures = np.array(signatures)
        keys = bands(signatures).reshape(pairs, 2, -1)
        sketch = odd_sketches(signatures).reshape(pairs, 2, -1)
        near = np.bitwise_count(sketch[:, 0] ^ sketch[:, 1]).sum(axis=1) <= largest_xor(percent / 100 - MARGIN, BANDS * ROWS, SKETCH_BITS)
        found = (keys[:, 0] == keys[:, 1]).any(axis=1) & near
        assert found.mean() >= 0.995
