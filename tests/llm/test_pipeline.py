"""The pipeline's stages against plain versions on small tables."""

import math
import os
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
import test_quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, tmp_path, rows):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(d, t, lang, source, len(t or "")) for d, t, lang, source in rows], SCHEMA).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_near_dedup(spark, tmp_path):
    rnd = random.Random(11)
    rows = []
    for i in range(12):  # pairs at 0.76 to 0.95, one word changed in the middle or at the end
        words = [f"w{rnd.randrange(10**6)}" for _ in range(40 + 6 * i)]
        copy = [*words]
        copy[len(copy) // 2] = "changed"
        rows += [(10 * i, " ".join(words), "en", "web"), (10 * i + 1, " ".join(copy), "en", "web")]
    rows += [(None, "no such text anywhere else in it", "en", "web"), (500, "", "en", "web"), (501, None, "en", "web"), (502, rows[0][1], "en", "web")]
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    similar = []
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                j_ij = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if j_ij >= 0.8:
                    similar.append(j_ij)
                    group = [group[j] if g == group[i] else g for g in group]
    assert any(0.8 <= x < 0.85 for x in similar)
    want = []
    for i, r in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if group[k] == group[i]]
        if not sets[i] or r[0] == min((x for x in ids if x is not None), default=None):
            want.append((r[0], r[1]))
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, table(spark, tmp_path, rows), "").collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(got, key=key) == sorted(want, key=key)


def key(row):
    return tuple((x is not None, x) for x in row)


def test_quality_stage(spark, tmp_path):
    from palisade.llm.quality import LEAST_DEVIATION, LOWER_WIDTH, NOISE_BYTES, STEP, UPPER_WIDTH

    texts = test_quality.clean_texts(60) + test_quality.random_texts(2) + ["too short", "again and again " * 40, "", None]
    rows = [(i, t, "de" if i % 3 == 0 else None if i % 7 == 0 else "en", "web") for i, t in enumerate(texts)]
    rows += [rows[4]] * 20 + [(None, texts[5], "en", "web")]
    plain = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "i int, t string")
    folds = [r.f for r in plain.selectExpr("i", "CAST(pmod(xxhash64(t), 2) AS INT) AS f").orderBy("i").collect()]
    scores = test_quality.held_out([" ".join((r[1] or "").split(" ")) for r in rows], folds)
    failed = [brute.base_quality(r[1])[-1] for r in rows]
    steps = defaultdict(dict)
    for r, score, bad in zip(rows, scores, failed):
        if not bad and score is not None:
            steps[r[2]][r[1]] = round(score / STEP)
    want = []
    for r, score, bad in zip(rows, scores, failed):
        if bad:
            continue
        low, middle, high = (float(x) * STEP for x in np.percentile(list(steps[r[2]].values()), [25, 50, 75]))
        n = len((r[1] or "").encode()) - 4
        noise = max((high - low) / 1.349, LEAST_DEVIATION) * math.sqrt(1 + NOISE_BYTES / max(n, 1))
        if middle - LOWER_WIDTH * noise <= score <= middle + UPPER_WIDTH * noise:
            want.append(r)
    got = [(r.doc_id, r.text, r.lang, r.source) for r in corpus_pipeline.keep_quality(spark, table(spark, tmp_path, rows), "").collect()]
    assert 60 <= len(got) < len(rows) and sorted(got, key=key) == sorted(want, key=key)


def test_exact_dedup_stage(spark, tmp_path):
    rows = [(1, "a", "en", "web"), (5, "a", "de", None), (5, "a", "en", "x"), (2, "A", "en", "web"), (None, "n", "en", "web"), (None, "n", "en", "web"), (7, None, "en", "web"), (8, "", "en", "web")]
    got = corpus_pipeline.drop_copies(spark, table(spark, tmp_path, rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted([(5, "a"), (2, "A"), (None, "n"), (8, "")], key=key)


def test_mixing_stage(spark, tmp_path):
    from palisade.llm.mixing import PLACE, drawn

    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.randrange(0, 90)), "en", rnd.choice(["a", "b", "c", "c", "c", None])) for i in range(150)] + [(200, None, "en", "a")]
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    totals = Counter()
    for r in rows:
        totals[r[3]] += size[r[0]]
    target = brute.targets(totals)
    docs = table(spark, tmp_path, rows)
    draw = {r.doc_id: r[PLACE] for r in drawn(docs, "doc_id").collect()}
    assert len(set(draw.values())) == len(rows)
    want = Counter()
    for source, total in totals.items():
        mine = [r[0] for r in rows if r[3] == source]
        whole = math.floor(target[source] / total)
        rest = room = target[source] - whole * total
        if room > 0:
            # Inclusion grows with the root of the size; documents rank by their odds over its odds, and those that fit are in.
            low, high = 0.0, 10.0
            for _ in range(200):
                level = (low + high) / 2
                low, high = (level, high) if sum(size[d] * min(1, level * math.sqrt(size[d])) for d in mine) < rest else (low, level)
            rank = {}
            for d in mine:
                u = draw[d]
                p = min(1, low * math.sqrt(size[d])) if size[d] else rest / total
                rank[d] = u / (1 - u) * (1 - p) / p
            for d in sorted(mine, key=rank.get):
                if size[d] <= room:
                    room -= size[d]
                    want[d] += 1
        for d in mine:
            want[d] += whole
    got = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert got == +want


def test_packing_stage(spark, tmp_path):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    rows = [(i, t, "en", "web") for i, t in enumerate([*test_quality.clean_texts(40), " ".join(test_quality.clean_texts(60, 9)), "", None])]
    total = {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.pack_rows(spark, table(spark, tmp_path, rows), "").collect():
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    end = lambda spans: [sum(n for _, n in sorted(spans)[:i]) for i in range(len(spans))] == [a for a, _ in sorted(spans)] and sum(n for _, n in spans)
    assert {d: end(spans) for d, spans in pieces.items()} == total
    assert all(end(spans) and end(spans) <= 4096 for spans in windows.values())


def odd_rows():
    """Rows out of the ordinary, with extra columns that bear the names the operators give their own."""
    rnd = random.Random(12)
    prose = lambda n: " ".join(f"w{rnd.randrange(400)}" for _ in range(n))
    long, passage = prose(2500), prose(60)
    rows = [(None, None, None, None), (None, "", "en", "a"), (None, prose(50), None, None), (3, None, "en", "b"), (3, "same id " + prose(30), "en", "b"), (4, passage, "en", "a")]
    rows += [(4, passage, "en", "a"), (5, passage, None, "b"), (6, "\n \t", "de", "c"), (7, long, "de", "c"), (8, long + " end", "de", "c"), (9, "short", "en", "a")]
    rows += [(20 + i, prose(rnd.randrange(25, 60)), rnd.choice(["en", "de", None]), rnd.choice("abc")) for i in range(40)]
    return [(*r, 0, i, "x", "y", 1.5) for i, r in enumerate(rows)]


ODD = SCHEMA + ", row_index int, kept string, component string, copies double"


def test_stages_in_a_row(spark, tmp_path):
    from palisade.session import materialise

    spark.createDataFrame(odd_rows(), ODD).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    first = docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == first.columns, name
        before, after = Counter(map(tuple, docs.collect())), Counter(map(tuple, out.collect()))
        assert after and set(after) <= set(before), name
        assert name == "mixing" or all(after[r] <= before[r] for r in after), name
        sizes.append(sum(after.values()))
        docs = out
    assert sizes[0] < len(odd_rows()) and sizes[1] < sizes[0] and sizes[2] < sizes[1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in docs.collect())
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], ODD).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
