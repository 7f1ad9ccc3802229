"""Rows out of the ordinary, for every operator: null and repeated ids, repeated rows, ties, null columns, clashing names, empty tables; and the methods' own promises."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import brute
import pytest

pytest.importorskip("public_tokenizers")
# Columns that bear the names the operators give their own.
CLASH = (
    "shard", "slot", "size", "component", "component_id", "kept", "n", "node", "value", "words", "digest", "keep_id", "group_size", "block", "q", "p", "u", "target", "start", "length", "row_index", "model",
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def odd_rows():
    rnd = random.Random(11)
    prose = lambda n: " ".join(f"w{rnd.randrange(200)}" for _ in range(n))
    long, passage = prose(3000), prose(40)
    rows = [
        (None, None, None, None), (None, "", "en", "a"), (None, prose(50), None, None), (3, None, "en", "b"), (3, "same id, other text " + prose(30), "en", "b"),
        (4, passage, "en", "a"), (4, passage, "en", "a"), (5, passage, None, "b"), (6, "\n\n \t", "de", "c"), (7, long, "de", "c"), (8, long + " end", "de", "c"),
        (9, "MIT License", "en", "a"), (10, "x" * 100_000, "en", "a"), (11, "é́\x00 odd   signs", "en", "ß"),
    ]
    rows += [(20 + i, prose(rnd.randrange(20, 60)), rnd.choice(["en", "de"]), rnd.choice("abc")) for i in range(30)]
    return [(*r, 0, *["clash"] * len(CLASH)) for r in rows]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    from palisade.session import ship

    ship(spark)
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def operators():
    from palisade.llm.exact_dedup import exact_dedup
    from palisade.llm.licenses import scan_licenses
    from palisade.llm.mixing import mix
    from palisade.llm.near_dedup import near_duplicates
    from palisade.llm.packing import pack
    from palisade.llm.quality import quality
    from palisade.llm.sharding import HashTree, shard_rows
    from palisade.llm.substring_dedup import substring_dedup
    from palisade.llm.token_transducer import count_tokens

    return {
        "sharding": lambda d: shard_rows(d, HashTree.of(8)), "near": near_duplicates, "tokens": lambda d: count_tokens(d, "byte_bpe_50k.json"), "mixing": mix,
        "quality": lambda d: quality(d, plain=False), "licenses": scan_licenses, "substrings": substring_dedup, "exact": exact_dedup, "packing": lambda d: pack(d, "word_bpe_49k.json"),
    }


@pytest.mark.parametrize("name", ["sharding", "near", "tokens", "mixing", "quality", "licenses", "substrings", "exact", "packing"])
def test_odd_rows(odd, empty, name):
    """One result for each row (pieces for packing), whatever the row; none for an empty table."""
    run = operators()[name]
    rows = run(odd).collect()
    ids = Counter(r[0] for r in odd_rows())
    if name == "packing":
        assert Counter(r.doc_id for r in rows if r.start == 0) == ids
    else:
        assert Counter(r.doc_id for r in rows) == ids
    assert run(empty).collect() == []


def test_exact_copies_of_odd_rows(odd):
    from palisade.llm.exact_dedup import exact_dedup

    groups = defaultdict(list)
    for d, t, *_ in odd_rows():
        groups[t or ""].append(d)
    for r in exact_dedup(odd).collect():
        mine = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.digest)
        known = [d for d in mine if d is not None]
        assert (r.group_size, r.keep_id, r.kept) == (len(mine), max(known, default=None), r.doc_id == max(known, default=None))


def test_index_of_two_batches(spark, tmp_path):
    """A text that an earlier batch brought keeps no row of this one; the index leaves nothing in the catalogue."""
    from palisade.llm.exact_dedup import DigestIndex, exact_dedup

    path, schema = str(tmp_path / "index"), "doc_id long, text string"
    first = exact_dedup(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], schema), path, buckets=3).collect()
    assert {r.doc_id: (r.keep_id, r.kept) for r in first} == {1: (2, False), 2: (2, True), 3: (3, True), 4: (4, True)}
    second = exact_dedup(spark.createDataFrame([(5, "b"), (6, "c"), (7, ""), (8, "c")], schema), path, buckets=3).collect()
    assert {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in second} == {5: (3, False, 1), 6: (8, False, 2), 7: (4, False, 1), 8: (8, True, 2)}
    index = DigestIndex(spark, path, 3)
    assert index.read().count() == 4
    plan = index.unseen(spark.createDataFrame([(9, "d")], schema))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    index.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_mixing_probabilities(spark, tmp_path):
    """Inclusion probabilities and ranks against a plain version: sizes differ, so do the odds, and the order of them decides."""
    from palisade.llm.mixing import PLACE, drawn, mix

    rnd = random.Random(2)
    sizes = {("a", i): rnd.choice([10, 20, 50, 400, 410, 3000]) for i in range(400)} | {("b", i): rnd.randrange(1, 2000) for i in range(400, 700)} | {(None, 900): 3}
    rows = [(i, " ".join(["x"] * n), s) for (s, i), n in sizes.items()]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    got = {(r.source, r.doc_id): r for r in mix(table, block_rows=50, weights=(1, 1, 1), budget=1.2).collect()}
    u = {r.doc_id: r[PLACE] for r in drawn(table, "doc_id").collect()}
    assert got.keys() == sizes.keys()
    for s in ("a", "b"):
        mine = {k: n for k, n in sizes.items() if k[0] == s}
        total, target = sum(mine.values()), got[next(iter(mine))].target
        whole = int(target // total)
        rest = target - whole * total
        low, high = 0.0, 10.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * min(1, mid * math.sqrt(n)) for n in mine.values()) < rest else (low, mid)
        for k, n in mine.items():
            assert got[k].inclusion == pytest.approx(min(1, low * math.sqrt(n)), rel=1e-6)
        assert len({round(got[k].inclusion, 9) for k in mine}) > 3
        rank = {k: u[k[1]] / (1 - u[k[1]]) * (1 - got[k].inclusion) / got[k].inclusion for k in mine}
        taken = {k for k in mine if got[k].copies > whole}
        # Everything ranked before the first document that did not fit is in.
        first_out = min(rank[k] for k in mine if k not in taken)
        before = sum(mine[k] for k in mine if rank[k] < first_out)
        assert before <= rest and all(k in taken for k in mine if rank[k] < first_out)
        assert rest - max(mine.values()) < sum(mine[k] for k in taken) <= rest + 1e-6
        # Not the order of u alone.
        by_u = sorted(mine, key=lambda k: u[k[1]])[: len(taken)]
        assert set(by_u) != taken


def test_weights_move_rows_only_where_they_change(spark):
    """Raising a shard's weight moves rows into its subtree alone, lowering it out of it alone; shares follow weights."""
    from palisade.llm.sharding import HashTree, Node, leaf
    from pyspark.sql import functions as F

    def tree(weight):
        rack = lambda k, w=1.0: Node(f"rack-{k}", (leaf(2 * k, w), leaf(2 * k + 1)))
        return HashTree((Node("east", (rack(0), rack(1, weight))), Node("west", (rack(2), rack(3)))))

    keys = spark.range(20_000).select(F.col("id"), *[tree(w).place(F.col("id")).alias(n) for n, w in (("plain", 1.0), ("more", 3.0), ("less", 0.25))])
    rows = keys.collect()
    raised, lowered = [r for r in rows if r.plain != r.more], [r for r in rows if r.plain != r.less]
    # Into shard 2 from anywhere; between the rack's and the region's other shards nothing moves.
    assert raised and all(r.more == 2 or r.plain // 4 != r.more // 4 and r.more // 4 == 0 or r.plain // 2 != r.more // 2 and r.more // 2 == 1 for r in raised)
    assert not any(r.plain >= 4 and r.more >= 4 for r in raised) and not any(r.plain < 2 and r.more < 2 for r in raised)
    assert lowered and not any(r.plain >= 4 and r.less >= 4 for r in lowered) and not any(r.plain == 3 and r.less == 3 for r in lowered)
    share = Counter(r.more for r in rows)
    for shard, weight in enumerate([1, 1, 3, 1, 1, 1, 1, 1]):
        assert abs(share[shard] / len(rows) - weight / 10) < 0.015


def test_best_fit(spark):
    """The segment tree against a search of all open windows."""
    import numpy as np

    from palisade.llm.packing import best_fit_decreasing

    rnd = random.Random(6)
    for window in (1, 7, 64, 100):
        lengths = sorted((rnd.randrange(1, window + 1) for _ in range(200)), reverse=True)
        sequence, offset = best_fit_decreasing(np.array(lengths), window)
        room = []
        for n, s, at in zip(lengths, sequence.tolist(), offset.tolist()):
            fits = [r for r in room if r >= n]
            if fits:
                assert room[s] == min(fits) and at == window - room[s]
                room[s] -= n
            else:
                assert s == len(room) and at == 0
                room.append(window - n)


def test_other_tokenizers(spark):
    """A tokenizer the fast path isn't made for goes through the library; one the transducer isn't made for is refused."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from palisade.llm.kernel import vocabulary
    from palisade.llm.packing import Encoder
    from palisade.llm.token_transducer import Merges

    texts = [t for _, t, *_ in odd_rows()]
    for name, fast in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        encoder, library = Encoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
        assert encoder.cuts == fast
        ids, offsets = encoder(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids
    with pytest.raises(ValueError):
        Merges(vocabulary("word_bpe_49k.json"))


def test_components_of_hubs_and_chains(spark):
    from palisade.llm.components import connected_components

    rnd = random.Random(8)
    links = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5000 + rnd.randrange(200), 5000 + rnd.randrange(200)) for _ in range(150)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_base_columns_of_odd_texts():
    import pyarrow as pa

    from palisade.llm.quality import base_columns

    texts = [t for _, t, *_ in odd_rows()]
    got = base_columns(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        n, chars, symbols, dup, rep, _ = brute.base_quality(t)
        assert [int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [n, chars, symbols, dup, rep]


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """200,000 rows of null id and one text, beside rows with ids, some of which repeat."""
    from palisade.session import ship
    from pyspark.sql import functions as F

    ship(spark)
    text = " ".join(f"w{i}" for i in range(12))
    path = str(tmp_path_factory.mktemp("copies") / "documents.parquet")
    hot = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit("a").alias("source"))
    rest = spark.range(3000).select((F.col("id") % 2000).alias("doc_id"), F.concat(F.lit(f"{text} n"), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source"))
    hot.unionByName(rest).repartition(8).write.parquet(path)
    return spark.read.parquet(path)


def test_copies_in_shards(copies):
    """Slots of each shard from 0 without gaps; of equal rows, each has one."""
    from palisade.llm.sharding import HashTree, shard_rows
    from pyspark.sql import functions as F

    rows = shard_rows(copies, HashTree.of(8)).persist()
    found = rows.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("d")).collect()
    assert sum(r.n for r in found) == 203_000 and all((r.a, r.b, r.d) == (0, r.n - 1, r.n) for r in found)
    assert {(r.doc_id, r["size"], r.text_crc32): r.n for r in rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")).collect()} == {
        (r.doc_id, r.s, r.c): r.n for r in copies.groupBy("doc_id", (F.octet_length("text").cast("long") + 1).alias("s"), F.crc32(F.col("text").cast("binary")).alias("c")).agg(F.count("*").alias("n")).collect()
    }
    assert max(len(p) for p in rows.rdd.glom().collect()) < 110_000
    rows.unpersist()


def test_copies_in_exact_dedup(copies):
    from palisade.llm.exact_dedup import exact_dedup
    from pyspark.sql import functions as F

    rows = exact_dedup(copies)
    # Rows of the hot text stay in the task that read them.
    assert max(len(p) for p in rows.rdd.glom().collect()) < 60_000
    told = rows.groupBy("group_size", F.col("keep_id").isNull().alias("null_id"), "kept").agg(F.count("*").alias("n")).collect()
    assert {tuple(r) for r in told} == {(200_000, True, True, 200_000), (1, False, True, 3000)}


def test_copies_in_mixing(copies, monkeypatch):
    """What is collected of a cut block has a bounded size, and the mix comes near its target."""
    from palisade.llm.mixing import mix
    from pyspark.sql import functions as F

    got = mix(copies, budget=1.5, cap=2, block_rows=1000)
    assert got.agg(F.sum("taken")).first()[0] == pytest.approx(1.5 * copies.agg(F.sum(F.regexp_count("text", F.lit("[^ ]+")))).first()[0], rel=1e-4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    taken = got.where("doc_id IS NULL").groupBy("copies").count().collect()
    assert {r.copies for r in taken} == {1, 2} and all(90_000 < r["count"] < 110_000 for r in taken)


def test_copies_in_packing(copies, monkeypatch):
    """Bins of equal rows are of bounded size."""
    from palisade.llm import packing
    from pyspark.sql import functions as F

    few = copies.where("doc_id IS NULL").limit(60_000)
    rows = packing.pack(few, "word_bpe_49k.json", bin_rows=5000)
    bins = rows.groupBy((F.col("sequence_id") % 12).alias("bin")).count().collect()
    assert len(bins) == 12 and max(r["count"] for r in bins) < 6000
    used = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert used.where("n > 4096 OR n <> end").count() == 0


def test_copies_in_near_dedup(copies, monkeypatch):
    """200,000 equal rows are one set in every group: they join no list of members."""
    from palisade.llm import near_dedup
    from pyspark.sql import functions as F

    rows = copies.where("doc_id IS NULL OR doc_id < 3")
    told = near_dedup.near_duplicates(rows).groupBy("doc_id", "n_shingles", "kept").agg(F.count("*").alias("n"), F.countDistinct("component").alias("c")).collect()
    assert sum(r.n for r in told) == rows.count() and [r.n for r in told if r.doc_id is None] == [200_000] and all(r.c == 1 for r in told)
    texts = rows.select("text", F.lit(1).cast("long").alias("node"), F.lit(8).cast("long").alias("n"), F.lit(b"").alias("sketch"))
    assert near_dedup.one_each(near_dedup.full_sets(texts, 5)).count() == 1
