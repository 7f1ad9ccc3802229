"""Every opN query against its plain version on a small table, or on $LLM_SF_DIR."""

import hashlib
import os
import struct
import sys
from collections import Counter, defaultdict

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

PUBLIC = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sample_rows():
    """Copies, near copies, shared passages, licences, repeats, odd characters, nulls and one long text."""
    import random

    rnd = random.Random(7)
    vocabulary = [f"w{rnd.randrange(10**6)}" for _ in range(400)] + ["The", "café", "naïve", "数据", "Straße", "İstanbul", "x_y", "#tag", "a&b"]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    texts = [None, "", " \t\n", "one", "three small words", "　wide　space\x85next", "<|endoftext|> <s> </s> [CLS] stays", "A" * 5000]
    texts += [prose(rnd.randrange(5, 200)) for _ in range(40)]
    texts += [texts[10]] * 4
    for _ in range(4):  # near copies: one word of a long text changed
        words = prose(120).split()
        for _ in range(4):
            copy = list(words)
            copy[rnd.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy).upper() if rnd.random() < 0.3 else " ".join(copy))
    passage = prose(60)
    texts += [f"{prose(30)} {passage} {prose(10)}" for _ in range(5)] + [f"{passage} {passage}"]
    texts += ["Released under the MIT License. See Apache-License 2.0, CC BY and the GNU General Public License; mit license", "mit\n\nlicense mitlicense cc-by"]
    texts += ["\n".join(["same line here"] * 30), prose(8) + " " + " ".join(["again and again"] * 20), prose(9000)]
    sources = ["web", "code", "books", None, "Web", "ß"]
    return [(i * 3 + 1, t, rnd.choice(["en", "de", None]), sources[0] if i % 3 else sources[i % 6], 0) for i, t in enumerate(texts)]


PAGES = [
    (1, "http://a.example/1", "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
     "<article><h1>First story</h1><p>Tom &amp; Jerry  went\n home &#233;arly.</p><p>They slept well all through the long night.</p></article><script>x()</script><footer>Copyright</footer></body></html>"),
    (2, "http://a.example/2", None),
    (3, "http://a.example/3", ""),
    (4, None, "no markup at all"),
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    given = os.environ.get("LLM_SF_DIR")
    if given:
        return given
    top = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(sample_rows(), SCHEMA).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    return top


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]


def run(spark, sf, start):
    import __spark_entry__

    query = next(f for name, f in __spark_entry__.queries().items() if name.startswith(start + "_"))
    return query(spark, sf).collect()


def test_op1(spark, sf, docs):
    rows = run(spark, sf, "op1")
    text = {d: t for d, t, _ in docs}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, brute.crc(data))
        assert r.law == "key" and 0 <= r.shard <= 7 and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    if len(rows) >= 500:
        assert 0 < sum(r.grown_shard == 8 for r in rows) < len(rows) / 4


def test_op2(spark, sf, docs):
    want = brute.near([(d, t) for d, t, _ in docs])
    rows = run(spark, sf, "op2")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and len(rows) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_op3(spark, sf):
    got = {r.page_id: r for r in run(spark, sf, "op3")}
    assert all(r.n_chars == len(r.text) for r in got.values())
    if "LLM_SF_DIR" not in os.environ:
        assert got[1].text == "First story\nTom & Jerry went home éarly.\nThey slept well all through the long night."
        assert got[2].text == got[3].text == ""
        assert got[4].url is None and got[4].text == "no markup at all"


def test_op4(spark, sf, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PUBLIC.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    want = {d: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in docs}
    rows = run(spark, sf, "op4")
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want and len(rows) == len(docs)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)


def test_op5(spark, sf, docs):
    rows = run(spark, sf, "op5")
    size = {d: len(brute.WORD.findall(t or "")) for d, t, _ in docs}
    source = {d: s for d, _, s in docs}
    totals = Counter()
    for d, n in size.items():
        totals[source[d]] += n
    target = brute.targets(totals)
    taken, largest = Counter(), defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], totals[s])
        assert r.target == pytest.approx(target[s], rel=1e-9)
        assert r.taken in (0, size[r.doc_id], 2 * size[r.doc_id])
        taken[s] += r.taken
        largest[s] = max(largest[s], size[r.doc_id])
    for s in totals:
        assert abs(taken[s] - target[s]) <= 2 * largest[s] + 0.05 * target[s]
    assert sorted(map(tuple, run(spark, sf, "op5"))) == sorted(map(tuple, rows))


def test_op6(spark, sf, docs):
    rows = run(spark, sf, "op6")
    want = {d: brute.base_quality(t) for d, t, _ in docs}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows} == want
    assert not any(r.base_failed and r.kept for r in rows) and any(r.kept for r in rows)


def test_perplexity(spark, sf, docs):
    from palisade.llm.quality import quality
    from palisade.session import ship

    ship(spark)
    want = dict(zip([d for d, _, _ in docs], brute.perplexities([t for _, t, _ in docs])))
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for shard_grams in (10**6, 1500):  # one shard, and many
        got = {r.doc_id: r.log_perplexity for r in quality(table, shard_grams=shard_grams).collect()}
        assert got.keys() == want.keys()
        assert all(got[d] == pytest.approx(want[d], rel=1e-5) if want[d] is not None else got[d] is None for d in want)


def test_op7(spark, sf, docs):
    rows = run(spark, sf, "op7")
    want = {d: brute.base_licenses(t) for d, t, _ in docs}
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == want
    for r in rows:
        labels = [x for x in r.labels.split(",") if x]
        assert labels == sorted(set(labels)) and set(filter(None, r.base_labels.split(","))) <= set(labels)
        assert 0 <= r.score <= 1


def test_op8(spark, sf, docs):
    want = brute.substrings([(d, t) for d, t, _ in docs])
    rows = run(spark, sf, "op8")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want and len(rows) == len(docs)


def test_op9(spark, sf, docs):
    groups = defaultdict(list)
    for d, t, _ in docs:
        groups[t or ""].append(d)
    want = {(d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}
    rows = run(spark, sf, "op9")
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == want and len(rows) == len(docs)


def test_op10(spark, sf, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PUBLIC.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t, _ in docs}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in run(spark, sf, "op10"):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length > 0
        assert r.ids_crc32 == brute.crc(struct.pack(f"<{len(part)}I", *part))
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for held, total in ((pieces, {d: len(x) for d, x in ids.items()}), (windows, None)):
        for key, spans in held.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at == total[key] if total else at <= 4096
    assert set(pieces) == set(ids)
    used = sum(map(len, ids.values()))
    assert len(windows) <= -(-used // 4096) + max(1, used // 4096 // 20)
