"""Byte-level BPE against the library."""

import base64
import hashlib
import os
import random
import struct

import pytest

PUBLIC = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.01")
RANKS = "byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PUBLIC.path(RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=PUBLIC.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_given_table(spark, library):
    import __spark_entry__

    rows = __spark_entry__.queries()["op11_rank_queue_bpe"](spark, SF).collect()
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {d: digests(library, t) for d, t in given.items()}
    assert len(rows) == len(given)


def odd_texts():
    rnd = random.Random(1)
    letters = lambda n, of: "".join(rnd.choice(of) for _ in range(n))
    texts = [None, "", " ", "\n\n  x", "a" * 5000, "ab" * 3000, "aab" * 999, letters(20_000, "abcde"), letters(50_000, "etaoinshrdlu"), "é" * 2000, "数据" * 500, " " * 3000, "=-" * 4000]
    texts += ["<|endoftext|> stays", "it's we've I'LL 're' 'x", "　x\x85y z", "á‍👩‍👩‍👧", "0٣½Ⅷ"]
    pieces = ["a", "'s", "'", " ", "  ", "\n", "1", "é", "数", "!", "re", "ve", "'ll", " ", "٣", "́", "😀", "x", "\t"]
    return texts + ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 60))) for _ in range(300)]


def test_odd_texts(spark, library):
    """Long pre-tokens, null and empty texts, special strings, null and equal ids, clashing names; ids as arrays and back."""
    from palisade.llm.byte_pairs import decode_ids, encode_texts, round_trip
    from palisade.session import ship

    ship(spark)
    texts = odd_texts()
    table = spark.createDataFrame([(None if i < 3 else i // 2, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, ids string, row int").repartition(3)
    rows = encode_texts(table, RANKS, carry=("row",))
    assert {r.row: r.ids for r in rows.collect()} == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = decode_ids(rows.drop("doc_id").withColumnRenamed("row", "doc_id"), RANKS).collect()
    assert {r.doc_id: bytes(r.data).decode() for r in back} == {i: t or "" for i, t in enumerate(texts)}
    ends = round_trip(table, RANKS).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in ends) == sorted((-1 if i < 3 else i // 2, *digests(library, t)) for i, t in enumerate(texts))
    assert round_trip(table.where("false"), RANKS).collect() == []


def test_every_code_point(library):
    import pyarrow as pa

    from palisade.llm.byte_pairs import coder

    chars = [chr(k) for k in range(0, 0x110000, 7) if not 0xD800 <= k < 0xE000]
    texts = [f"a{x}1{x}{x}!{x} " for x in chars]
    ids, edges = coder(RANKS).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])] == library.encode_ordinary_batch(texts)


def test_table_and_collisions(library, monkeypatch):
    """A table that is full begins anew; pre-tokens that share a hash are told apart; bytes that are no UTF-8 pass."""
    import numpy as np
    import pyarrow as pa

    from palisade.llm import byte_pairs

    coder = byte_pairs.BytePairs(PUBLIC.path(RANKS))
    texts = [t or "" for t in odd_texts()]
    want = library.encode_ordinary_batch(texts)
    monkeypatch.setattr(byte_pairs, "TABLE_ROWS", 50)
    for at in (0, 100, 0):
        ids, edges = coder.encode(pa.array(texts[at : at + 100]))
        assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])] == want[at : at + 100]
    monkeypatch.setattr(byte_pairs, "hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    ids, edges = byte_pairs.BytePairs(PUBLIC.path(RANKS)).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])] == want
    broken = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, 3], np.int32).tobytes()), pa.py_buffer(b"a\xffb")])
    ids, _ = coder.encode(broken)
    assert ids.tolist() == library.encode_ordinary("a�b")


def test_lower_rank_first():
    """A merge that makes a pair of lower rank: that one goes before the rest of the bucket."""
    from palisade.llm.byte_pairs import BytePairs, RankQueue

    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"bca"]
    ranks = {t: i for i, t in enumerate(tokens)}

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".tiktoken") as f:
        f.write("".join(f"{base64.b64encode(t).decode()} {i}\n" for t, i in ranks.items()))
        f.flush()
        coder = BytePairs(f.name)
    rnd = random.Random(9)
    pieces = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(2, 40))).encode() for _ in range(200)]
    ids, counts = coder._whole_or_merged(pieces)
    assert ids.tolist() == [i for p in pieces for i in ([ranks[p]] if p in ranks else plain(p))] and counts.sum() == len(ids)
    queue = RankQueue(50_000)
    queue.push(49_999, [3, 1])
    queue.push(64, [2])
    queue.push(4096, [5])
    assert [queue.pop() for _ in range(4)] == [(64, [2]), (4096, [5]), (49_999, [1, 3]), None]
