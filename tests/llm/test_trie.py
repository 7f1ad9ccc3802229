"""The trie of conversations against a plain version, and its SQL."""

import glob
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import pytest

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.01")


def plain_paths(rows):
    """conv_id -> turns, rebuilt as op12 does."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn, role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x, key=lambda x: (x[0] is not None, x[0] or 0))] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def plain_nodes(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def found(nodes):
    return sorted((tuple(r[c] for c in COLUMNS) for r in nodes.collect()), key=repr)


def run(spark, path):
    import __spark_entry__

    return __spark_entry__.queries()["op12_conversation_trie"](spark, path)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(run(spark, SF)) == plain_nodes(plain_paths(rows))


def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__

    small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in glob.glob(f"{small}/conversations.parquet"):
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(__spark_entry__.oracle_sql()["op12_conversation_trie"])
    names = [d[0] for d in got.description]
    want = sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in got.fetchall()), key=repr)
    assert found(run(spark, small)) == want


@pytest.fixture()
def table(spark, tmp_path):
    def write(rows):
        path = str(tmp_path / f"t{len(rows)}")
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string, digest string, n_bytes string, place string").repartition(3).write.parquet(f"{path}/conversations.parquet")
        return path

    return write


def test_odd_rows(spark, table):
    """Nulls in every column, repeated rows, ids that are not dense, clashing names, ends of no turn, many equal conversations, one long one."""
    rnd = random.Random(3)
    rows = [(None, 0, "user", "nobody's"), (0, None, "user", "first"), (0, 0, None, None), (0, 0, None, None), (0, 1, "user", "same"), (7, 3, "", ""), (11, 0, "ab", "c"), (12, 0, "a", "bc"), (1000003, 0, "user", "é数")]
    for c in range(40, 140):
        for t in range(rnd.randrange(1, 12)):
            rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(["yes", "no", "more " * 200])))
    for c in range(2000, 2600):  # equal conversations
        rows += [(c, t, "user", f"turn {t}") for t in range(10)]
    rows += [(5000, t, "user", f"long {t % 7}") for t in range(400)]
    rows += [(5001, t, "user", f"long {t % 7}") for t in range(400)]
    path = table([(*r, "clash", "clash", "clash", "clash") for r in rows])
    got = found(run(spark, path))
    assert got == plain_nodes(plain_paths(rows))
    assert max(r[1] for r in got) >= 400


def test_runs_of_ids(spark, table, monkeypatch):
    """A node's ids are hashed run by run: many small runs give what one gives."""
    from palisade.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "RUN_BYTES", 16)
    rows = [(c, t, "user", "x") for c in range(0, 3000, 3) for t in range(9)]
    assert found(run(spark, table([(*r, None, None, None, None) for r in rows]))) == plain_nodes(plain_paths(rows))


def test_empty(spark, table):
    assert run(spark, table([])).collect() == []
