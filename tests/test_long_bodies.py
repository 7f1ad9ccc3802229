"""Responses longer than a middleware reads: the queries search them whole."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__

#: Bytes before what is to be found: more than Config.max_response_length.
LONG = "word " * 10_001


def _check(spark, tmp_path, name):
    texts = [LONG + "ada@example.org and 4111111111111111", "ada@example.org " + LONG + "+1 555 123 4567", LONG, "short ada@example.org", None]
    table = pa.table({"doc_id": pa.array([25, 26, 30, 31, 36], pa.int64()), "text": pa.array(texts)})
    pq.write_table(table, tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    found = __spark_entry__.queries()[name](spark, str(tmp_path))
    want = want.fetchall()
    assert any(25 in row for row in want)
    assert sorted(map(str, found.select(*columns).collect())) == sorted(str(pyspark_row(columns, row)) for row in want)


def pyspark_row(columns, values):
    from pyspark.sql import Row

    return Row(**dict(zip(columns, values)))


@pytest.mark.parametrize("name", ["pii_redacted", "pii_scan"])
def test_long_bodies(spark, tmp_path, name):
    _check(spark, tmp_path, name)
