"""Every registered query of the engine against its SQL."""

import glob
import os

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("ENGINE_SF_DIR", "/root/testdata/sf0.001")


def _engine() -> list[str]:
    from palisade.plans import queries

    return sorted(queries.queries())


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else None if v is None else str(v)
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", _engine())
def test_query(spark, sql, name):
    found = __spark_entry__.queries()[name](spark, SF)
    want = sql.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert _rows(found.columns, found.collect()) == _rows(columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
