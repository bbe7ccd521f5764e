"""Every query with SQL against DuckDB on the same tables; every other query runs and has a stable schema."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def bag(rows):
    clean = [tuple("nan" if v != v else 0.0 if isinstance(v, float) and v == 0 else v for v in row) for row in rows]
    return sorted(clean, key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = bag([tuple(r) for r in df.select(*cols).collect()])
    if name not in ORACLES:
        assert rows
        return
    rel = duck.execute(ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    want = bag([tuple(row[names.index(c)] for c in cols) for row in rel.fetchall()])
    assert rows == want


def test_entry_point(spark):
    assert entry.entry(spark).columns
    assert set(ORACLES) <= set(QUERIES)
