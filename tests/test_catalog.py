"""Every registered query of the engine against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from storelens.plans import catalog

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, oracle, name):
    df = catalog.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    expected = oracle.sql(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert got == sorted(expected, key=repr)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
