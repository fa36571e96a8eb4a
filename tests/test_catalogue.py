"""Every registered query of the reference's operators against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from quern.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{SF}/{file}')")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    result = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert columns == sorted(names)
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())


def test_only_one_query_is_beyond_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"circuit_breaker"}


def test_entry_stands_without_the_optional_parts():
    import __spark_entry__ as e

    assert "rrf_fusion" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
