"""Every registered query with SQL gives the SQL's rows; the others give rows."""

import duckdb
import pytest

from leafmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.sql(sql)
    at = [[d[0] for d in result.description].index(c) for c in names]
    assert len(at) == len(result.description)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
