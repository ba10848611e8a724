"""Every registered query of the reference's operators against its DuckDB equivalent, by column name and value."""

import duckdb
import pytest

from flintglass.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted((tuple(r) for r in found.select(*columns).collect()), key=repr)
    assert got
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})")
    assert sorted(want.columns) == columns
    assert got == sorted(want.fetchall(), key=repr)
