"""The driver contract on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from carrel import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SMALL)
    shown = lambda row: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)
    got = sorted(shown(r) for r in df.select(*sorted(df.columns)).collect())
    if name in registry.SQL:
        r = con.execute(registry.SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == sorted(df.columns)
        assert got == sorted(shown(row[names.index(c)] for c in sorted(names)) for row in r.fetchall())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).count() == 5
