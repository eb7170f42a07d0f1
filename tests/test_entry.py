import pytest

import __spark_entry__ as entry


def test_every_sql_has_its_query(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert entry.entry(spark).columns == ["snippet_id", "path", "kind", "hits"]


def test_queries_equal_duckdb(spark):
    import os

    import duckdb

    from driftloom.plans.queries import QUERIES, SQL

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables aren't here")
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    for name, sql in SQL.items():
        got, want = QUERIES[name](spark, sf), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        cols = sorted(got.columns)
        rows = sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect())))
        assert rows == sorted(map(repr, want.project(", ".join(f'"{c}"' for c in cols)).fetchall())), name
