"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from larkfield.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in registry.oracle_sql():  # its rules have tests of their own against plain Python
        assert got and len(columns) > 1
        again = registry.queries()[name](spark, SF)
        assert got == sorted(repr(tuple(plain(r[c]) for c in columns)) for r in again.collect())
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in rows.fetchall())
