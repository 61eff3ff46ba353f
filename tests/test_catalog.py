"""Every registered query against its SQL, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from tidemark import catalog, catalog_expr, catalog_pixels, catalog_plans, catalog_streams  # noqa: F401  they add queries

SF = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    if name not in catalog.ORACLES:
        assert rows
        return
    want = sql.sql(catalog.ORACLES[name])
    names = list(want.columns)
    assert sorted(names) == columns
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
