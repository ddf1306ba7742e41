"""Every registered query of the library's own against its SQL in DuckDB, on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from polymodal import queries as own

SF = "/root/testdata/sf0.001"
QUERIES, SQL = own.queries(), own.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


@pytest.mark.parametrize("name", [k for k in QUERIES if k in SQL])
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    order = [rel.columns.index(c) for c in cols]
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["full_text_top_k", "hybrid_search"])
def test_text_search_gives_ranked_rows(spark, name):
    rows = QUERIES[name](spark, SF).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
