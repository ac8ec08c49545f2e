"""Every registered query of the engine against the SQL that DuckDB runs over the same tables."""

import math

import duckdb
import pytest

from vacantia.queries import basics, boards, more, plans, registry, texts  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A month of few users: no day has enough sources.
EMPTY = {"j16_full_coverage_run"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    found = duck.execute(registry.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(([plain(v) for v in r] for r in found.fetchall()), key=repr)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    assert got == want
    assert got or name in EMPTY


def test_rows_only(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLE):
        assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_filters_reach_the_scan(spark):
    plan = basics.load(spark, FOLDER, "lineitem").filter("l_quantity > 45").select("l_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
