"""Every registered query with an oracle agrees with DuckDB on the small tables."""

import math

import duckdb
import pytest

from docloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CATALOGUE = plans.catalogue()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "as_integer_ratio") or hasattr(v, "is_finite"):
        v = float(v)
        return int(v) if v == int(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_matches_oracle(spark, sf, con, name):
    query, sql = CATALOGUE[name]
    df = query(spark, sf)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if sql is None:
        assert rows
        return
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
