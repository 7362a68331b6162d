"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from rasterlane.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SQL = registry.oracle_sql()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 9) + 0.0
    return str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    cur = db.execute(SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert len(cur.description) == len(cols)
    assert mine == sorted(repr([plain(r[i]) for i in at]) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["user_id", "from", "to"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
