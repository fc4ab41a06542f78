import pytest

import __spark_entry__ as entry
from weftline.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def plain(df):
    def text(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, (list, bool, str)):
            return str(x)
        if x is None or x != x:
            return ""
        return f"{float(x):.6f}" if isinstance(x, (int, float)) else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(text, r)) for r in df.values.tolist())


@pytest.fixture(scope="module")
def sql(data):
    import duckdb

    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, data, sql, name):
    got, want = entry.queries()[name](spark, data).toPandas(), sql.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
