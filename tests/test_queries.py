"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from graphloom import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and pd.isna(v)):
            return "NULL"
        return f"{float(v):.6g}" if isinstance(v, float) and not float(v).is_integer() else str(int(v)) if isinstance(v, float) else str(v)

    df = df.astype(object)[sorted(df.columns)]
    return sorted(tuple(map(value, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, data, duck, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    if name in queries.ORACLES:
        want = duck.sql(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry_lists_all(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
