"""Every query with SQL against the same SQL in another engine, over the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from verdictframe.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def normal(df: pd.DataFrame) -> list[str]:
    rows = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        out = []
        for v in row:
            if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
                out.append("-")
            elif type(v).__name__ in ("bool", "bool_"):
                out.append(str(bool(v)))
            elif isinstance(v, (int, float)) or "int" in type(v).__name__ or "float" in type(v).__name__:
                out.append(repr(round(float(v), 6) + 0.0))
            else:
                out.append(str(v))
        rows.append("|".join(out))
    return sorted(rows)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in registry.TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf, duck):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_sql_has_no_query_of_its_own():
    assert set(SQL) <= set(QUERIES)
