"""Every query with SQL against DuckDB at the smallest scale; the others must run."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PARTS = [p for p in __spark_entry__._parts() if p.__name__.startswith("sightline.plans")]
QUERIES = {k: f for p in PARTS for k, f in p.QUERIES.items()}
ORACLES = {k: q for p in PARTS for k, q in p.ORACLES.items()}


def rows(df: pd.DataFrame) -> list[tuple]:
    text = lambda x: "NULL" if x is None or x is pd.NA or x != x else repr(round(x, 5) + 0.0) if isinstance(x, float) else str(x)
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, spark, duck):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark):
    """A query without SQL gives rows, and the same ones again."""
    first, again = (QUERIES[name](spark, SF).toPandas() for _ in range(2))
    assert len(first) and rows(first) == rows(again)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
