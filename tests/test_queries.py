"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, (list, np.ndarray)):
        return repr([value(x) for x in v])
    if pd.isna(v):
        return "None"
    if isinstance(v, (float, np.floating)):
        return repr(int(v)) if v == int(v) else repr(round(float(v), 6))
    return repr(v.item() if hasattr(v, "item") else v)


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(value, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, data, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
