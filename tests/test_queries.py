"""Every registered query with SQL against DuckDB on the smallest tables; the others must run."""

import math

import duckdb
import numpy as np
import pytest

from fieldspark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
MAY_BE_EMPTY = {"jns8_ellipsoid_pairs"}  # no ellipses touch in the smallest tables



def rows_of(df):
    df = df[sorted(df.columns)]
    clean = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 7) + 0.0 if isinstance(x, (float, np.floating)) else x
    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, duck, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    n = registry.QUERIES[name](spark, sf).count()
    assert n > 0 or name in MAY_BE_EMPTY
