"""Every registered query of the engine against DuckDB over the same files."""

import math
import os

import pandas as pd
import pytest

from lamina import catalogue

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, float):
        return f"{v:.6g}"
    return f"{int(v)}" if hasattr(v, "__index__") else str(v)


def table(df):
    return sorted(tuple("NULL" if v is pd.NA else f"{float(v):.6g}" if isinstance(v, int | float) and not isinstance(v, bool) and v == v else plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, sf_dir, duck):
    got, want = catalogue.queries()[name](spark, sf_dir).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)
