"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

from pricegrid.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)) or not pd.api.types.is_scalar(v):
        return repr(v)
    if pd.isna(v):
        return None
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 9)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr([plain(v) for v in r]) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{small}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got, want = QUERIES[name](spark, small).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
