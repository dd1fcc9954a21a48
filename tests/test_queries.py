"""Every registered query of the inventory engine against its SQL, on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")

from stockroom.plans import every as queries  # noqa: E402


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame, columns):
    def text(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "null"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(map(text, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, small, oracle, name):
    got, want = queries.QUERIES[name](spark, small).toPandas(), oracle.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)
