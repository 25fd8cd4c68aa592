"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from loomstone.plans import catalogue


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f if os.path.isfile(f) else f + '/*.parquet'}')")
    return c


def rows(pdf: pd.DataFrame) -> list:
    show = lambda v: "NULL" if v is None or v is pd.NA or v != v else repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, data, db, name):
    ours, theirs = catalogue.QUERIES[name](spark, data).toPandas(), db.execute(catalogue.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0
