"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalog

FOLDER = os.environ.get("TESSERA_TEST_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{files}')")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(tuple, df.where(df.notna(), None).values.tolist()), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sql, name):
    assert rows(catalog.QUERIES[name](spark, FOLDER).toPandas()) == rows(sql.sql(catalog.ORACLES[name]).df())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
