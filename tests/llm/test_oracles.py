"""Operators' queries with SQL give the rows that DuckDB gives for it."""

import os

import duckdb
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET memory_limit='2GB'")
    con.sql("SET temp_directory=''")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: sorted(str(tuple(None if v != v else v for v in r)) for r in df[columns].astype(object).itertuples(index=False, name=None))
    assert plain(got) == plain(want)
