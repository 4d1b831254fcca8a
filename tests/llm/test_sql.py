"""The training-data queries that have SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from marketloom.llm.oracle import ORACLE_SQL
from marketloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})")
    assert sorted(map(repr, map(tuple, df.select(cols).collect()))) == sorted(map(repr, rel.fetchall()))
