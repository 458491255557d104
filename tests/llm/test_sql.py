"""Queries of training-text operators against their SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from cueloom.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    frame = queries.QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    found = sorted(tuple(str(r[c]) for c in columns) for r in frame.collect())
    with duckdb.connect() as duck:
        for table in ("documents", "pages", "conversations"):
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
        result = duck.sql(queries.ORACLE_SQL[name])
        place = [result.columns.index(c) for c in columns]
        assert found == sorted(tuple(str(r[k]) for k in place) for r in result.fetchall())
