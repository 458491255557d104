"""Every timed-text query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from cueloom.plans import queries

SMALL = "/root/testdata/sf0.001"
TABLES = ["documents", "pages"]


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        yield c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    frame = queries.QUERIES[name](spark, SMALL)
    found = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if name in queries.ORACLE:
        result = duck.sql(queries.ORACLE[name])
        assert found == rows_of(result.columns, result.fetchall())
    else:
        assert found[1]
