"""Every query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from affinity_jobs import chain_queries, queries

DATA = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(float(v), 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(tidy(row[i]) for i in order) for row in values), key=repr)


SQL = queries.SQL | chain_queries.SQL
QUERIES = queries.queries() | chain_queries.queries()


@pytest.mark.parametrize("name", list(SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    found = QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    frame = con.sql(SQL[name]).to_arrow_table()
    want = rows(frame.column_names, zip(*[c.to_pylist() for c in frame.columns], strict=True))
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == want
