"""The operators that SQL expresses, against DuckDB on whole tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from sitewatch.llm.oracle import ORACLE
from sitewatch.llm.queries import QUERIES

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck(medium):
    con = duckdb.connect()
    for path in Path(medium).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, medium, name):
    got = QUERIES[name](spark, medium)
    want = duck.sql(ORACLE[name])
    assert dict(got.dtypes) == {c: TYPES[str(t)] for c, t in zip(want.columns, want.types)}
    places = [got.columns.index(c) for c in want.columns]
    rows = Counter(tuple(r[k] for k in places) for r in got.collect())
    assert rows and rows == Counter(want.fetchall())
