"""Every query against its oracle SQL in DuckDB, on whole tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from sitewatch.plans import oracle, registry

TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
ORACLE = oracle.oracle_sql()
QUERIES = registry.queries()
ROWS_ONLY = {"cv_results"}


@pytest.fixture(scope="module")
def duck(medium):
    con = duckdb.connect()
    for path in Path(medium).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        # Distinguishes -0.0 from 0.0, and 1 from 1.0.
        return ("float", math.copysign(1, v), v) if isinstance(v, float) else v

    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle_or_a_reason():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_oracle(spark, duck, medium, name):
    got = QUERIES[name](spark, medium)
    want = duck.sql(ORACLE[name])
    assert dict(got.dtypes) == {c: TYPES[str(t)] for c, t in zip(want.columns, want.types)}
    rows = got.collect()
    assert rows
    assert _bag([tuple(r) for r in rows], got.columns) == _bag(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_model_queries_give_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
