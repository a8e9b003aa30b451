"""Every registered query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from scoregate.plans import registry


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def canonical(rows):
    def cell(v):
        if v is None or v != v:
            return "~"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, sf_dir, db, name):
    got = registry.QUERIES[name](spark, sf_dir)
    want = db.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    at = [want.columns.index(c) for c in columns]
    assert canonical(rows) == canonical([tuple(r[i] for i in at) for r in want.fetchall()])
