"""Queries that SQL can express against DuckDB at sf0.01."""

import glob
import os

import duckdb
import pytest

from strataline.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    mine = registry.queries()[name](spark, SF)
    theirs = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(columns) == sorted(mine.columns)
    assert sorted((tuple(r) for r in mine.select(*columns).collect()), key=str) == sorted(theirs.fetchall(), key=str)
