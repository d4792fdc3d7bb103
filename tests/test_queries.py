"""Every registered query against its DuckDB equivalent at sf0.01."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from strataline.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return db


def comparable(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows(spark, duck, name):
    mine = registry.queries()[name](spark, SF)
    theirs = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(columns) == sorted(mine.columns)
    got = comparable(tuple(r) for r in mine.select(*columns).collect())
    assert got == comparable(theirs.fetchall()) and got


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows[-1].language == "Total" and rows[-1].lines == rows[-1].blanks + rows[-1].comments + rows[-1].code
    assert set(registry.queries()) <= set(entry.queries())
