"""Every registered query against the same question asked in SQL to DuckDB."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


def test_every_query_has_its_sql():
    assert set(entry.log_queries()) == set(entry.oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(entry.log_queries()))
def test_query(spark, con, name):
    found = entry.log_queries()[name](spark, str(FOLDER))
    result = con.execute(entry.oracle_sql()[name])
    columns = [column[0] for column in result.description]
    assert sorted(found.columns) == sorted(columns)
    rows = [tuple(row) for row in found.collect()]
    assert comparable(rows, found.columns) == comparable(result.fetchall(), columns)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
