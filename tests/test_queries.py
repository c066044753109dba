import re

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


# Queries for training data have tests of their own.
NAMES = sorted(name for name in entry.queries() if not re.match(r"op\d+_|pipeline$", name))


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, oracle, name):
    frame = entry.queries()[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    result = oracle.sql(entry.oracle_sql()[name])
    assert sorted(result.columns) == columns
    got = sorted(tuple(row) for row in frame.select(columns).collect())
    want = sorted(result.select(", ".join(f'"{column}"' for column in columns)).fetchall())
    assert got and got == want


def test_blake2b_search_reads_a_stored_index(spark, monkeypatch):
    """the index is read several times, so it must not be computed each time."""
    seen = {}
    search = entry.find.search

    def spy(index, *more, **named):
        seen["plan"] = index._jdf.queryExecution().executedPlan().toString()
        return search(index, *more, **named)

    monkeypatch.setattr(entry.find, "search", spy)
    entry.queries()["search_blake2b"](spark, SF_DIR)
    assert "Scan parquet" in seen["plan"] and "Arrow" not in seen["plan"]
