import duckdb
import pytest

from wordloom.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    frame = queries.queries()[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    result = connection.sql(queries.oracle_sql()[name])
    assert sorted(result.columns) == columns
    key = lambda row: tuple((value is not None, value) for value in row)
    got = sorted((tuple(row) for row in frame.select(columns).collect()), key=key)
    want = sorted(result.select(", ".join(f'"{column}"' for column in columns)).fetchall(), key=key)
    assert got == want
