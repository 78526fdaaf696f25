"""Every registered query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tessella.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    columns = sorted(frame.columns)

    def value(v):
        if isinstance(v, float):
            return "null" if v != v else str(round(v, 6) + 0.0)
        return "null" if v is None else str(v)

    return columns, sorted(tuple(map(value, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    database = duckdb.connect()
    for table in TABLES:
        database.sql(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(sf, table)}.parquet'")
    assert rows(catalog.QUERIES[name](spark, sf).toPandas()) == rows(database.sql(catalog.ORACLE_SQL[name]).df())


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
