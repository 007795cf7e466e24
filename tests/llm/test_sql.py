"""The queries on training text that SQL can express, against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from voxelmill.llm import catalogue

TABLES = Path("/root/testdata/sf0.001")


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_gives_what_its_sql_gives(name, spark):
    con = duckdb.connect()
    for table in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    rows = catalogue.QUERIES[name](spark, str(TABLES))
    columns = sorted(rows.columns)
    found = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = sorted(tuple(plain(r[p]) for p in places) for r in found.fetchall())
    assert expected and sorted(tuple(plain(v) for v in r) for r in rows.select(columns).collect()) == expected
