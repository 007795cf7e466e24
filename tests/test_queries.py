"""Every query of the library against its SQL on the smallest tables, and the operators on small cases."""

import math
from pathlib import Path

import duckdb
import pytest

from voxelmill.plans import catalogue

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return "null" if value is None else f"{value:.6g}" if isinstance(value, int) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_gives_what_its_sql_gives(name, spark, db):
    rows = catalogue.QUERIES[name](spark, str(TABLES))
    columns = sorted(rows.columns)
    found = db.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = sorted(tuple(plain(r[p]) for p in places) for r in found.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in rows.select(columns).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_queries_without_sql_give_rows(name, spark):
    assert catalogue.QUERIES[name](spark, str(TABLES)).count() > 0


def test_registration_takes_its_default_steps(monkeypatch):
    """The registered query searches as long as the operator does by default, not for a few steps."""
    import inspect

    from voxelmill.operators import registration
    from voxelmill.plans import imaging

    made, signature = [], inspect.signature(registration.register)
    monkeypatch.setattr(imaging.registration, "register", lambda *args, **named: made.append(signature.bind(*args, **named)))
    monkeypatch.setattr(imaging.registration, "grid", lambda spark: None)
    monkeypatch.setattr(imaging.views, "dense_masks", lambda spark, d: None)
    imaging.registration_grid(None, "")
    made[0].apply_defaults()
    assert made[0].arguments["steps"] == signature.parameters["steps"].default == 100


def test_quality_groups_columns_once(spark):
    """Masks by return flag are packed in one grouping; voxels are neither made distinct nor pivoted."""
    from voxelmill.plans import imaging

    plan = imaging.quality(spark, str(TABLES))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and "bit_or" in plan and "pivot" not in plan
