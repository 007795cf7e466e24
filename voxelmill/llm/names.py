"""Columns of callers that are called like an operator's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def freed(df: DataFrame, reserved: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with other names for its columns that are called like reserved ones, and what to rename them back to."""
    own = {r.lower() for r in reserved}
    used = own | {c.lower() for c in df.columns}
    given: dict[str, str] = {}
    for column in df.columns:
        if column.lower() in own:
            name = column
            while name.lower() in used:
                name += "_"
            used.add(name.lower())
            given[column] = name
    return df.withColumnsRenamed(given), {name: column for column, name in given.items()}
