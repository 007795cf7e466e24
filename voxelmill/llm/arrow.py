"""Columns made in Python from Arrow batches, a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

CHUNK_BYTES = 1 << 20
#: About so many bytes go to Python at once.
BATCH_BYTES = 2 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends rows to Python in batches of a few megabytes, however long the texts are.

    Spark counts 10,000 rows otherwise, and both the executor and the worker hold them. The setting stays.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to about ``most``."""
    lo, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def value_bytes(values: pa.Array) -> list[int]:
    """About how many bytes each value takes."""
    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind):
        return pc.fill_null(pc.binary_length(values), 0).to_pylist()
    if pa.types.is_list(kind):
        each = 400 if pa.types.is_struct(kind.value_type) else 8  # a struct becomes a dict
        return [each * n for n in pc.fill_null(pc.list_value_length(values), 0).to_pylist()]
    return [8] * len(values)


def with_python_columns(df: DataFrame, inputs: list[str], added: StructType, make: Callable[..., list], as_lists: bool = True, dropped: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns ``added``, which ``make`` gives as lists or arrays for the input columns' values.

    The values come as lists, or as Arrow arrays unless ``as_lists``.

    Columns of ``df`` with the added names are replaced, and those named in ``dropped`` don't come back. ``make`` gets stretches of rows of about CHUNK_BYTES of input,
    so what a worker holds doesn't grow with the batches that Spark sends.
    """
    kept = df.drop(*(f.name for f in added if f.name not in inputs))
    out_columns = [f for f in kept.schema if f.name not in added.names and f.name not in dropped]
    types = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            used = [batch.column(batch.schema.get_field_index(c)) for c in inputs]
            sizes = [sum(row) for row in zip(*map(value_bytes, used), strict=True)]
            rest = [batch.column(batch.schema.get_field_index(f.name)) for f in out_columns]
            for lo, hi in chunks(sizes):
                made = make(*(part.to_pylist() if as_lists else part for part in (x.slice(lo, hi - lo) for x in used)))
                arrays = [m.cast(t) if isinstance(m, pa.Array) else pa.array(m, t) for m, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in rest), *arrays], names=[*(f.name for f in out_columns), *added.names])

    return small_batches(kept).mapInArrow(run, StructType([*out_columns, *added.fields]))


def stretches(batches: Iterator[pa.RecordBatch], inputs: list[str], most: int = CHUNK_BYTES) -> Iterator[list[list]]:
    """The columns' values as lists, in stretches of rows of about ``most`` bytes."""
    for batch in batches:
        used = [batch.column(batch.schema.get_field_index(c)) for c in inputs]
        for lo, hi in chunks([sum(row) for row in zip(*map(value_bytes, used), strict=True)], most):
            yield [x.slice(lo, hi - lo).to_pylist() for x in used]
