"""Exact Euclidean distance maps of sparse voxels, axis by axis, by lower envelopes of parabolas.

The square of a distance is a sum over the axes. Along a line every source is a parabola, and the least of them at each
place is their lower envelope, which a stack finds in one pass. A slice's sources give first their distances along x and
then along y (both in one pass over the slice, for a tile of columns), and all slices' values at (y, x) those along z. A
group holds a slice's sources, or a line along z for a tile: never a volume, and nothing is paired within one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns along x that are worked on together.
TILE = 64
#: Groups go to numpy in stretches of about so many values.
STRETCH = 1 << 19


def stacked(values: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Values in order of their groups as a matrix with a column for each group, and how many each group has."""
    counts = np.bincount(group, minlength=groups)
    place = np.arange(len(group)) - (np.cumsum(counts) - counts)[group]
    table = np.zeros((int(counts.max(initial=0)), groups), values.dtype)
    table[place, group] = values
    return table, counts


def envelope_minima(positions: np.ndarray, heights: np.ndarray, counts: np.ndarray, scale: float, targets: np.ndarray) -> np.ndarray:
    """For each column min over k of heights[k] + scale (target - positions[k])^2 at each target.

    A column's first ``counts`` entries count, one at the least; positions and targets rise down the columns.
    """
    lifted = heights + scale * positions * positions
    stack, left = np.zeros(positions.shape, np.int64), np.full(positions.shape, -np.inf)
    columns = np.arange(positions.shape[1])
    top = np.zeros(len(columns), np.int64)
    for k in range(1, len(positions)):
        open_ = columns[counts > k]
        while len(open_):
            last = stack[top[open_], open_]
            meet = (lifted[k, open_] - lifted[last, open_]) / (2 * scale * (positions[k, open_] - positions[last, open_]))
            hidden = meet <= left[top[open_], open_]
            over = open_[~hidden]
            top[over] += 1
            stack[top[over], over], left[top[over], over] = k, meet[~hidden]
            open_ = open_[hidden]
            top[open_] -= 1
    found, at = np.empty(targets.shape), np.zeros(len(columns), np.int64)
    for m, target in enumerate(targets):
        while True:
            on = (at < top) & (left[np.minimum(at + 1, len(left) - 1), columns] < target)
            if not on.any():
                break
            at += on
        best = stack[at, columns]
        found[m] = heights[best, columns] + scale * (target - positions[best, columns]) ** 2
    return found


def lists(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """A list column's values, and the row of each."""
    values = column.flatten()
    return values, np.repeat(np.arange(len(column)), np.asarray(column.value_lengths()))


def numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def pieces(batches: Iterator[pa.RecordBatch], weight) -> Iterator[pa.RecordBatch]:
    """Rows in stretches of about STRETCH by weight."""
    for batch in batches:
        total, lo = np.cumsum(weight(batch)), 0
        while lo < len(total):
            before = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, before + STRETCH, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def slice_distances(batch: pa.RecordBatch, scale_y: float, scale_x: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(row, y, squares): for each row (a slice's sources and a tile) and y of its range the squares over the tile's columns."""
    sources, row = lists(batch.column("sources"))
    y, x = numbers(sources.field("y")).astype(np.int64), numbers(sources.field("x")).astype(np.int64)
    order = np.lexsort((x, y, row))
    row, y, x = row[order], y[order], x[order]
    first = np.concatenate([[True], (row[1:] != row[:-1]) | (y[1:] != y[:-1])])
    line, line_row, line_y = np.cumsum(first) - 1, row[first], y[first].astype(float)
    x_low, x_high, y_low, y_high = (numbers(batch.column(c)).astype(np.int64) for c in ("x_low", "x_high", "y_low", "y_high"))
    widths, heights = x_high - x_low + 1, y_high - y_low + 1
    table, counts = stacked(x.astype(float), line, len(line_row))
    steps = np.arange(int(widths.max()))[:, None]
    along_x = envelope_minima(table, np.zeros_like(table), counts, scale_x, (x_low[line_row] + steps).astype(float))  # column of a tile x line
    columns_of = np.cumsum(widths) - widths  # where each row's columns begin
    column_row = np.repeat(np.arange(len(widths)), widths)
    position, lines_in = stacked(line_y, line_row, len(widths))
    at = stacked(np.arange(len(line_row)), line_row, len(widths))[0]
    height = along_x[np.arange(len(column_row)) - columns_of[column_row], at[:, column_row]]
    targets = (y_low[column_row] + np.arange(int(heights.max()))[:, None]).astype(float)
    along_y = envelope_minima(position[:, column_row], height, lines_in[column_row], scale_y, targets)
    out = [along_y[: heights[r], columns_of[r] : columns_of[r] + widths[r]] for r in range(len(widths))]
    return np.repeat(np.arange(len(widths)), heights), np.concatenate([np.arange(a, b + 1) for a, b in zip(y_low, y_high, strict=True)]), out


def column_distances(batch: pa.RecordBatch, scale_z: float) -> pa.ListArray:
    """Per row (all slices' squares at one y and tile, and voxels asked for there) the squares at the voxels, in their order."""
    slices, slice_row = lists(batch.column("slices"))
    asked, asked_row = lists(batch.column("asked"))
    z, tables = numbers(slices.field("s")).astype(float), slices.field("squares")
    begins = np.asarray(tables.offsets)[:-1]
    squares = numbers(tables.values)
    order = np.lexsort((z, slice_row))
    position, counts = stacked(z[order], slice_row[order], len(batch))
    begin = stacked(begins[order], slice_row[order], len(batch))[0]
    x_low = numbers(batch.column("x_low")).astype(np.int64)[asked_row]
    offset, target = numbers(asked.field("x")).astype(np.int64) - x_low, numbers(asked.field("z")).astype(float)
    order = np.lexsort((target, offset, asked_row))
    row, offset, target = asked_row[order], offset[order], target[order]
    first = np.concatenate([[True], (row[1:] != row[:-1]) | (offset[1:] != offset[:-1])])
    column = np.cumsum(first) - 1
    targets, asked_in = stacked(target, column, int(first.sum()))
    places = np.arange(len(column)) - (np.cumsum(asked_in) - asked_in)[column]
    # beyond what a column asks for targets are zero; they must not fall, so they repeat the last one
    targets = np.maximum.accumulate(np.where(np.arange(len(targets))[:, None] < asked_in, targets, -np.inf), axis=0)
    of, shift = row[first], offset[first]
    live = np.arange(len(position))[:, None] < counts[of]
    height = squares[np.where(live, begin[:, of] + shift, 0)]
    found = envelope_minima(position[:, of], height, counts[of], scale_z, targets)
    values = np.empty(len(column))
    values[order] = found[places, column]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.asarray(batch.column("asked").value_lengths()))]), pa.int32()), pa.array(values))


def distances_to(sources: DataFrame, asked: DataFrame, keys: list[str], spacing: tuple[float, float, float], repeated: bool = True) -> DataFrame:
    """(keys, z, y, x, d): for each voxel asked for the distance to the nearest source voxel with equal keys.

    Both have the keys and integer z, y, x; keys aren't null. Repeated voxels count once; without
    ``repeated`` there are none. Voxels asked for without any
    source under their keys have no row. Values between the passes take a double for each source slice and (y, x) of the
    box of what is asked, as a dense map of the slices would.
    """
    scale_z, scale_y, scale_x = (float(s) ** 2 for s in spacing)
    asked, sources = (v.select(*keys, "z", "y", "x") for v in (asked, sources))
    if repeated:
        asked, sources = asked.distinct(), sources.distinct()
    tile = F.floor(F.col("x") / TILE).cast("int")
    boxes = asked.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in "yx" for n, f in (("low", F.min), ("high", F.max))])
    slices = sources.groupBy(*keys, "z").agg(F.collect_list(F.struct("y", "x")).alias("sources"))
    tiles = F.explode(F.sequence(F.floor(F.col("x_low") / TILE).cast("int"), F.floor(F.col("x_high") / TILE).cast("int")))
    low, high = F.greatest("x_low", F.col("tile") * TILE), F.least("x_high", F.col("tile") * TILE + (TILE - 1))
    tiled = slices.join(boxes, keys).withColumn("tile", tiles).withColumns({"x_low": low, "x_high": high})
    key_fields = [f for f in tiled.select(*keys).schema]
    key_text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields)

    def over_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = lambda b: np.asarray(b.column("sources").value_lengths()) + (numbers(b.column("x_high")) - numbers(b.column("x_low")) + 1) * (numbers(b.column("y_high")) - numbers(b.column("y_low")) + 1)
        for batch in pieces(batches, weight):
            row, y, squares = slice_distances(batch, scale_y, scale_x)
            index = pa.array(row)
            lengths = np.concatenate([np.full(len(s), s.shape[1]) for s in squares])
            arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(np.concatenate([s.ravel() for s in squares])))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(index) for k in (*keys, "tile", "x_low")), pa.array(y.astype(np.int32)), batch.column("z").take(index), arrays], names=[*keys, "tile", "x_low", "y", "s", "squares"])

    flat = tiled.mapInArrow(over_slices, f"{key_text}, tile int, x_low int, y int, s int, squares array<double>")
    lines = flat.groupBy(*keys, "tile", "y").agg(F.first("x_low").alias("x_low"), F.collect_list(F.struct("s", "squares")).alias("slices"))
    wanted = asked.groupBy(*keys, tile.alias("tile"), "y").agg(F.collect_list(F.struct("z", "x")).alias("asked"))

    def over_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = lambda b: np.asarray(b.column("slices").value_lengths()) * TILE + np.asarray(b.column("asked").value_lengths())
        for batch in pieces(batches, weight):
            values = column_distances(batch, scale_z)
            flat_asked, row = lists(batch.column("asked"))
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(index) for k in keys), flat_asked.field("z"), batch.column("y").take(index), flat_asked.field("x"), pa.array(np.sqrt(values.values.to_numpy()))], names=[*keys, "z", "y", "x", "d"])

    return lines.join(wanted, [*keys, "tile", "y"]).mapInArrow(over_lines, f"{key_text}, z int, y int, x int, d double")
