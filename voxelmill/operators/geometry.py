"""Rigid transforms and resampling of sparse masks, in array order (z, y, x), voxels and radians.

A warp maps output voxels back into the input: in = R^T out + offset with offset = c - R^T c - R^T t, where the centre c
is half the grid's shape and R = Rz Ry Rx.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..components import components
from ..shared import stored
from .distances import lists, numbers, pieces
from .masks import VOXEL, packed, unpacked

ANGLES = ("rz", "ry", "rx")
SHIFTS = ("tz", "ty", "tx")
#: Digits that places on grids are rounded to.
DIGITS = 6
#: What ``with_matrix`` adds, in order.
MATRIX = [*(f"i{r}{c}" for r in range(3) for c in range(3)), "o0", "o1", "o2"]
#: Output voxels by axis that are warped together.
TILE = 64


def rotation(rz: Column, ry: Column, rx: Column) -> list[list[Column]]:
    """The nine entries of Rz Ry Rx as expressions."""
    cz, sz, cy, sy, cx, sx = F.cos(rz), F.sin(rz), F.cos(ry), F.sin(ry), F.cos(rx), F.sin(rx)
    return [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]


def with_matrix(poses: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Adds the inverse rotation (i00 to i22) and offsets (o0 to o2) of poses (tz, ty, tx, rz, ry, rx)."""
    forward = rotation(*[F.col(a) for a in ANGLES])
    inverse = {f"i{r}{c}": forward[c][r] for r in range(3) for c in range(3)}
    with_inverse = poses.withColumns(inverse)
    centre = [n / 2 for n in shape]
    turned = [sum((F.col(f"i{r}{c}") * (F.lit(centre[c]) + F.col(SHIFTS[c])) for c in range(1, 3)), F.col(f"i{r}0") * (F.lit(centre[0]) + F.col(SHIFTS[0]))) for r in range(3)]
    return with_inverse.withColumns({f"o{r}": F.lit(centre[r]) - turned[r] for r in range(3)})


def inverted(matrices: DataFrame) -> DataFrame:
    """The matrices (i00 to i22, o0 to o2) of the maps that undo those given; other columns stay."""
    turned = {f"i{r}{c}": F.col(f"i{c}{r}") for r in range(3) for c in range(3)}
    moved = {f"o{r}": -sum((F.col(f"i{c}{r}") * F.col(f"o{c}") for c in range(1, 3)), F.col(f"i0{r}") * F.col("o0")) for r in range(3)}
    return matrices.withColumns(turned | moved)


def source_of(voxel: list[Column]) -> list[Column]:
    """Where output voxels lie in the input, to DIGITS digits, so that places meant to be whole are."""
    return [F.round(F.col(f"i{r}0") * voxel[0] + F.col(f"i{r}1") * voxel[1] + F.col(f"i{r}2") * voxel[2] + F.col(f"o{r}"), DIGITS) for r in range(3)]


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Values to some digits, ties away from zero."""
    scale = 10.0**digits
    return np.trunc(values * scale + np.copysign(0.5, values)) / scale


def in_tiles(masks: DataFrame, matrices: DataFrame, on: list[str], keys: list[str], shape: tuple[int, int, int], reach: float) -> DataFrame:
    """(on, keys, _t0, _t1, _t2, columns, matrix): masks under each pose by tiles of the output, each with the input that may reach it.

    The input is packed in columns of 64 voxels along z (``masks.packed``), which go where the pose takes them; a tile without any has no
    row, so the grid is never listed. A row holds a tile's surroundings, however large the mask is.
    """
    inside = F.lit(True)
    for axis, length in zip(VOXEL, shape, strict=True):
        inside = inside & F.col(axis).between(0, length - 1)
    names = list(dict.fromkeys([*on, *keys]))
    columns = packed(masks.filter(inside), [c for c in names if c in masks.columns])
    rows = columns.join(matrices.select(*[c for c in names if c in matrices.columns], F.array(*[F.col(m).cast("double") for m in MATRIX]).alias("_matrix")), on)
    entry = lambda name: F.col("_matrix")[MATRIX.index(name)]
    low, high = F.col("_block") * 64, F.least(F.col("_block") * 64 + 63, F.lit(shape[0] - 1))
    middle = [(low + high) / 2, F.col("y"), F.col("x")]
    half = [(high - low) / 2 + reach, F.lit(reach), F.lit(reach)]
    for axis, length in enumerate(shape):
        centre = sum((entry(f"i{r}{axis}") * (middle[r] - entry(f"o{r}")) for r in range(1, 3)), entry(f"i0{axis}") * (middle[0] - entry("o0")))
        width = sum((F.abs(entry(f"i{r}{axis}")) * half[r] for r in range(1, 3)), F.abs(entry(f"i0{axis}")) * half[0]) + 10.0**-DIGITS
        first, last = F.greatest(F.lit(0), F.ceil(centre - width)).cast("int"), F.least(F.lit(length - 1), F.floor(centre + width)).cast("int")
        rows = rows.withColumns({"_first": first, "_last": last}).filter("_first <= _last")
        rows = rows.withColumn(f"_t{axis}", F.explode(F.sequence(F.floor(F.col("_first") / TILE).cast("int"), F.floor(F.col("_last") / TILE).cast("int"))) if length > TILE else F.lit(0)).drop("_first", "_last")
    return rows.groupBy(*names, "_t0", "_t1", "_t2").agg(F.collect_list(F.struct("y", "x", F.col("_block").alias("block"), "bits")).alias("columns"), F.first("_matrix").alias("matrix"))


def warped_tile(z: np.ndarray, y: np.ndarray, x: np.ndarray, m: np.ndarray, tile: list[int], shape: tuple[int, int, int], linear: bool) -> list[np.ndarray]:
    """The output voxels of a tile (z, y, x, weight) that input voxels reach under a matrix (its entries in order of MATRIX)."""
    source = [z, y, x]
    low, high = [int(v.min()) for v in source], [int(v.max()) for v in source]
    volume = np.zeros([b - a + 3 for a, b in zip(low, high, strict=True)])  # with background around
    volume[tuple(v - a + 1 for v, a in zip(source, low, strict=True))] = 1.0
    reach = 1.0 if linear else 0.5
    turn, offset = m[:9].reshape(3, 3), m[9:]
    centre = turn.T @ ((np.array(low) + high) / 2 - offset)
    half = np.abs(turn).T @ ((np.array(high) - low) / 2 + reach) + 10.0**-DIGITS
    first = [max(int(math.ceil(c - h)), t * TILE) for c, h, t in zip(centre, half, tile, strict=True)]
    last = [min(int(math.floor(c + h)), n - 1, t * TILE + TILE - 1) for c, h, t, n in zip(centre, half, tile, shape, strict=True)]
    if any(a > b for a, b in zip(first, last, strict=True)):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
    along = np.ix_(*[np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    places, near = [], True
    for r in range(3):
        s = rounded(turn[r, 0] * along[0] + turn[r, 1] * along[1] + turn[r, 2] * along[2] + offset[r], DIGITS)
        near = near & (s >= max(0, low[r] - reach)) & (s <= min(shape[r] - 1, high[r] + reach))
        places.append(s)
    at = np.nonzero(near)
    places = [s[at] for s in places]
    steps = [volume.shape[1] * volume.shape[2], volume.shape[2], 1]
    cell, flat = 0, volume.ravel()
    if not linear:
        for s, a, n, step in zip(places, low, volume.shape, steps, strict=True):
            cell = cell + np.minimum(np.floor(s + 0.5).astype(np.int64) - a + 1, n - 1) * step
        weight = flat[cell]
    else:
        rest = []
        for s, a, n, step in zip(places, low, volume.shape, steps, strict=True):
            below = np.minimum(np.floor(s).astype(np.int64) - a + 1, n - 2)
            rest.append(s - (below + a - 1))
            cell = cell + below * step
        tz, ty, tx = rest
        weight = 0.0
        for i, wz in enumerate((1 - tz, tz)):
            for j, wy in enumerate((1 - ty, ty)):
                for k, wx in enumerate((1 - tx, tx)):
                    weight = weight + flat[cell + (i * steps[0] + j * steps[1] + k)] * (wz * wy * wx)
    kept = weight > 0
    return [a[kept] + f for a, f in zip(at, first, strict=True)] + [weight[kept]]


def warped(masks: DataFrame, matrices: DataFrame, on: list[str], keys: list[str], shape: tuple[int, int, int], linear: bool, digits: int = DIGITS, least: float | None = None) -> DataFrame:
    """(keys, z, y, x, value): masks under each pose where they aren't zero, or where they are above ``least``, worked out tile by tile."""
    tiles = in_tiles(masks, matrices, on, keys, shape, 1.0 if linear else 0.5)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, lambda b: np.asarray(b.column("columns").value_lengths()) * 64):
            given, row = lists(batch.column("columns"))
            of, z, y, x = unpacked(given, row)
            ends = np.searchsorted(of, np.arange(batch.num_rows + 1))
            matrix = numbers(batch.column("matrix").flatten()).reshape(-1, len(MATRIX))
            tile = np.stack([numbers(batch.column(f"_t{r}")) for r in range(3)], axis=1).tolist()
            made = []
            for k in range(batch.num_rows):
                part = slice(ends[k], ends[k + 1])
                made.append(warped_tile(z[part], y[part], x[part], matrix[k], tile[k], shape, linear))
            index = np.repeat(np.arange(batch.num_rows), [len(m[3]) for m in made])
            *places, value = (np.concatenate(c) for c in zip(*made, strict=True))
            value = rounded(value, digits)
            if least is not None:
                kept = value > least
                index, places, value = index[kept], [p[kept] for p in places], value[kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(index)) for c in keys), *(pa.array(p.astype(np.int32)) for p in places), pa.array(value)], names=[*keys, *VOXEL, "value"])

    return tiles.mapInArrow(run, f"{fields}, z int, y int, x int, value double")


def warp_nearest(masks: DataFrame, matrices: DataFrame, on: list[str], keys: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """(keys, z, y, x): output voxels whose source point, rounded half up, is a voxel of the mask; outside the grid is background.

    ``matrices`` (of ``with_matrix``) has a row for each pose of each ``on``; ``keys`` name mask and pose.
    """
    return warped(masks, matrices, on, keys, shape, False).select(*keys, *VOXEL)


def warp_linear(masks: DataFrame, matrices: DataFrame, on: list[str], keys: list[str], shape: tuple[int, int, int], digits: int = 9) -> DataFrame:
    """(keys, z, y, x, value): trilinear interpolation of the masks wherever it isn't zero; source points outside the grid give none."""
    return warped(masks, matrices, on, keys, shape, True, digits)


def warp_binary(masks: DataFrame, matrices: DataFrame, on: list[str], keys: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """The linearly warped masks where they are above one half."""
    return warped(masks, matrices, on, keys, shape, True, 9, 0.5).select(*keys, *VOXEL)


def moved_points(points: DataFrame, matrices: DataFrame, on: list[str]) -> DataFrame:
    """Where input voxels go under each pose: out = R (in - offset), as s0, s1, s2."""
    moved = [F.col(c) - F.col(f"o{r}") for r, c in enumerate(VOXEL)]
    return points.join(matrices, on).withColumns({f"s{r}": F.col(f"i0{r}") * moved[0] + F.col(f"i1{r}") * moved[1] + F.col(f"i2{r}") * moved[2] for r in range(3)})


def grid_from_slices(slices: DataFrame, key: str) -> DataFrame:
    """Per series origin, spacing and number of slices from its headers (z, y0, x0, dy, dx, thickness), the topmost slice first.

    The step is that between the two topmost slices; of a single slice its thickness, else 1.
    """
    order = Window.partitionBy(key).orderBy(F.desc("z"))
    placed = slices.withColumns({"place": F.row_number().over(order), "next": F.lead("z").over(order), "n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    return placed.filter("place = 1").select(key, F.col("z").alias("oz"), F.col("y0").alias("oy"), F.col("x0").alias("ox"), F.coalesce(F.abs(F.col("next") - F.col("z")), F.col("thickness"), F.lit(1.0)).alias("sz"), F.col("dy").alias("sy"), F.col("dx").alias("sx"), "n")


def largest_component(masks: DataFrame, key: str) -> DataFrame:
    """The largest face-connected part of each mask; of equally large ones that with the first voxel in (z, y, x) order.

    Voxels meet their neighbours by equi-joins and parts are found for all masks at once, so no task holds a mask.
    """
    voxels = stored(masks.select(key, *VOXEL).distinct().withColumn("_id", F.monotonically_increasing_id()), "voxels")
    beside = F.explode(F.array(*[F.struct(*[(F.col(a) + int(a == axis)).alias(a) for a in VOXEL]) for axis in VOXEL]))
    nexts = voxels.select(F.col(key).alias("_key"), F.col("_id").alias("b"), beside.alias("_at"))
    met = F.col(key).eqNullSafe(F.col("_key"))
    for axis in VOXEL:
        met = met & (F.col(axis) == F.col(f"_at.{axis}"))
    parts = components(voxels.join(nexts, met).select(F.col("_id").alias("a"), "b"))
    labelled = voxels.join(parts, F.col("_id") == F.col("node"), "left").withColumn("_part", F.coalesce("component", "_id")).select(key, *VOXEL, "_part")
    sizes = labelled.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*VOXEL)).alias("first"))
    rank = F.struct("n", *[(-F.col(f"first.{a}")).alias(a) for a in VOXEL])
    best = sizes.groupBy(key).agg(F.max_by("_part", rank).alias("_part")).select("_part")
    return labelled.join(best, "_part", "left_semi").select(key, *VOXEL)
