"""Continuous fields over voxel grids: Gaussian smoothing and soft Dice, cubic splines and the warps that they allow.

Fields are rows (keys, z, y, x, value); places without a row are background.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distances import lists, numbers, pieces
from .geometry import source_of
from .masks import VOXEL

#: Width of the smoothing of soft Dice, and where its bell is cut, in widths.
SIGMA, TRUNCATE = 2.0, 4.0
#: Targets by axis that are smoothed together.
BLOCK = 64
#: The pole of the cubic spline's recursions.
POLE = math.sqrt(3) - 2


def kernel_matrix(length: int, block: int, size: int, radius: int, sigma: float) -> np.ndarray:
    """(targets of a block, sources that it sees) along an axis of so many voxels, which goes on mirrored at its ends, the end voxels twice."""
    first, last = max(0, block * size - radius), min(length, (block + 1) * size + radius)
    targets = np.arange(block * size, min(length, (block + 1) * size))
    steps = np.arange(-radius, radius + 1)
    bell = np.exp(-0.5 * (steps / sigma) ** 2)
    place = (targets[:, None] + steps) % (2 * length)
    source = np.where(place < length, place, 2 * length - 1 - place) - first
    weights = np.zeros((len(targets), last - first))
    np.add.at(weights, (np.arange(len(targets))[:, None], source), bell / bell.sum())
    return weights


def in_blocks(field: DataFrame, keys: list[str], shape: tuple[int, int, int], radius: int, part: Column, size: int) -> DataFrame:
    """(keys, _b0, _b1, _b2, given): each value in the blocks of ``size`` targets by axis that see it, with its place among what the block sees.

    A row holds a block and what is around it, however large the volume is. ``part`` tells apart fields that share a row.
    """
    stride = size + 2 * radius
    inside, place = F.col("value").isNotNull(), part.cast("long")
    for axis, length in zip(VOXEL, shape, strict=True):
        inside = inside & F.col(axis).between(0, length - 1)
    rows = field.filter(inside)
    for r, (axis, length) in enumerate(zip(VOXEL, shape, strict=True)):
        first, last = F.floor((F.col(axis) - radius) / size).cast("int"), F.floor((F.col(axis) + radius) / size).cast("int")
        most = (length - 1) // size
        rows = rows.withColumn(f"_b{r}", F.explode(F.sequence(F.greatest(F.lit(0), first), F.least(F.lit(most), last))) if most else F.lit(0))
        place = place * stride + (F.col(axis) - F.greatest(F.lit(0), F.col(f"_b{r}") * size - radius))
    return rows.groupBy(*keys, "_b0", "_b1", "_b2").agg(F.collect_list(F.struct(place.alias("place"), F.col("value").cast("double").alias("value"))).alias("given"))


def over_blocks(blocks: DataFrame, keys: list[str], shape: tuple[int, int, int], radius: int, sigma: float, size: int, parts: int, out: str, make) -> DataFrame:
    """(keys and the columns of ``out``): what ``make`` returns as arrays for each block's smoothed fields and its first target."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*keys).schema)
    stride, names = size + 2 * radius, [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = lru_cache(maxsize=64)(lambda axis, block: kernel_matrix(shape[axis], block, size, radius, sigma))
        for batch in pieces(batches, lambda b: np.full(b.num_rows, math.prod(min(size, n) for n in shape))):
            given, row = lists(batch.column("given"))
            place, value = numbers(given.field("place")), numbers(given.field("value"))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            at = [numbers(batch.column(f"_b{r}")) for r in range(3)]
            made = []
            for k in range(batch.num_rows):
                matrices = [kernel(r, int(at[r][k])) for r in range(3)]
                wide = [m.shape[1] for m in matrices]
                p = place[ends[k] : ends[k + 1]]
                cell = ((p // stride**3 * wide[0] + p // stride**2 % stride) * wide[1] + p // stride % stride) * wide[2] + p % stride
                dense = np.bincount(cell, value[ends[k] : ends[k + 1]], parts * math.prod(wide)).reshape(parts, *wide)
                smooth = matrices[1] @ (dense @ matrices[2].T)
                smooth = (matrices[0] @ smooth.reshape(parts, wide[0], -1)).reshape(parts, *(len(m) for m in matrices))
                made.append(make(smooth, [int(at[r][k]) * size for r in range(3)]))
            index = pa.array(np.repeat(np.arange(batch.num_rows), [len(m[0]) for m in made]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(index) for c in keys), *(pa.array(np.concatenate(c)) for c in zip(*made, strict=True))], names=[*keys, *names])

    return blocks.mapInArrow(run, f"{fields}, {out}")


def reach_of(sigma: float, truncate: float = TRUNCATE) -> int:
    return int(truncate * sigma + 0.5)


def smoothed(field: DataFrame, keys: list[str], shape: tuple[int, int, int], sigma: float = SIGMA, size: int = BLOCK) -> DataFrame:
    """The field under a Gaussian wherever that isn't zero: values travel once, to the blocks that see them."""
    radius = reach_of(sigma)

    def voxels(smooth: np.ndarray, first: list[int]) -> list[np.ndarray]:
        at = np.nonzero(smooth[0])
        return [*((a + f).astype(np.int32) for a, f in zip(at, first, strict=True)), smooth[0][at]]

    return over_blocks(in_blocks(field, keys, shape, radius, F.lit(0), size), keys, shape, radius, sigma, size, 1, "z int, y int, x int, value double", voxels)


def soft_dice(masks: DataFrame, a: str, b: str, shape: tuple[int, int, int], sigma: float = SIGMA) -> DataFrame:
    """(volume, soft_dice_loss): 1 - 2 sum(pq) / (sum p + sum q) of the two masks smoothed; volumes without voxels have no row.

    Where one mask is empty the loss is 1. No array of the grid is made.
    """
    return soft_dice_of(masks.select("volume", "side", *VOXEL, F.lit(1.0).alias("value")), a, b, shape, sigma)


def soft_dice_of(given: DataFrame, a: str, b: str, shape: tuple[int, int, int], sigma: float = SIGMA, size: int = BLOCK) -> DataFrame:
    """``soft_dice`` of fields (volume, side, z, y, x, value). Smoothed values stay in their block, of which two sums are left."""
    radius = reach_of(sigma)

    def sums(smooth: np.ndarray, first: list[int]) -> list[np.ndarray]:
        return [np.array([np.vdot(smooth[0], smooth[1])]), np.array([smooth.sum()])]

    blocks = in_blocks(given.filter(F.col("side").isin(a, b)), ["volume"], shape, radius, F.when(F.col("side") == a, 0).otherwise(1), size)
    both = over_blocks(blocks, ["volume"], shape, radius, sigma, size, 2, "common double, total double", sums)
    return both.groupBy("volume").agg((1 - F.try_divide(2 * F.sum("common"), F.sum("total"))).alias("loss")).select("volume", F.coalesce("loss", F.lit(1.0)).alias("soft_dice_loss"))


def spline_lines(values: np.ndarray) -> np.ndarray:
    """Cubic spline coefficients down each column, by a recursion forward and one backward; ends are mirrored, end values once."""
    n = len(values)
    if n == 1:
        return values.astype(float)
    c = values * 6.0
    far = POLE ** (n - 1)
    powers = POLE ** np.arange(1, n - 1)
    c[0] = (c[0] + far * c[-1] + (powers[:, None] * (c[1:-1] + far * c[-2:0:-1])).sum(axis=0)) / (1 - far * far)
    for k in range(1, n):
        c[k] += POLE * c[k - 1]
    c[-1] = (POLE * c[-2] + c[-1]) * POLE / (POLE * POLE - 1)
    for k in range(n - 2, -1, -1):
        c[k] = POLE * (c[k + 1] - c[k])
    return c


def along(field: DataFrame, keys: list[str], axis: str, length: int) -> DataFrame:
    """(keys, the other axes, line): the spline coefficients along an axis as an array, of lines with any value."""
    others = [c for c in VOXEL if c != axis]
    grouped = field.groupBy(*keys, *others).agg(F.collect_list(F.struct(F.col(axis).alias("at"), F.col("value").cast("double").alias("value"))).alias("given"))
    kept = [*keys, *others]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grouped.schema if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, lambda b: np.full(b.num_rows, length)):
            given, row = lists(batch.column("given"))
            table = np.zeros((length, batch.num_rows))
            table[numbers(given.field("at")), row] = numbers(given.field("value"))
            lines = spline_lines(table).T
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(np.arange(0, lines.size + 1, length), pa.int32()), pa.array(lines.ravel()))], names=[*kept, "line"])

    return grouped.mapInArrow(run, f"{fields}, line array<double>")


def spline_coefficients(field: DataFrame, keys: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """(keys, z, y, line): cubic spline coefficients of a field (zero where it has no row), as lines along x.

    Three passes over lines keyed by the two other axes; lines without any value are zero and have no row.
    """
    for axis, length in zip(VOXEL[:2], shape[:2], strict=True):
        others = [c for c in VOXEL if c != axis]
        field = along(field, keys, axis, length).select(*keys, *others, F.posexplode("line").alias(axis, "value"))
    return along(field, keys, VOXEL[2], shape[2])


def cubic_weights(t: Column) -> list[Column]:
    """The weights of the coefficients one before a place's whole part, at it, one and two after it; ``t`` is the rest."""
    u = 1 - t
    return [u * u * u / 6, (4 + t * t * (3 * t - 6)) / 6, (4 + u * u * (3 * u - 6)) / 6, t * t * t / 6]


def mirrored(index: Column, length: int) -> Column:
    """An index up to two beyond the axis, mirrored into it at its end voxels."""
    if length == 1:
        return index * 0
    back = F.pmod(index, F.lit(2 * (length - 1)))
    return F.when(back < length, back).otherwise(2 * (length - 1) - back)


def warp_cubic(field: DataFrame, matrices: DataFrame, on: list[str], keys: list[str], shape: tuple[int, int, int], background: float = 0.0, digits: int = 6) -> DataFrame:
    """(keys, the matrices' other keys, z, y, x, value): fields under each pose by cubic splines, for the whole output grid.

    ``matrices`` (of ``with_matrix``) has columns ``on`` and ``pose``. Source points outside the grid give ``background``, which
    is also the value of places without a row (-1000 for computed tomography). A place takes 64 coefficients: 16 lines by
    equi-joins, of each of which four are picked.
    """
    lines = spline_coefficients(field.withColumn("value", F.col("value") - background), keys, shape)
    grid = matrices.join(field.select(*keys).distinct(), on)
    for axis, length in zip(VOXEL, shape, strict=True):
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    places = grid.withColumns({f"s{r}": s for r, s in enumerate(source_of([F.col(c) for c in VOXEL]))})
    names = [*keys, *(["pose"] if "pose" in matrices.columns and "pose" not in keys else []), *VOXEL]
    inside = F.lit(True)
    for r, length in enumerate(shape):
        inside = inside & F.col(f"s{r}").between(0, length - 1)
    places = places.select(*names, inside.alias("_inside"), *[F.floor(f"s{r}").cast("int").alias(f"b{r}") for r in range(3)], *[(F.col(f"s{r}") - F.floor(f"s{r}")).alias(f"f{r}") for r in range(3)])
    wz, wy, wx = ([w for w in cubic_weights(F.col(f"f{r}"))] for r in range(3))
    corner = F.explode(F.array(*[F.struct(mirrored(F.col("b0") + (i - 1), shape[0]).alias("cz"), mirrored(F.col("b1") + (j - 1), shape[1]).alias("cy"), (wz[i] * wy[j]).alias("weight")) for i in range(4) for j in range(4)]))
    asked = places.filter("_inside").select(*names, "b2", "f2", corner.alias("c")).select(*names, "b2", "f2", "c.*")
    found = asked.join(lines.withColumnsRenamed({"z": "cz", "y": "cy"}), [*keys, "cz", "cy"])
    across = sum((wx[k] * F.get("line", mirrored(F.col("b2") + (k - 1), shape[2])) for k in range(1, 4)), wx[0] * F.get("line", mirrored(F.col("b2") - 1, shape[2])))
    parts = found.select(*names, (across * F.col("weight")).alias("value")).unionByName(places.select(*names, F.lit(0.0).alias("value")))
    return parts.groupBy(*names).agg((F.round(F.sum("value") + background, digits) + 0.0).alias("value"))
