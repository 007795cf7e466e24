"""Physical grids of volumes: origin (oz, oy, ox), signed step (sz, sy, sx) and size (nz, ny, nx), and resampling between them.

Axes are those of the body; a series with the topmost slice first has a negative sz.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .masks import VOXEL, overlap, packed, with_voxels

#: What lies outside a CT, in Hounsfield units.
AIR = -1000.0
#: Places on a grid are rounded to this before they are cut to integers.
DIGITS = 9


def grid_from_frames(frames: DataFrame, keys: Sequence[str], between: str = "between") -> DataFrame:
    """Per segmentation the grid of its frames (frame, z, y0, x0, dy, dx, between, cosines), topmost first.

    The origin is the highest frame's (of those at one height the last one's), the step in z the mean gap between
    neighbouring heights, or ``between`` (1 if missing) where there is but one. (cz, cy, cx) is the direction of z: the
    negative cross product of the six cosines' row and column.
    """
    top = F.max_by(F.struct("y0", "x0", "dy", "dx", between, "cosines"), F.struct("z", "frame"))
    found = frames.groupBy(*keys).agg(top.alias("_top"), F.max("z").alias("oz"), F.min("z").alias("_low"), F.count_distinct("z").alias("nz"))
    gap = F.when(F.col("nz") > 1, (F.col("oz") - F.col("_low")) / (F.col("nz") - 1)).otherwise(F.coalesce(F.col(f"_top.{between}"), F.lit(1.0)))
    c = [F.col("_top.cosines")[i] for i in range(6)]
    across = {"cx": c[2] * c[4] - c[1] * c[5], "cy": c[0] * c[5] - c[2] * c[3], "cz": c[1] * c[3] - c[0] * c[4]}
    return found.select(*keys, "oz", F.col("_top.y0").alias("oy"), F.col("_top.x0").alias("ox"), gap.alias("dz"), "_top.dy", "_top.dx", "nz", *[v.alias(n) for n, v in across.items()])


def common_grid(grids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group of grids the finest step by axis over the union of their extents, upwards from its lowest corner."""
    last = {a: F.col(f"o{a}") + F.col(f"s{a}") * (F.col(f"n{a}") - 1) for a in VOXEL}
    ends = [f(F.col(f"o{a}"), last[a]).alias(f"_{name}{a}") for a in VOXEL for name, f in (("low", F.least), ("high", F.greatest))]
    steps = [F.abs(f"s{a}").alias(f"_step{a}") for a in VOXEL]
    found = grids.select(*keys, *ends, *steps).groupBy(*keys).agg(*[f(f"_{n}{a}").alias(f"_{n}{a}") for a in VOXEL for n, f in (("low", F.min), ("high", F.max), ("step", F.min))])
    size = lambda a: (F.ceil(F.round((F.col(f"_high{a}") - F.col(f"_low{a}")) / F.col(f"_step{a}"), DIGITS)) + 1).cast("int")
    return found.select(*keys, *[F.col(f"_low{a}").alias(f"o{a}") for a in VOXEL], *[F.col(f"_step{a}").alias(f"s{a}") for a in VOXEL], *[size(a).alias(f"n{a}") for a in VOXEL])


def with_grids(voxels: DataFrame, grids: DataFrame, target: DataFrame, grid_keys: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Voxels beside their own grid and, in columns with a leading t, the group's target grid."""
    named = target.select(*keys, *[F.col(f"{p}{a}").alias(f"t{p}{a}") for p in "osn" for a in VOXEL])
    return voxels.join(grids, list(grid_keys)).join(named, list(keys))


def target_ranges(axis: str, before: float, after: float) -> tuple[Column, Column]:
    """The first and last target index whose place lies from ``before`` to under ``after`` steps around a source index.

    With a negative step the place just at the far end counts instead of that at the near one.
    """
    k, o, s = F.col(axis), F.col(f"o{axis}"), F.col(f"s{axis}")
    at = lambda shift: F.round((o + (k + shift) * s - F.col(f"to{axis}")) / F.col(f"ts{axis}"), DIGITS)
    first = F.when(s > 0, F.ceil(at(before))).otherwise(F.floor(at(after)) + 1)
    last = F.when(s > 0, F.ceil(at(after)) - 1).otherwise(F.floor(at(before)))
    return F.greatest(F.lit(0), first).cast("int"), F.least(F.col(f"tn{axis}") - 1, last).cast("int")


def spread(rows: DataFrame, before: float, after: float, keep: Sequence[str]) -> DataFrame:
    """Each source voxel with the target voxels (tz, ty, tx) around it; nothing is joined with the whole target grid."""
    for axis in VOXEL:
        first, last = target_ranges(axis, before, after)
        rows = rows.withColumns({"_first": first, "_last": last}).filter("_first <= _last").withColumn(f"t{axis}", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    return rows.select(*keep, *[f"t{a}" for a in VOXEL], *[f"{p}{a}" for p in ("", "o", "s", "n", "to", "ts") for a in VOXEL])


def resample_nearest(voxels: DataFrame, grids: DataFrame, target: DataFrame, grid_keys: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Masks on the target grid: its voxels whose nearest source voxel (half a step up) is in the mask; outside is background.

    ``grids`` has a row for each ``grid_keys`` of the voxels, ``target`` one for each of ``keys``, some of these. Masks meet their
    grids in columns of 64 voxels; repeated voxels count once.
    """
    near = spread(with_voxels(with_grids(packed(voxels, list(grid_keys)), grids, target, grid_keys, keys)), -0.5, 0.5, grid_keys)
    return near.select(*grid_keys, *[F.col(f"t{a}").alias(a) for a in VOXEL])


def resample_linear(values: DataFrame, grids: DataFrame, target: DataFrame, grid_keys: Sequence[str], keys: Sequence[str], digits: int = 6) -> DataFrame:
    """(grid_keys, z, y, x, value): volumes (z, y, x, hu) of full grids, linearly between voxel centres of the target grid.

    Target voxels outside the source's centres have no row: they are ``AIR``. Up to eight source voxels add to each.
    """
    around = spread(with_grids(values, grids, target, grid_keys, keys), -1.0, 1.0, [*grid_keys, "hu"])
    weight = F.lit(1.0)
    inside = F.lit(True)
    for a in VOXEL:
        place = F.round((F.col(f"to{a}") + F.col(f"t{a}") * F.col(f"ts{a}") - F.col(f"o{a}")) / F.col(f"s{a}"), DIGITS)
        inside = inside & place.between(0, F.col(f"n{a}") - 1)
        weight = weight * F.greatest(F.lit(0.0), 1 - F.abs(place - F.col(a)))
    weighted = around.filter(inside).withColumn("_weight", weight).filter("_weight > 0")
    return weighted.groupBy(*grid_keys, *[F.col(f"t{a}").alias(a) for a in VOXEL]).agg(F.round(F.sum(F.col("hu") * F.col("_weight")), digits).alias("value"))


def pair_scores(voxels: DataFrame, grids: DataFrame, a: str, b: str) -> DataFrame:
    """Per volume what the masks of two sides have in common on their common grid; the second one is the reference."""
    sides = grids.filter(F.col("side").isin(a, b))
    both = resample_nearest(voxels.filter(F.col("side").isin(a, b)), sides, common_grid(sides, ["volume"]), ["volume", "side"], ["volume"])
    return overlap(both, a, b)


def extremes(scores: DataFrame, key: str) -> DataFrame:
    """Per group the least Dice and the largest volume difference, whatever its sign; null and NaN count for nothing."""
    known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return scores.groupBy(key).agg(F.min(known("dsc")).alias("min_dsc"), F.max(F.abs(known("rvd"))).alias("max_abs_rvd"))
