"""What a pose is worth: the losses of laying a moving mask onto a fixed one, for many pairs and poses at once, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored
from .fields import soft_dice_of, warp_cubic
from .geometry import warp_binary
from .masks import VOXEL, overlap, surface_distances, surface_metrics

#: Losses by name; the lower the better.
LOSSES = ("dsc", "soft_dice", "assd", "hd95")
#: The surface losses of a pose that takes the moving mask out of the grid.
PENALTY = 1e6


def pose_losses(masks: DataFrame, matrices: DataFrame, shape: tuple[int, int, int], spacing: tuple[float, float, float], fixed: str, moving: str, names: tuple[str, ...] = LOSSES) -> DataFrame:
    """(volume, pose, and a column for each loss named): every pose of every volume scored.

    ``masks`` has volume, side, z, y, x; ``matrices`` (of ``with_matrix``) volume and pose. Overlap and surfaces are those of
    the thresholded warp, soft Dice that of the cubic one. Where nothing of the moving mask is left, Dice loss is 1 and
    surface losses are ``PENALTY``. Volumes that lack a mask have no rows; an unknown name is an error.
    """
    if unknown := set(names) - set(LOSSES):
        raise ValueError(f"unknown losses: {', '.join(sorted(unknown))}")
    pair = F.to_json(F.struct("volume", "pose"))
    goal, other = (masks.filter(F.col("side") == s).select("volume", *VOXEL) for s in (fixed, moving))
    whole = goal.select("volume").distinct().join(other.select("volume").distinct(), "volume", "left_semi")
    poses = matrices.join(whole, "volume", "left_semi")
    named = poses.select("volume", "pose", pair.alias("pair"))
    goals = goal.join(named, "volume").select(F.col("pair").alias("volume"), F.lit("fixed").alias("side"), *VOXEL)
    found = named
    if set(names) - {"soft_dice"}:
        moved = warp_binary(other, poses, ["volume"], ["volume", "pose"], shape).select(pair.alias("volume"), F.lit("moving").alias("side"), *VOXEL)
        both = stored(goals.unionByName(moved), "posed")
        if "dsc" in names:
            found = found.join(overlap(both, "fixed", "moving").select(F.col("volume").alias("pair"), F.col("dsc_loss").alias("dsc")), "pair", "left")
        if surfaces := [n for n in ("assd", "hd95") if n in names]:
            far = surface_metrics(surface_distances(both, "fixed", "moving", spacing)).select(F.col("volume").alias("pair"), *surfaces)
            found = found.join(far, "pair", "left").fillna(PENALTY, surfaces)
    if "soft_dice" in names:
        moved = warp_cubic(other.withColumn("value", F.lit(1.0)), poses, ["volume"], ["volume"], shape).filter("value <> 0")
        fields = goals.withColumn("value", F.lit(1.0)).unionByName(moved.select(pair.alias("volume"), F.lit("moving").alias("side"), *VOXEL, "value"))
        found = found.join(soft_dice_of(fields, "fixed", "moving", shape).select(F.col("volume").alias("pair"), F.col("soft_dice_loss").alias("soft_dice")), "pair", "left")
    return found.select("volume", "pose", *names)
