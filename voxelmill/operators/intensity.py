"""Intensities: rescaling, windows and percentiles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Level and width of the usual windows, in Hounsfield units.
WINDOWS = {"abdomen": (40, 400), "liver": (60, 150), "lung": (-600, 1500), "bone": (400, 1800), "soft_tissue": (50, 350)}


def to_hu(value: Column, slope: Column, intercept: Column) -> Column:
    """Stored values to Hounsfield units; a missing slope is 1, a missing intercept 0."""
    return value * F.coalesce(slope, F.lit(1.0)) + F.coalesce(intercept, F.lit(0.0))


def windowed(hu: Column, level: float, width: float) -> Column:
    """0 to 255 over a window, cut to integers; values outside are set to its ends."""
    low, high = level - width / 2, level + width / 2
    return ((F.greatest(F.lit(low), F.least(F.lit(high), hu)) - low) / (high - low) * 255).cast("int")


def window_levels(rows: DataFrame, key: str, value: str, preset: str | None = None) -> DataFrame:
    """``rows`` with lower, upper, level and pixel: values cut to a window and stretched from 0 to 255 by volume.

    The window is the preset's; for another name, or none, it is the volume's mean less and plus two standard
    deviations. What is stretched is what is left after cutting, from the least to the most that the volume has; pixels
    are levels cut to integers, and a volume of one value only has 0. Null values stay null and count for nothing.
    """
    stats = rows.groupBy(key).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_spread"), F.min(value).alias("_least"), F.max(value).alias("_most"))
    if preset in WINDOWS:
        centre, width = WINDOWS[preset]
        lower, upper = F.lit(centre - width / 2), F.lit(centre + width / 2)
    else:
        lower, upper = F.col("_mean") - 2 * F.col("_spread"), F.col("_mean") + 2 * F.col("_spread")
    cut = lambda v: F.when(v.isNotNull(), F.greatest("lower", F.least("upper", v)))
    bounds = stats.select(F.col(key).alias("_key"), lower.alias("lower"), upper.alias("upper"), "_least", "_most").select("_key", "lower", "upper", cut(F.col("_least")).alias("_low"), cut(F.col("_most")).alias("_high"))
    joined = rows.drop("lower", "upper", "level", "pixel").join(bounds, F.col(key).eqNullSafe(F.col("_key")))
    level = (cut(F.col(value)) - F.col("_low")) / (F.col("_high") - F.col("_low") + 1e-12) * 255
    return joined.withColumn("level", level).withColumn("pixel", F.col("level").cast("int")).drop("_key", "_low", "_high")


def slice_height(position: Column, location: Column) -> Column:
    """A slice's height: the third number of its position if that can be read, else its location, else null."""
    return F.coalesce(F.try_element_at(position, F.lit(3)).try_cast("double"), location.try_cast("double"))


def percentiles(rows: DataFrame, key: str, value: str, shares=(0.01, 0.99)) -> DataFrame:
    names = [f"p{round(s * 100):02d}" for s in shares]
    return rows.groupBy(key).agg(*[F.expr(f"percentile({value}, {s})").alias(n) for s, n in zip(shares, names, strict=True)])
