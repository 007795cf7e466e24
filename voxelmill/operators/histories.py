"""Convergence histories: running bests and summaries of (run, idx, loss, dsc)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_best(history: DataFrame) -> DataFrame:
    """Adds the best loss and the best Dice so far."""
    so_far = Window.partitionBy("run").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return history.withColumns({"best_loss": F.min("loss").over(so_far), "best_dsc": F.max("dsc").over(so_far)})


def summary(history: DataFrame) -> DataFrame:
    """Per run the first, last and least loss, the best Dice, how many different Dice values there were, and the loss a fifth of the way in."""
    places = history.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("run")))
    return places.groupBy("run").agg(
        F.min_by("loss", "idx").alias("first_loss"),
        F.max_by("loss", "idx").alias("last_loss"),
        F.min("loss").alias("min_loss"),
        F.max("dsc").alias("max_dsc"),
        F.count_distinct("dsc").alias("n_dsc"),
        F.max(F.when(F.col("idx") == F.floor(F.col("n") / 5), F.col("loss"))).alias("reference_loss"),
    )
