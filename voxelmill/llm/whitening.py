"""Whitening of vectors: exact integer sums, covariance by a distributed Gramian of exactly centred rows, local eigenvectors.

Entries become integers first, so sums and deviations from n times the mean are exact; only then are doubles made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import small_batches
from .shared import stored

#: An entry c becomes floor(STEPS * c) + OFFSET.
STEPS, OFFSET = 64, 1_000_000


@dataclass
class Whitening:
    """What is learnt from n vectors: sums by dimension, and per component its axis (a column), eigenvalue and share of all variance."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def finite_only(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector isn't null, isn't empty, and holds finite numbers only."""
    return vectors.filter(F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda c: F.coalesce(finite(c), F.lit(False))))


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))


def as_integers(column: str) -> Column:
    """Entries as integers; null where they aren't finite, since filters may come to be tested after this."""
    return F.transform(column, lambda c: F.when(finite(c), F.floor(c.cast("double") * STEPS) + OFFSET))


def gramian(rows: DataFrame, column: str, n: int, width: int) -> np.ndarray:
    """The sum of the outer products of all rows' arrays of doubles."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, n, width).computeGramianMatrix().toArray()


def fit(vectors: DataFrame, column: str, most: int) -> Whitening | None:
    """Learns up to ``most`` components from all rows of ``finite_only``; None without rows.

    Vectors of several lengths are refused. The driver gets a sum for each dimension and a square matrix of them. Components
    without variance (rounding aside) don't count: they can't be whitened.
    """
    whole = vectors.select(as_integers(column).alias("x"))
    sums = whole.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.count("c").alias("n"), F.sum("c").alias("s")).orderBy("at").collect()
    if not sums:
        return None
    n, width = sums[0]["n"], len(sums)
    if any(row["n"] != n for row in sums):
        raise ValueError("vectors must all have one length")
    total = F.array(*[F.lit(row["s"]) for row in sums])
    centred = whole.select(F.zip_with("x", total, lambda x, s: (x * F.lit(n).cast("long") - s).cast("double") / F.lit(float(n))).alias("x"))
    covariance = gramian(centred, "x", n, width) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > width * np.finfo(float).eps * max(values.max(), 0.0)]
    axes = axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)  # one sign whatever the library gives
    return Whitening(n, np.array([row["s"] for row in sums], np.int64), axes, values[order], values[order] / np.trace(covariance))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, list[Decimal]]:
    """n x - sums as doubles, and its exact squared length, for each row."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62 and int(np.abs(sums).max(initial=0)) < 1 << 62:
        off = x * n - sums
        if int(np.abs(off).max(initial=0)) ** 2 * max(1, off.shape[1]) < 1 << 63:
            return off.astype(float), [Decimal(v) for v in (off * off).sum(axis=1).tolist()]
    exact = x.astype(object) * n - sums.astype(object)
    return exact.astype(float), [Decimal(int(v)) for v in (exact * exact).sum(axis=1)]


def whitened(vectors: DataFrame, column: str, model: Whitening) -> DataFrame:
    """Each row of ``finite_only`` without its vector, with ``deviation`` (the exact squared length of n x - sums, decimal)
    and ``whitened`` (an array of doubles, an entry for each component). Columns of these names are replaced."""
    kept = [c for c in vectors.columns if c not in (column, "deviation", "whitened")]
    given = small_batches(vectors.select(*kept, as_integers(column).alias(column)))
    learnt = vectors.sparkSession.sparkContext.broadcast((model.n, model.sums, model.axes / np.sqrt(model.values)))  # dimensions x components

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, projection = learnt.value
        for frame in frames:
            if len(frame):
                off, exact = deviations(np.stack(frame[column].to_numpy()), n, sums)
                yield frame[kept].assign(deviation=exact, whitened=list(off / n @ projection))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name in kept), "deviation decimal(38, 0)", "whitened array<double>"])
    return given.mapInPandas(run, schema)


def identity_error(rows: DataFrame, column: str, n: int, width: int) -> float:
    """The largest absolute entry of the covariance of arrays of doubles (divisor n, centred first) minus the identity."""
    means = rows.select(F.posexplode(column).alias("at", "c")).groupBy("at").agg(F.avg("c").alias("mean")).orderBy("at").collect()
    centred = rows.select(F.zip_with(column, F.array(*[F.lit(row["mean"]) for row in means]), lambda c, m: c - m).alias("w"))
    return float(np.abs(gramian(centred, "w", n, width) / n - np.eye(width)).max())


def whiten(vectors: DataFrame, column: str, keys: list[str], most: int = 32) -> DataFrame:
    """(keys, component, n, deviation, whitened, explained, identity_error): a row for each vector and component, from 1 by falling variance.

    Rows whose vector is null, empty or holds null, NaN or infinite entries are dropped; all others are fitted on and
    returned, repeated rows as often as they come. Components without variance have no rows: one vector, or equal
    vectors only, give none, as does an empty table. Columns other than ``keys`` aren't read.
    """
    sound = finite_only(vectors.select(*keys, column), column)
    model = fit(sound, column, most)
    width = 0 if model is None else len(model.values)
    if not width:
        kinds = {"component": "int", "n": "long", "deviation": "decimal(38, 0)", "whitened": "double", "explained": "double", "identity_error": "double"}
        return vectors.select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()]).limit(0)
    rows = stored(whitened(sound, column, model), "whitened")
    error = identity_error(rows, "whitened", model.n, width)
    shares = F.array(*map(F.lit, model.explained.tolist()))
    long = rows.select(*keys, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        *keys,
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings`` whitened to up to 32 components; nulls and equal vectors as in ``whiten``. A deviation beyond a long fails the query."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", ["vec_id"]).withColumn("deviation", F.col("deviation").cast("long"))
