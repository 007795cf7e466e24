"""A table of results that batches are put into: a batch's configurations replace those that the table has.

Data lie under ``data/batch=<id>/<key>=<value>`` and are never changed. A manifest says for each key which batch holds it; a
new one appears by one rename, so a reader sees a batch whole or not at all, and a job that fails in between leaves the
table as it was. Running a batch again, with its id, gives the same table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    of = lambda p: context._jvm.org.apache.hadoop.fs.Path(p)
    return of(path).getFileSystem(context._jsc.hadoopConfiguration()), of


def latest(spark: SparkSession, path: str) -> int:
    """The number of the newest manifest, 0 where there is none."""
    files, of = _file_system(spark, path)
    folder = of(f"{path}/manifest")
    if not files.exists(folder):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def manifest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, batch): which batch holds each key's rows."""
    number = latest(spark, path)
    shape = f"`{key}` string, batch string"
    return spark.read.schema(shape).parquet(f"{path}/manifest/{number}") if number else spark.createDataFrame([], shape)


def put(batch: DataFrame, path: str, key: str, batch_id: str) -> int:
    """Puts a batch into the table and gives the number of its manifest. The key is text; rows without one are refused.

    Data of an earlier try with the same id are replaced before the manifest names them. Of two writers at once the
    second one's rename fails: it must run again, on the other's manifest.
    """
    spark = batch.sparkSession
    files, of = _file_system(spark, path)
    number = latest(spark, path) + 1
    keyed = batch.withColumn(key, F.coalesce(F.col(key), F.raise_error(F.lit(f"a row has no {key}")).cast("string")))
    target = f"{path}/data/batch={batch_id}"
    if manifest(spark, path, key).filter(F.col("batch") == batch_id).isEmpty():
        keyed.repartition(key).write.mode("overwrite").partitionBy(key).parquet(target)
    else:  # a rerun: readers may be at its files, so it gets others
        batch_id = f"{batch_id}-{uuid.uuid4().hex[:8]}"
        target = f"{path}/data/batch={batch_id}"
        keyed.repartition(key).write.partitionBy(key).parquet(target)
    new = spark.read.schema(keyed.schema).parquet(target).select(F.col(key)).distinct().withColumn("batch", F.lit(batch_id))
    old = manifest(spark, path, key).join(new, key, "left_anti")
    attempt = f"{path}/manifest/_attempt-{uuid.uuid4().hex}"
    old.unionByName(new).coalesce(1).write.parquet(attempt)
    final = of(f"{path}/manifest/{number}")
    if files.exists(final) or not files.rename(of(attempt), final):
        files.delete(of(attempt), True)
        raise RuntimeError(f"another batch was put into {path} meanwhile")
    return number


def read(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The table's rows, those of each key from the batch that the manifest names; columns that a batch lacks are null."""
    data = spark.read.schema(f"{schema}, batch string").option("basePath", f"{path}/data").parquet(f"{path}/data")
    return data.join(manifest(spark, path, key), [key, "batch"], "left_semi").drop("batch")
