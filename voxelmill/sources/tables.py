"""Reading and writing tables: Parquet and delimited text in either of two encodings, file listings, and voxel masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file and the schema's columns): results files with a header each, under a folder or one file.

    Each file is read in its own encoding: UTF-8, or Latin-1 where its bytes are no UTF-8. Columns go by the names in the
    file's header; those that a file lacks are null, as are empty cells and cells that can't be cast. Cells hold no line
    ends. Lines are scanned twice, once for what each file's encoding and header are.
    """
    wanted = spark.createDataFrame([], schema).schema
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").cast("binary").alias("_raw"))
    numbered = raw.withColumn("_at", F.monotonically_increasing_id())
    first = F.min(F.struct("_block", "_at"))  # the first line has the least number in the file's first block
    files = numbered.groupBy("file").agg(first.alias("_first"), F.bool_and(F.is_valid_utf8(F.col("_raw").cast("string"))).alias("_utf8"), F.min_by("_raw", F.struct("_block", "_at")).alias("_header"))
    line = lambda c: F.rtrim(F.when(F.col("_utf8"), F.decode(c, "UTF-8")).otherwise(F.decode(c, "ISO-8859-1")), F.lit("\r"))
    widest = files.agg(F.max(F.size(F.split(line(F.col("_header")), ",")))).first()[0] or 1
    cells = ", ".join(f"c{i} string" for i in range(widest))
    cut = lambda text: F.array(*[F.from_csv(text, cells)[f"c{i}"] for i in range(widest)])
    headed = files.select("file", "_utf8", "_header", cut(line(F.col("_header"))).alias("_names"))
    rows = raw.join(headed, "file").filter(F.col("_raw") != F.col("_header")).withColumn("_cells", cut(line(F.col("_raw"))))
    of = lambda f: F.get("_cells", F.array_position("_names", f.name).cast("int") - 1)
    cell = lambda f: F.when(F.array_contains("_names", f.name) & (of(f) != ""), of(f)).try_cast(f.dataType)
    return rows.select("file", *[cell(f).alias(f.name) for f in wanted])


def write_results(rows: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """Results as delimited text with a header, in the frame's column order."""
    rows.write.mode("overwrite").csv(path, header=True, encoding=encoding)


def write_in_order(rows: DataFrame, path: str, *order) -> None:
    """Results as delimited text whose files, by name, and lines are in the order of some columns; no task gets all rows."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").csv(path, header=True)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files under a folder in the order of their paths: path, folder, name, length. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length").orderBy("path")


def count_slices(files: DataFrame) -> DataFrame:
    """Slice files by folder; the suffix is compared without regard to case."""
    return files.filter(F.lower("name").endswith(".dcm")).groupBy("folder").agg(F.count(F.lit(1)).alias("n_slices"))


def write_masks(voxels: DataFrame, path: str) -> None:
    """Sparse masks, one folder for each patient and phase; a rerun replaces what it writes anew."""
    voxels.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("patient", "phase").parquet(path)


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """Masks as sets of voxels: background is no row."""
    return spark.read.parquet(path).filter("value > 0").drop("value")
