"""Sharding by a keyed permutation of global row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .permutation import permutation_sql, permuted, with_row_numbers

SHARDS = 16
SEED = 20240117


def shard_rows(df: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED, partitions: int | None = None) -> DataFrame:
    """Adds ``shard`` (int), ``slot`` (long, gapless from 0 in each shard) and ``global_slot`` (long) to every row.

    Rows are numbered in ``order``; a Feistel network with cycle walking maps the numbers onto themselves, and global
    slot g goes to shard g mod ``shards`` as its slot g div ``shards``. So shard sizes are at most one apart, and where
    a row goes follows from its number, the row count and the seed alone. Nulls in ``order`` come first; rows that
    ``order`` can't tell apart take any of their slots; empty tables give empty results. Columns of ``df`` with the
    added names are replaced. All columns pass through the sort: give it narrow rows and join wide ones by key, or
    let the rows take their text along when they are to be written by shard anyway.
    """
    df = df.drop("shard", "slot", "global_slot")
    parts = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    numbered, n = with_row_numbers(df, order, "_row_number", parts)
    g = F.col("global_slot")
    return (
        numbered.withColumn("global_slot", permuted(F.col("_row_number"), n, seed))
        .withColumns({"shard": (g % shards).cast("int"), "slot": F.floor(g / shards).cast("long")})
        .drop("_row_number")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder for each shard, rows in slot order; a rerun writes the same rows in the same order."""
    sharded.repartition(F.col("shard")).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the law ``rows``; text_crc32 and size come from the whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard_rows(narrow, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


OP2_SQL = f"""
WITH RECURSIVE bits AS (SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
in_bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda v: CAST('0x' || v AS BIGINT)) AS b FROM documents),
d AS (SELECT doc_id, CAST(len(b) + 1 AS BIGINT) AS size,
        CASE WHEN len(b) = 0 THEN 0 ELSE xor(list_reduce(b, lambda a, y: xor(a >> 8, t[CAST(xor(a, y) & 255 AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) END AS text_crc32
      FROM in_bytes, crc_table),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number FROM d),
{permutation_sql("numbered", "SELECT count(*) FROM documents", SEED)}
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(slot % {SHARDS} AS INTEGER) AS shard, CAST(slot // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN slots USING (row_number)
"""
