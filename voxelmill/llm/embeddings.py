"""Near-duplicate vectors by cross-polytope hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .arrow import small_batches, with_python_columns
from .components import components, local_labels
from .shared import stored
from .words import mix

THRESHOLD = 0.98
SEED = 11
ROTATIONS = 3
#: Rows of a bucket that are compared with each other in one task; larger buckets are dealt out as pairs of blocks.
BLOCK = 1024
#: A row's bucket should hold about so many rows or fewer by chance.
BY_CHANCE = 16


def hashing_plan(rows: int, dimensions: int) -> tuple[int, int, int]:
    """(tables, hashes in a key, probes in a table).

    More rows take longer keys, so that buckets stay small; longer keys take more probes and tables. At cosine 0.98 and
    64 dimensions a pair meets in one table with probability 0.95 at two hashes, 0.93 at three and 0.86 at four.
    """
    hashes = max(1, math.ceil(math.log(max(rows / BY_CHANCE, 2)) / math.log(2 * max(dimensions, 2))))
    return (4 if hashes <= 3 else 6), hashes, max(2, 4 * (hashes - 1))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, -1, 2, h)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


@lru_cache(maxsize=8)
def signs(hashes: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice([-1.0, 1.0], size=(hashes, ROTATIONS, dimensions))


def vertices(x: np.ndarray, turns: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest vertices of the cross-polytope after a pseudo-random rotation, and how near they are."""
    for s in turns:
        x = hadamard(x * s)
    order = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :most]
    value = np.take_along_axis(x, order, axis=1)
    return order * 2 + (value < 0), np.abs(value)


def bucket_keys(unit: np.ndarray, groups: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """Keys of the rows (n, tables * (1 + probes)): in each table the row's own bucket and the nearest others.

    Other buckets come from a second or third vertex in one hash, or second vertices in two; the smaller the loss in
    nearness, the earlier. ``groups`` are hashed into the keys, so that rows of different groups never meet.
    """
    n, dimensions = unit.shape
    width = 1 << max(1, (dimensions - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dimensions] = unit
    turns = signs(tables * hashes, width)
    ranks = min(4, width)
    singles = [{h: r} for h in range(hashes) for r in range(1, ranks)]
    doubles = [{a: r, b: s} for a in range(hashes) for b in range(a + 1, hashes) for r in (1, 2) for s in (1, 2) if max(r, s) < ranks]
    options = singles + doubles
    out = np.empty((n, tables * (1 + probes)), np.int64)
    for table in range(tables):
        found = [vertices(padded, turns[table * hashes + h], ranks) for h in range(hashes)]
        loss = np.stack([sum((found[h][1][:, 0] - found[h][1][:, r]) ** 2 for h, r in o.items()) for o in options], axis=1)
        keys = np.empty((n, 1 + len(options)), np.uint64)
        for at, option in enumerate([{}, *options]):
            key = groups.astype(np.uint64) + np.uint64(table + 1)
            for h in range(hashes):
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + found[h][0][:, option.get(h, 0)].astype(np.uint64))
            keys[:, at] = key
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes] + 1
        if best.shape[1] < probes:  # few dimensions have few other buckets
            best = np.pad(best, ((0, 0), (0, probes - best.shape[1])))
        own = table * (1 + probes)
        out[:, own] = keys[:, 0].view(np.int64)
        out[:, own + 1 : own + 1 + probes] = np.take_along_axis(keys, best, axis=1).view(np.int64)
    return out


def first_meeting(a: np.ndarray, b: np.ndarray, tables: int) -> np.ndarray:
    """For pairs of rows' keys: the smallest key of the first table in which one row's own bucket is among the other's."""
    per = a.shape[1] // tables
    none = np.iinfo(np.int64).max
    out = np.full(len(a), none)
    for table in range(tables):
        x, y = a[:, table * per : (table + 1) * per], b[:, table * per : (table + 1) * per]
        here = np.full(len(a), none)
        for i in range(per):
            for own, other in ((x[:, 0], y[:, i]), (y[:, 0], x[:, i])):
                here = np.where((own == other) & (own < here), own, here)
        out = np.where(out == none, here, out)
    return out


def links_in_bucket(key: int, block: np.ndarray, unit: np.ndarray, keys: np.ndarray, tables: int, threshold: float, split: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a bucket's rows with enough cosine that meet here first; of two blocks, only pairs between them."""
    if split:
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        i, j = np.nonzero(unit[left] @ unit[right].T >= threshold)
        i, j = left[i], right[j]
    else:
        i, j = np.nonzero(np.triu(unit @ unit.T >= threshold, 1))
    meets = first_meeting(keys[i], keys[j], tables) == key
    return i[meets], j[meets]


def bucket_links(rows: DataFrame, tables: int, threshold: float) -> DataFrame:
    """(id, links, root) from rows dealt and sorted by bucket: links of a row in a bucket, and the smallest id they lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            plain = [table.column(c).to_numpy() for c in ("key", "low", "high")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in plain], axis=0)) + 1
            done = int(cuts[-1]) if len(cuts) else 0
            rest = table.slice(done)
            yield from compare(table.slice(0, done), [0, *cuts.tolist()])
        if rest is not None and len(rest):
            yield from compare(rest, [0, len(rest)])

    def compare(table: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        if not len(table):
            return
        key, low, high, block, ids, copies = (table.column(c).to_numpy() for c in ("key", "low", "high", "block", "id", "copies"))
        vectors, keys = (np.array(table.column(c).combine_chunks().flatten().to_numpy()) for c in ("embedding", "keys"))
        lengths = table.column("dimensions").to_numpy()
        starts = np.concatenate(([0], np.cumsum(lengths)))
        keys = keys.reshape(len(table), -1)
        found = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo < 2:
                continue
            x = vectors[starts[lo] : starts[hi]].astype(np.float64).reshape(hi - lo, -1)
            x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            i, j = links_in_bucket(key[lo], block[lo:hi], x, keys[lo:hi], tables, threshold, low[lo] != high[lo])
            if len(i):
                mine, n = ids[lo:hi], copies[lo:hi]
                links = np.bincount(i, n[j], hi - lo) + np.bincount(j, n[i], hi - lo)
                nodes, root = local_labels(mine[i], mine[j])
                order = np.argsort(mine)
                at = order[np.searchsorted(mine, nodes, sorter=order)]
                found.append((nodes, links[at].astype(np.int64), root))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["id", "links", "root"])

    return small_batches(rows).mapInArrow(run, "id long, links long, root long")


def near_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``df``: (vec_id, n_links, component_id, kept).

    Rows are compared when their labels are equal and not null and their vectors equally long. Vectors that are null,
    empty, zero or hold nulls or non-finite numbers link with nothing, nor do rows without an id (whose component is
    null). Equal vectors are hashed once and counted as often as they stand there. Every pair of buckets' rows that meet
    is tested, in blocks; a pair that meets in several buckets counts in the first. So pairs are never written out:
    tasks return each row's number of links and the smallest id that they lead to.
    """
    x = F.col("embedding")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), (F.col(label) if label else F.lit(0)).alias("label"))
    # very large or small vectors are scaled by a power of two, which changes no cosine, so that squares stay finite
    largest = F.array_max(F.transform(x, F.abs))
    factor = F.when(largest > 1e100, F.lit(2.0**-600)).when(largest < 1e-100, F.lit(2.0**600)).otherwise(F.lit(1.0))
    rows = rows.withColumn("embedding", F.transform(x, lambda v: v * factor))
    squares = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((squares > 0) & (squares < float("inf")) & ~F.isnan(squares), F.lit(False))
    distinct = rows.filter(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    distinct = stored(distinct.withColumn("dimensions", F.size("embedding").cast("long")), "vectors")
    total, dimensions = distinct.agg(F.count(F.lit(1)), F.max("dimensions")).first()
    tables, hashes, probes = hashing_plan(total, dimensions or 1)

    def hashed(vectors: list[list[float]], groups: list[int]) -> list[list]:
        out: list = [None] * len(vectors)
        by_length: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_length.setdefault(len(v), []).append(i)
        for at in by_length.values():
            unit = np.array([vectors[i] for i in at])
            unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
            own = np.array([groups[i] for i in at], dtype=np.int64).view(np.uint64)
            for i, keys in zip(at, bucket_keys(unit, own, tables, hashes, probes), strict=True):
                out[i] = keys
        return [out]

    grouped = distinct.withColumn("group", F.xxhash64("label", "dimensions"))
    keyed = with_python_columns(grouped, ["embedding", "group"], StructType([StructField("keys", ArrayType(LongType()))]), hashed)
    keyed = stored(keyed, "vector-keys")
    places = keyed.select("id", F.posexplode("keys").alias("at", "key")).withColumn("own", (F.col("at") % (1 + probes) == 0).cast("int"))
    met = places.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("own").alias("any_own")).filter("rows > 1 AND any_own = 1")
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    members = places.join(met, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id"
    )
    whole = dealt.distinct().join(keyed.select("id", "copies", "dimensions", "embedding", "keys"), "id")
    order = ["key", "low", "high"]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_rows = whole.repartition(parts, *order).sortWithinPartitions(*order, "block", "id")
    found = stored(bucket_links(sorted_rows, tables, threshold), "vector-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = (
        distinct.join(counts, "id", "left")
        .join(reached, distinct["id"] == reached["node"], "left")
        .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    )
    joined = rows.withColumn("usable", usable).alias("r").join(classes.alias("c"), F.col("r.usable") & (F.col("r.label") == F.col("c.label")) & (F.col("r.embedding") == F.col("c.embedding")), "left")
    component = F.coalesce(F.col("c.component"), F.col("r.vec_id"))
    return joined.select("r.vec_id", F.coalesce(F.col("c.n"), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("r.vec_id") == component, F.lit(False)).alias("kept"))


def op9_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
