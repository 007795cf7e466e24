"""Exact self-join of documents by Jaccard similarity of their word n-grams, with set-relation skipping.

Sets become lists ordered from rare to frequent n-grams; only each list's beginning is indexed, with positions. Index
lists are skipped where positions can't reach the threshold any more. In every index list one set, whose shared n-gram
stands earliest, leads: it is compared with the list's others first, and what sets it apart from them is kept. Two other
sets of the list are then not compared if both already belong together, and else their overlap follows from what sets
each apart from the leader.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches, stretches
from .components import components
from .shared import dropped, stored
from .words import mix, shingle_hashes, text_batches, word_table

WORDS = 3
PERCENT = 90
#: N-grams are ordered by counts of their hash buckets, of which there are always so many.
SKETCH_BITS, SLICES = 20, 64
#: Bits of a set's parity map; two maps differ in at most as many bits as the sets in members.
PARITY_BITS = 1024
#: So many 64-bit parts of the map, each folded from several, go along with index rows.
FOLDED = 4


def word_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """Every text's sorted distinct k-word n-grams as hashes; all its words as one if it has fewer; none without words."""
    for lo, hi in text_batches(texts):
        hashes, first, *_ = word_table(texts[lo:hi], lower=True)
        for i in range(hi - lo):
            yield np.unique(shingle_hashes(hashes[first[i] : first[i + 1]], k))


def digest(tokens: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(mix(np.array([mix(tokens ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(tokens))])).view(np.int64)[0])


def parity_map(tokens: np.ndarray) -> np.ndarray:
    odd = np.bincount((tokens >> np.uint64(40)).astype(np.int64) & (PARITY_BITS - 1), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


SET_FIELDS = "doc_id long, n int, x long, parity array<long>, slice int, counts binary"


def measured_sets(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document (doc_id, n, x, parity), and for each task SLICES rows (slice, counts) with its bucket counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("x", pa.int64()), ("parity", pa.list_(pa.int64())), ("slice", pa.int32()), ("counts", pa.binary())])
        for ids, texts in stretches(batches, ["doc_id", "text"]):
            sets = list(word_sets(texts, k))
            for s in sets:
                np.add.at(counts, bucket(s), 1)
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip((ids, [len(s) for s in sets], [digest(s) for s in sets], [parity_map(s) for s in sets], none, none), schema.types, strict=True)], schema=schema
            )
        none = [None] * SLICES
        packed = [zlib.compress(part.tobytes(), 1) for part in np.split(counts, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((none, none, none, none, list(range(SLICES)), packed), schema.types, strict=True)], schema=schema)

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, SET_FIELDS)


def total_counts(partial: DataFrame) -> np.ndarray:
    """The sum of all tasks' bucket counts: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for (slices, packed) in stretches(batches, ["slice", "counts"]):
            for at, data in zip(slices, packed, strict=True):
                part = np.frombuffer(zlib.decompress(data), np.uint32).astype(np.uint64)
                sums[at] = part if at not in sums else sums[at] + part
        for at, part in sums.items():
            whole = np.minimum(part, np.iinfo(np.uint32).max).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([whole.tobytes()], pa.binary())], names=["slice", "counts"])

    summed = partial.repartition(SLICES, "slice").mapInArrow(run, "slice int, counts binary").collect()  # SLICES rows, 4 MB together
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    width = len(counts) // SLICES
    for row in summed:
        counts[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["counts"], np.uint32)
    return counts


def prefix_rows(docs: DataFrame, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(token, x, n, at): the beginnings of all sets ordered by frequency, where two linked sets must share an n-gram.

    A set of n has to share at least percent of n with a linked one, so n less that, plus one, n-grams are enough. Copies
    of a set within a stretch of a task give one set of rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for (texts,) in stretches(batches, ["text"]):
            tokens, owners, sizes, places, seen = [], [], [], [], set()
            for s in word_sets(texts, k):
                x, n = digest(s), len(s)
                if not n or x in seen:
                    continue
                seen.add(x)
                length = n + 1 - -(-n * percent // 100)
                often = table[bucket(s)]
                if length < n:  # only the beginning is put in order
                    near = np.argpartition(often, length - 1)
                    limit = often[near[length - 1]]
                    low = np.flatnonzero(often <= limit)
                    order = low[np.lexsort((s[low], often[low]))][:length]
                else:
                    order = np.lexsort((s, often))[:length]
                tokens.append(s[order])
                owners.append(np.full(length, x, np.int64))
                sizes.append(np.full(length, n, np.int32))
                places.append(np.arange(length, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ([t.view(np.int64) for t in tokens], owners, sizes, places)], names=["token", "x", "n", "at"])

    return small_batches(docs.select("text")).mapInArrow(run, "token long, x long, n int, at int")


def apart_allowed(differing: Column, sizes: Column, percent: int) -> Column:
    """Whether sets of these sizes together may differ in so many members and still be linked."""
    return differing.cast("long") * (100 + percent) <= sizes.cast("long") * (100 - percent)


def folded_parity(part: int) -> Column:
    words = [F.col("parity")[i] for i in range(part, PARITY_BITS // 64, FOLDED)]
    out = words[0]
    for word in words[1:]:
        out = out.bitwiseXOR(word)
    return out


def sets_of(docs: DataFrame, wanted: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(x, members) of the wanted sets, made from the texts of the documents that stand for them."""
    ids = classes.join(wanted, "x", "left_semi").select("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in stretches(batches, ["text"]):
            sets = list(word_sets(texts, k))
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["x", "members"])

    made = small_batches(docs.select("doc_id", "text").join(ids.distinct(), "doc_id", "left_semi")).mapInArrow(run, "x long, members binary")
    return stored(made, "sets").dropDuplicates(["x"])


COMPARED = "a long, b long, differing int, sizes int, apart array<long>"


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with the number of members in only one of the two, and those members where they are not too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, left, right in stretches(batches, ["a", "b", "left", "right"]):
            differing, sizes, apart = [], [], []
            for s, t in zip(left, right, strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                only = np.setxor1d(s, t, assume_unique=True)
                differing.append(len(only))
                sizes.append(len(s) + len(t))
                # two sets that far from a leader can't be linked through it more cheaply than directly
                apart.append(only.view(np.int64) if 2 * len(only) <= len(s) + len(t) else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(differing, pa.int32()), pa.array(sizes, pa.int32()), pa.array(apart, pa.list_(pa.int64()))],
                names=["a", "b", "differing", "sizes", "apart"],
            )

    left, right = (sets.select(F.col("x").alias(c), F.col("members").alias(m)) for c, m in (("a", "left"), ("b", "right")))
    return small_batches(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")).mapInArrow(run, COMPARED)


def near_by_parity(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Drops pairs (a, b) whose parity maps differ in more bits than linked sets may have members apart."""
    left, right = (classes.select(F.col("x").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}")) for c in ("a", "b"))
    bits = F.aggregate(F.zip_with("p_a", "p_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return pairs.join(left, "a").join(right, "b").filter(apart_allowed(bits, F.col("n_a") + F.col("n_b"), percent)).drop("n_a", "n_b", "p_a", "p_b")


def similar_sets(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document, from whole texts.

    Words are runs of other than space and 0x09 to 0x0D, with A-Z lower-cased. Documents link when 100 * intersection >=
    percent * union of their sets of k-word n-grams; component_id is the smallest doc_id to be reached by links. Texts
    that are null or have no words have no set and no links. Equal sets are one class, found by their digests, and only
    classes are joined. Documents without id are in no class: their component is null. N-grams and sets are known by 64
    bits. Nothing is capped: all index lists are joined, and lists of any length are split by the join.
    """
    found = stored(measured_sets(docs, k), "measured-sets")
    counts = total_counts(found.filter("slice IS NOT NULL").select("slice", "counts"))
    measured = found.filter("slice IS NULL").select("doc_id", "n", "x", "parity")
    classes = measured.filter("n > 0 AND doc_id IS NOT NULL").groupBy("x").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    classes = stored(classes.select("*", *[folded_parity(i).alias(f"f{i}") for i in range(FOLDED)]), "classes")
    rows = stored(prefix_rows(docs.filter("doc_id IS NOT NULL"), k, percent, counts), "prefixes")
    # most n-grams stand in one row: they go, by their hashes and numbers alone, before whole rows are gathered into lists
    several = rows.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("token")
    shared = stored(rows.join(several, "token", "left_semi").distinct(), "shared-rows")
    dropped(rows)
    lists = shared.groupBy("token").agg(F.min(F.struct("at", "n", "x")).alias("leader"), F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    members = stored(shared.join(lists.select("token", "leader"), "token"), "members")
    dropped(shared)

    def may_link(n1: str, at1: str, n2: str, at2: str) -> Column:
        """What sizes and positions of a pair's first shared n-gram allow: all before it in either list is not shared."""
        sizes = F.col(n1).cast("long") + F.col(n2)
        return (F.least(n1, n2).cast("long") * 100 >= F.greatest(n1, n2).cast("long") * percent) & apart_allowed(F.col(at1) + F.col(at2), sizes, percent)

    to_leader = members.filter((F.col("x") != F.col("leader.x")) & may_link("n", "at", "leader.n", "leader.at"))
    stars = to_leader.select(F.col("leader.x").alias("a"), F.col("x").alias("b")).distinct()
    stars = stored(near_by_parity(stars, classes, percent), "stars")
    sets = sets_of(docs, stars.select(F.explode(F.array("a", "b")).alias("x")).distinct(), classes, k)
    answers = stored(compared(stars, sets, percent), "answers")
    linked = apart_allowed(F.col("differing"), F.col("sizes"), percent)
    links = answers.filter(linked).select("a", "b")
    together = stored(components(links), "together")
    folds = [f"f{i}" for i in range(FOLDED)]
    about = classes.join(together, classes["x"] == together["node"], "left").select("x", F.coalesce("component", "x").alias("group"), *folds)
    named = members.withColumn("lead", F.col("leader.x")).join(about, "x")
    named = stored(named.select("token", "lead", "x", "n", "at", "group", *folds), "lists")
    dropped(members)
    # of a list, the sets that one leader has already linked are a block; blocks that no other can meet, by size and
    # position, are skipped whole
    blocks = named.groupBy("token", "group").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("at").alias("at"))
    several = blocks.groupBy("token").agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1").select("token")
    blocks = stored(blocks.join(several, "token"), "blocks")
    other = blocks.select(F.col("token").alias("token_b"), F.col("group").alias("group_b"), F.col("least").alias("least_b"), F.col("most").alias("most_b"), F.col("at").alias("at_b"))
    fits = (F.col("most").cast("long") * 100 >= F.col("least_b").cast("long") * percent) & (F.col("most_b").cast("long") * 100 >= F.col("least").cast("long") * percent)
    near = apart_allowed(F.col("at") + F.col("at_b"), F.col("most").cast("long") + F.col("most_b"), percent)
    meeting = blocks.join(other, (F.col("token") == F.col("token_b")) & (F.col("group") != F.col("group_b")) & fits & near, "left_semi").select("token", "group")
    open_lists = stored(named.join(stored(meeting, "meeting-blocks"), ["token", "group"], "left_semi"), "open-lists")
    dropped(named, blocks)
    carried = ("x", "n", "at", "group", *folds)
    left = open_lists.select("token", "lead", *[F.col(c).alias(f"{c}_a") for c in carried])
    right = open_lists.select(F.col("token").alias("token_b"), *[F.col(c).alias(f"{c}_b") for c in carried])
    bits = sum((F.bit_count(F.col(f"{f}_a").bitwiseXOR(F.col(f"{f}_b"))) for f in folds[1:]), F.bit_count(F.col("f0_a").bitwiseXOR(F.col("f0_b"))))
    apart = (F.col("x_a") < F.col("x_b")) & (F.col("group_a") != F.col("group_b")) & may_link("n_a", "at_a", "n_b", "at_b")
    pairs = left.join(right, (F.col("token") == F.col("token_b")) & apart & apart_allowed(bits, F.col("n_a") + F.col("n_b"), percent))
    others = pairs.filter((F.col("x_a") != F.col("lead")) & (F.col("x_b") != F.col("lead"))).groupBy(F.col("x_a").alias("a"), F.col("x_b").alias("b")).agg(F.min("lead").alias("lead"))
    others = stored(near_by_parity(others, classes, percent), "others")
    dropped(open_lists)
    # what sets both apart from their leader tells what sets them apart from each other
    known = answers.filter("apart IS NOT NULL").select(F.col("a").alias("lead"), F.col("b").alias("member"), "apart")
    sizes = classes.select("x", "n")
    derived = (
        others.join(known.select("lead", F.col("member").alias("a"), F.col("apart").alias("from_a")), ["lead", "a"], "left")
        .join(known.select("lead", F.col("member").alias("b"), F.col("apart").alias("from_b")), ["lead", "b"], "left")
        .join(sizes.select(F.col("x").alias("a"), F.col("n").alias("n_a")), "a")
        .join(sizes.select(F.col("x").alias("b"), F.col("n").alias("n_b")), "b")
    )
    derived = stored(derived, "derived")
    both = F.size("from_a") + F.size("from_b") - 2 * F.size(F.array_intersect("from_a", "from_b"))
    by_leader = derived.filter("from_a IS NOT NULL AND from_b IS NOT NULL").filter(apart_allowed(both, F.col("n_a") + F.col("n_b"), percent)).select("a", "b")
    rest = stored(derived.filter("from_a IS NULL OR from_b IS NULL").select("a", "b"), "rest")
    rest_sets = sets_of(docs, rest.select(F.explode(F.array("a", "b")).alias("x")).distinct(), classes, k)
    directly = compared(rest, rest_sets, percent).filter(linked).select("a", "b")
    all_links = stored(links.unionByName(by_leader).unionByName(directly), "all-links")
    name_a, name_b = (classes.select(F.col("x").alias(c), F.col("doc_id").alias(f"doc_{c}")) for c in ("a", "b"))
    reached = components(all_links.join(name_a, "a").join(name_b, "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")))
    places = classes.join(reached, classes["doc_id"] == reached["node"], "left").select("x", F.coalesce("component", "doc_id").alias("component"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return measured.join(places, "x", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
