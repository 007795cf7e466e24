"""Mixing sources to target weights with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import freed
from .shared import stored

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = "mix-1"
#: A word of the contract; split positions stand between a word and the white space after it.
WORD = r"[^\x20\x09-\x0D]+"
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, WORD_END), F.lit(1), n.cast("int")), "")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Targets by source, from a table (source, source_size).

    Sources in code point order, null last, get ``weights`` in turn. Together they get the size of all. A source stops
    at ``most_epochs`` times its size and the rest is reshared by weight until none is above. That fixed point is where
    each gets min(level * weight, cap): with sources ordered by cap / weight, the level follows from prefix sums.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    level = (F.col("budget") - F.col("capped_before")) / F.col("weight_from")
    levels = caps.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("budget"),
        (F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).alias("capped_before"),
        F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("weight_from"),
        F.row_number().over(by_ratio).alias("place"),
    )
    # the first source whose cap isn't reached sets the level
    open_level = F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct("place", level.alias("level")))).over(everything)
    target = F.least(F.col("cap"), open_level["level"] * F.col("weight"))
    return levels.withColumn("target", F.coalesce(target, F.col("cap"))).select("source", "source_size", "target")


def mix_plan(docs: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """How many words of each document the mix takes: (doc_id, source, size, source_size, target, taken).

    Documents get hash-random keys. Each source is cut into ranges of its keys, about as many as the square root of its
    rows, so that a source with a third of all rows is spread as evenly as the others. Sums by range, their prefix sums
    and the running sums within a range give each document's place in its source. A source's target, rounded down to
    words, is whole epochs of all its documents and then the first documents by key, of which the last is taken up to
    the exact budget. Null sources are a source, null texts have no words, documents without words are never taken,
    repeated rows count each, and an empty table gives an empty plan.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    measured = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("key", key), "mix-sizes")
    totals = measured.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    targets = source_targets(totals.select("source", "source_size"), weights, most_epochs)
    sources = stored(
        targets.alias("t").join(totals.alias("n"), F.col("t.source").eqNullSafe(F.col("n.source"))).select("t.*", F.ceil(F.sqrt("n.source_rows")).cast("long").alias("ranges")),
        "mix-sources",
    )
    # 32 bits of the key, scaled to the source's number of ranges
    top = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = (
        measured.alias("d")
        .join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("d.*", "s.source_size", "s.target", F.shiftright(top * F.col("s.ranges"), 32).alias("key_range"))
    )
    group = ["source", "key_range"]
    range_sums = placed.groupBy(*group).agg(F.sum("size").alias("range_size"))
    before = F.sum("range_size").over(Window.partitionBy("source").orderBy("key_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("range_size")
    starts = range_sums.select(*group, before.alias("range_start"))
    inside = F.sum("size").over(Window.partitionBy(*group).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    running = placed.withColumn("inside", inside)
    joined = running.alias("r").join(starts.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.key_range") == F.col("b.key_range"))).select("r.*", "b.range_start")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    before_doc = F.col("range_start") + F.col("inside") - F.col("size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest - before_doc))
    return joined.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + extra).cast("long").alias("taken"))


#: Columns that ``mix`` adds on its way.
OWN_COLUMNS = ("_id", "_source", "_size", "_taken", "_turn", "_words", "_epoch", "_id_again", "_source_again", "_size_again")


def mix(docs: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed corpus: documents repeated once for each epoch that takes them, the last repetition cut to its words.

    Needs doc_id, text and source. All columns are kept, text is the part taken. Rows that repeat an id within a source
    and have as many words share what is planned for them, the largest share first, in order of their texts; so each
    source's budget holds whatever ids are repeated. Null ids are one such id. Other columns may have any names.
    """
    docs, back = freed(docs, OWN_COLUMNS)
    plan = stored(mix_plan(docs, weights, most_epochs, seed).select("doc_id", "source", "size", "taken"), "mix-plan")
    key = ["doc_id", "source", "size"]
    rows = plan.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.max("taken").alias("taken")).filter("taken > 0")
    own = {"doc_id": "_id", "source": "_source", "size": "_size", "taken": "_taken"}

    def same_row(shares: DataFrame, columns: DataFrame) -> Column:
        return columns["doc_id"].eqNullSafe(shares["_id"]) & columns["source"].eqNullSafe(shares["_source"]) & (word_count(columns["text"]) == shares["_size"])

    once = rows.filter("rows = 1").drop("rows").withColumnsRenamed(own)
    single = docs.join(once, same_row(once, docs)).select(*docs.columns, "_size", "_taken")
    # the rows that repeat an id: the n-th text gets the n-th share
    several = stored(rows.filter("rows > 1").select(*key), "mix-repeated")
    turn = Window.partitionBy("_id", "_source", "_size").orderBy(F.desc("_taken"))
    again = several.withColumnsRenamed(own)
    shares = plan.withColumnsRenamed(own).join(again.withColumnsRenamed({c: f"{c}_again" for c in again.columns}), F.col("_id").eqNullSafe(F.col("_id_again")) & F.col("_source").eqNullSafe(F.col("_source_again")) & (F.col("_size") == F.col("_size_again")))
    shares = shares.select("_id", "_source", "_size", "_taken", F.row_number().over(turn).alias("_turn"))
    texts = docs.join(again, same_row(again, docs)).withColumn("_turn", F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy("text")))
    texts = texts.select(*docs.columns, "_turn", F.col("_size").alias("_words"))
    dealt = texts.join(shares, texts["doc_id"].eqNullSafe(shares["_id"]) & texts["source"].eqNullSafe(shares["_source"]) & (texts["_words"] == shares["_size"]) & (texts["_turn"] == shares["_turn"]))
    joined = single.unionByName(dealt.filter("_taken > 0").select(*docs.columns, "_size", "_taken"))
    times = F.ceil(F.col("_taken") / F.col("_size")).cast("int")
    repeated = joined.withColumn("_epoch", F.explode(F.sequence(F.lit(1), times)))
    left = F.col("_taken") - (F.col("_epoch") - 1) * F.col("_size")
    text = F.when(left >= F.col("_size"), F.col("text")).otherwise(first_words(F.col("text"), left))
    out = repeated.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns).withColumnsRenamed(back)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
             md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS key FROM documents),
n AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM n),
l AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS budget,
        sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING) - cap AS capped_before,
        sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from,
        row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS place FROM w),
v AS (SELECT min_by((budget - capped_before) / weight_from, place) AS level FROM l WHERE (budget - capped_before) / weight_from * weight <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM l, v),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before_doc,
        CAST(floor(target) AS BIGINT) AS whole FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, whole - epochs * source_size - before_doc)) AS BIGINT) AS taken FROM e
"""
