"""From raw documents to token ids: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm import bpe, jaccard, mixing, substrings, toxicity
from voxelmill.llm.shared import stored

#: Stages on word shingles take five words and a similarity of 0.8.
SHINGLE_WORDS, PERCENT = 5, 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones among them, rejects go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; documents without id stay."""
    classes = jaccard.similar_sets(docs, SHINGLE_WORDS, PERCENT)
    others = stored(classes.filter("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; documents of which nothing is left go."""
    return substrings.without_passages(docs, substrings.repeated_passages(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, the last one cut to the budget."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and digests of the ids and of the text decoded from them."""
    return bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), bpe.vocabulary()).select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Hashing, learning and encoding can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole table ``documents``; what a stage returns is stored and read by the next.

    Null texts count as empty: they are scored as such, have no near copies or passages, and are never taken by the mix,
    which has no words to take. Documents without id are scored and mixed, and are no copies of others. Repeated rows
    are scored alike; of rows with one id all stay or go together until the mix, which gives each its share. Without
    documents the result is empty; without labels no document is rejected. Other columns of documents are kept up to
    the mix, which hands on text, source and what encoding returns.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
