"""A toxicity classifier whose score may not depend on which group a sentence names."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow import small_batches, with_python_columns
from .shared import dropped, stored
from .words import mix, text_batches, word_table

#: At most so many labelled rows of each class are learnt from; they are the ones with the smallest hashes of doc_id.
MOST_LABELLED = 3000
FEATURE_BITS = 20
#: Words are also known by their first bytes, for word families with free endings.
PREFIXES = (4, 5, 6, 7)
#: The model's size: the features that tell most are kept, so many at the most. A parameter of ``fit``.
MOST_FEATURES = 8192
LEAST_ROWS = 3
THRESHOLD = 0.7
STEPS, RATE, SHRINK = 300, 0.1, 3e-3
#: Weight of the penalty: the mean squared change of the score (before squashing) when the groups that a sentence names are swapped.
COUNTERFACTUAL = 20.0
#: Names of groups that may be swapped for each other, lower-case ASCII, and a neutral word. Defaults of a parameter.
IDENTITY_TERMS = (
    "asian", "atheist", "black", "blind", "buddhist", "catholic", "christian", "christians", "deaf", "disabled", "elderly", "female", "gay",
    "hindu", "immigrant", "immigrants", "jewish", "jews", "lesbian", "male", "men", "muslim", "muslims", "old", "poor", "queer", "refugees",
    "transgender", "white", "women", "young",
)
NEUTRAL_TERM = "people"
TURNS = 3
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class Model:
    """Chosen features in order, their weights, the bias; ``constant`` is the score where nothing could be learnt."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    constant: float | None = None


@lru_cache(maxsize=8)
def term_pattern(terms: tuple[str, ...]) -> re.Pattern:
    """Whole words that are a term, in ASCII letters of either case; other letters that fold to them don't count."""
    return re.compile(r"(?<![\w'])((?ai:" + "|".join(map(re.escape, terms)) + r"))(?![\w'])")


def swapped(text: str, turn: int, terms: tuple[str, ...] = IDENTITY_TERMS) -> str:
    """The text with every group name replaced: by the neutral word at turn 0, else by another name of the list."""

    def other(found: re.Match) -> str:
        return NEUTRAL_TERM if turn == 0 else terms[(terms.index(found[0].lower()) + turn * 7) % len(terms)]

    return term_pattern(terms).sub(other, text)


def counterfactuals(text: str | None, terms: tuple[str, ...] = IDENTITY_TERMS) -> list[tuple[str, str]]:
    """Pairs of sentences that differ in the groups they name.

    They are all of the text's own sentences that name one. Where none does, one is made: a sentence of the text gets a name
    between two of its words; which sentence, place and name depends on the text alone. Texts without words give none.
    """
    sentences = [s for s in SENTENCE_END.split(text or "") if s.split()]
    if not sentences or not terms:
        return []
    named = [s for s in sentences if term_pattern(terms).search(s)]
    if not named:
        turn = zlib.crc32((text or "").encode("utf-8", "surrogatepass"))
        words = sentences[turn % len(sentences)].split()
        at = turn % (len(words) + 1)
        named = [" ".join([*words[:at], terms[turn % len(terms)], *words[at:]])]
    return [(s, swapped(s, turn, terms)) for s in named for turn in range(TURNS)]


def feature_pairs(texts: list[str | None], lookup: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs: hashed lower-case words and word beginnings. ``lookup`` maps features, -1 drops them."""
    rows_out, features_out = [], []
    for lo, hi in text_batches(texts, 1 << 19):
        hashes, first, _, _, beginnings = word_table(texts[lo:hi], lower=True, letters_only=True, prefixes=PREFIXES)
        rows = np.repeat(np.arange(lo, hi), np.diff(first))
        for kind, h in enumerate((hashes, *beginnings)):
            feature = (mix(h + np.uint64(kind)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
            if lookup is not None:
                feature = lookup[feature]
                keep = feature >= 0
                pairs = (rows[keep] << FEATURE_BITS) | feature[keep]
            else:
                pairs = (rows << FEATURE_BITS) | feature
            pairs = np.unique(pairs)
            rows_out.append((pairs >> FEATURE_BITS).astype(np.int32))
            features_out.append((pairs & ((1 << FEATURE_BITS) - 1)).astype(np.int32))
    if not rows_out:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate(rows_out), np.concatenate(features_out)


def choose_features(labelled: DataFrame, rows: int, positive: int, forced: np.ndarray, most: int = MOST_FEATURES) -> np.ndarray:
    """The features whose presence tells most about the class, by the chi-square statistic, and ``forced``; rare ones are left out."""
    n, p = float(max(rows, 1)), float(positive)
    counts = labelled.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("with_it"), F.sum("toxic").alias("toxic_with"))
    spread = F.col("with_it") * (n - F.col("with_it")) / n * (p * (n - p) / n / n)
    score = F.when((F.col("with_it") >= LEAST_ROWS) & (spread > 0), F.pow(F.col("toxic_with") - F.col("with_it") * (p / n), 2) / spread)
    best = counts.select("feature", score.alias("score")).filter("score > 6.6").orderBy(F.desc("score"), "feature").limit(most)
    return np.union1d(np.array([r["feature"] for r in best.collect()], np.int64), forced)


@dataclass(frozen=True)
class Examples:
    """Labelled rows as (row, feature) pairs with the rows' labels, and changes of sentences as (change, feature, +1 or -1) with how often each comes."""

    rows: np.ndarray
    at: np.ndarray
    labels: np.ndarray
    change_rows: np.ndarray
    change_at: np.ndarray
    change_sign: np.ndarray
    change_times: np.ndarray


def train(examples: Examples, chosen: np.ndarray, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Logistic regression, each class weighing as much, plus the penalty on changes of the score, by full-batch Adam steps."""
    y = examples.labels
    if not len(y) or y.min() == y.max():
        return Model(np.empty(0, np.int64), np.empty(0), 0.0, float(y.mean()) if len(y) else 0.0)
    k, n = len(chosen), len(y)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(examples.rows, weights=w[examples.at], minlength=n) + w[k]
        off = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        slope = np.append(np.bincount(examples.at, weights=off[examples.rows], minlength=k), off.sum())
        slope[:k] += SHRINK * w[:k] / max(1, k) ** 0.5
        if len(examples.change_times) and counterfactual:
            times = examples.change_times / examples.change_times.sum()
            moved = times * np.bincount(examples.change_rows, weights=examples.change_sign * w[examples.change_at], minlength=len(times))
            slope[:k] += 2 * counterfactual * np.bincount(examples.change_at, weights=examples.change_sign * moved[examples.change_rows], minlength=k)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(chosen, w[:k].copy(), float(w[k]))


def lookup_table(chosen: np.ndarray) -> np.ndarray:
    table = np.full(1 << FEATURE_BITS, -1, np.int64)
    table[chosen] = np.arange(len(chosen))
    return table


def scores(model: Model, texts: list[str | None], lookup: np.ndarray) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    rows, at = feature_pairs(texts, lookup)
    z = np.bincount(rows, weights=model.weights[at], minlength=len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_features(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, terms: tuple[str, ...] = IDENTITY_TERMS) -> DataFrame:
    """(doc_id, toxic, features, changes) of at most ``most`` labelled texts of each class, none of the held-out rows.

    The rows are the same whatever the partitions. ``features`` are the text's, ``changes`` has what counterfactual pairs of
    its sentences change, the features that go and those that come (as -1 - feature), each once and with how many ``times``.
    Labels other than 0 and 1, and rows
    without id, don't count; of several texts of an id the smallest counts.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("toxic = 1").orderBy(*order).limit(most).unionByName(known.filter("toxic = 0").orderBy(*order).limit(most))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def split(rows: np.ndarray, features: np.ndarray, n: int) -> list[np.ndarray]:
        order = np.argsort(rows, kind="stable")
        return np.split(features[order], np.searchsorted(rows[order], np.arange(1, n)))

    def made(texts: list[str | None]) -> list[list]:
        features = split(*feature_pairs(texts), len(texts))
        changes = []
        for text in texts:
            pairs = counterfactuals(text, terms)
            both = split(*feature_pairs([s for pair in pairs for s in pair]), 2 * len(pairs)) if pairs else []
            moves = Counter((*np.setdiff1d(a, b).tolist(), *(-1 - np.setdiff1d(b, a)).tolist()) for a, b in zip(both[::2], both[1::2], strict=True))
            changes.append([{"codes": list(codes), "times": times} for codes, times in moves.items() if codes])
        ends = np.cumsum([0, *map(len, features)], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(features))), changes]

    return with_python_columns(rows, ["text"], StructType.fromDDL("features array<int>, changes array<struct<codes: array<int>, times: int>>"), made, dropped=("text",))


def examples_of(labelled: DataFrame, chosen: np.ndarray) -> Examples:
    """What the driver learns from: of the bounded sample the chosen features only, and equal changes of all its sentences as one."""
    kept = F.broadcast(labelled.sparkSession.createDataFrame([(int(f), k) for k, f in enumerate(chosen)], "feature int, at int"))
    numbers = labelled.select("doc_id", "toxic", "features", "changes")
    by_row = numbers.select("doc_id", "toxic", F.explode_outer("features").alias("feature")).join(kept, "feature", "left")
    rows = by_row.groupBy("doc_id", "toxic").agg(F.sort_array(F.collect_list("at")).alias("at")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").select("toxic", "at").toPandas()
    same = numbers.select(F.explode("changes").alias("change")).select("change.*").groupBy("codes").agg(F.sum("times").alias("times"))
    apart = same.select("codes", "times", F.explode("codes").alias("code"))
    apart = apart.select("codes", "times", F.when(F.col("code") < 0, -1).otherwise(1).alias("sign"), F.when(F.col("code") < 0, -1 - F.col("code")).otherwise(F.col("code")).alias("feature"))
    moves = apart.join(kept, "feature").groupBy("codes", "times").agg(F.sort_array(F.collect_list(F.struct("at", "sign"))).alias("moves"))
    changes = moves.groupBy("moves").agg(F.sum("times").alias("times")).orderBy("moves").select(F.col("moves.at").alias("at"), F.col("moves.sign").alias("sign"), "times").toPandas()

    def flat(lists, kind) -> np.ndarray:
        return np.concatenate([np.asarray(x, kind) for x in lists]) if len(lists) else np.empty(0, kind)

    def owners(lists) -> np.ndarray:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists])

    return Examples(owners(rows["at"]), flat(rows["at"], np.int64), rows["toxic"].to_numpy(np.float64), owners(changes["at"]), flat(changes["at"], np.int64), flat(changes["sign"], np.float64), changes["times"].to_numpy(np.float64))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, counterfactual: float = COUNTERFACTUAL, terms: tuple[str, ...] = IDENTITY_TERMS, size: int = MOST_FEATURES) -> Model:
    """A model of up to ``size`` features of the labelled rows that aren't held out; at most ``most`` rows of each class are learnt from.

    Executors make hashed features of the sample and of its counterfactual sentences and choose among them; the driver
    gets at most ``size`` and the terms' own for each of at most 2 * ``most`` rows, and the different changes of sentences with
    their numbers, never texts. Names in ``terms`` are swapped for each other; what depends on them is penalised. Without labelled rows, or with one class
    only, the score is a constant.
    """
    labelled = stored(labelled_features(docs, labels, most, terms), "labelled-features")
    count = labelled.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("positive")).first()
    own = np.unique(feature_pairs([" ".join(terms)])[1]).astype(np.int64)
    chosen = choose_features(labelled, count["rows"], count["positive"], own, size)
    examples = examples_of(labelled, chosen)
    dropped(labelled)
    return train(examples, chosen, counterfactual)


def toxicity(text: Column, model: Model) -> Column:
    """Score from 0 to 1 of whole texts; null texts score as empty ones do."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lookup = lookup_table(model.features)
        for batch in batches:
            yield pd.Series(scores(model, batch.tolist(), lookup))

    return score(text)


def score_documents(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``threshold`` on); columns of these names are replaced.

    Every row is scored on its own: repeated rows get equal scores, empty tables give empty results.
    """
    scored = small_batches(docs).withColumn("score", toxicity(F.col(text), model))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels that aren't held out; nulls and empty texts as in ``score_documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
