"""Phrase collocations: n-gram counts from suffix arrays of word ids, merged over shards, and scores of their best cuts.

Texts become shards of word ids. In each shard suffixes are sorted by prefix doubling, and stretches of neighbours whose
longest common prefix has m words or more are the m-grams with their counts. A phrase can be frequent only if each pair
of words in it is: pairs are counted first, by hashes (a hash that two pairs share only lets a pair through), and shards
get back which of their pairs passed. What they then emit is merged exactly, by language and words. Nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import small_batches
from .shared import stored
from .words import mix

#: Phrases have up to so many words.
LONGEST = 4
#: A shard is closed when it has this many words and piece ends; a place in it has PLACE_BITS bits.
SHARD_WORDS, PLACE_BITS, NUMBER_BITS = 1 << 20, 22, 16
#: Long texts are split into words about so many bytes at a time.
STRETCH_BYTES = 1 << 20
#: What ends a piece becomes a full stop, which no word holds.
TO_WORDS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 9)
END = 0
#: Pairs are counted by hashes of so many bits.
HASH_BITS = 48
#: A single word is looked up in so many places, since many phrases begin or end with it.
SALTS = 16


class WordIds(dict):
    """Ids of words in the order in which they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": END})

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a stretch at a time, with a full stop for each end of a piece and one at its end."""
    at = 0
    while at < len(raw):
        cut = raw.find(b" ", at + STRETCH_BYTES) if len(raw) - at > STRETCH_BYTES else -1
        end = len(raw) if cut < 0 else cut
        yield raw[at:end].translate(TO_WORDS).replace(b".", b" . ").split()
        at = end
    yield [b"."]


def packed(ids: np.ndarray) -> bytes:
    """Ids compressed by their bytes' places: all lowest bytes first, then the next ones."""
    return pa.compress(ids.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, size).T).view(np.int32).ravel()


class Shard:
    """Words of one language that haven't been handed on yet."""

    def __init__(self, kept: list[bytes] = ()):
        self.ids, self.parts, self.size = WordIds(), [], 0
        self.add(kept)

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def close(self) -> tuple[int, int, bytes, bytes, list[bytes]]:
        """(number of starts, of ids, ids, words in the order of their ids, words that the next shard begins with).

        Phrases that begin in the last words of an unfinished piece reach into the next shard and are counted there.
        """
        ids, words = np.concatenate(self.parts), list(self.ids)
        tail = 0 if not len(ids) or ids[-1] == END else min(LONGEST - 1, len(ids))
        starts = len(ids) - tail
        return starts, len(ids), packed(ids), b" ".join(words), [words[i] for i in ids[starts:]]


def word_shards(docs: DataFrame) -> DataFrame:
    """(shard, lang, starts, size, ids, words): the words of all texts by language, about SHARD_WORDS in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Shard] = {}
        partition, number = TaskContext.get().partitionId(), 0

        def row(lang: str, goes_on: bool) -> pa.RecordBatch:
            nonlocal number
            if number >> NUMBER_BITS:
                raise ValueError("a task has too many shards; read the table in smaller partitions")
            starts, size, ids, words, tail = held.pop(lang).close()
            if goes_on:
                held[lang] = Shard(tail)
            shard, number = (partition << NUMBER_BITS) | number, number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((shard, pa.int64()), (lang, pa.string()), (starts, pa.int32()), (size, pa.int32()), (ids, pa.binary()), (words, pa.binary()))], names=["shard", "lang", "starts", "size", "ids", "words"])

        for batch in batches:
            for text, lang in zip(batch.column("text").cast(pa.binary()), batch.column("lang").to_pylist(), strict=True):
                for words in words_of(text.as_py() or b""):
                    held.setdefault(lang, Shard()).add(words)
                    if held[lang].size >= SHARD_WORDS:
                        yield row(lang, True)
            if sum(s.size for s in held.values()) >= SHARD_WORDS:
                yield from [row(lang, False) for lang in list(held)]
        yield from [row(lang, False) for lang in list(held)]

    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    return small_batches(texts).mapInArrow(run, "shard long, lang string, starts int, size int, ids binary, words binary")


def reach(ids: np.ndarray) -> np.ndarray:
    """For each place the words from there to the end of its piece, LONGEST at the most."""
    inside = ids != END
    total, so_far = np.zeros(len(ids), np.int8), inside.copy()
    for k in range(LONGEST):
        total += so_far
        room = max(0, len(ids) - k - 1)
        so_far[:room] &= inside[k + 1 :]
        so_far[room:] = False
    return total


def ranks(ids: np.ndarray, words: int) -> np.ndarray:
    """The rank of each suffix among all by its first ``words`` words (a power of two), by prefix doubling."""
    rank, known = ids.astype(np.int64), 1
    while known < words:
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - known)] = rank[known:] + 1
        rank = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)[1]
        known *= 2
    return rank


def common_prefixes(ids: np.ndarray, order: np.ndarray, words: int) -> np.ndarray:
    """How many words, up to ``words``, each suffix in the order has in common with the one before it."""
    same, total = np.ones(max(0, len(order) - 1), bool), np.zeros(len(order), np.int8)
    padded = np.concatenate([ids, np.full(words, END, ids.dtype)])
    for k in range(words):
        here = padded[order + k]
        same &= here[1:] == here[:-1]
        total[1:] += same
    return total


def intervals(common: np.ndarray, words: int) -> np.ndarray:
    """Where in the suffix array intervals begin whose suffixes share their first ``words`` words."""
    return np.flatnonzero(common < words)


def pair_counts(shards: DataFrame) -> DataFrame:
    """(hash, place, n): a row for each pair of words of each shard with one of its places and how often it begins there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpacked(row["ids"], row["size"])
                seed = xxhash.xxh64_intdigest(row["lang"])
                hashed = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in row["words"].split(b" ")), np.uint64)
                at = np.flatnonzero(reach(ids) >= 2)
                order = at[np.argsort(ranks(ids, 2)[at], kind="stable")]
                begins = intervals(common_prefixes(ids, order, 2), 2)
                first = order[begins]
                counted = np.concatenate([[0], np.cumsum(order < row["starts"])])
                n = counted[np.append(begins[1:], len(order))] - counted[begins] if len(order) else begins
                keys = mix(mix(hashed[ids[first]]) * np.uint64(0xD6E8FEB86659FD93) + hashed[ids[first + 1]]) >> np.uint64(64 - HASH_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array((row["shard"] << PLACE_BITS) | first.astype(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "place", "n"])

    return shards.mapInArrow(run, "hash long, place long, n long")


def phrase_counts(shards: DataFrame) -> DataFrame:
    """(lang, phrase, n) by shard: all words, the phrases of pairs that passed (``places``), and under "" all words together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, starts = unpacked(row["ids"], row["size"]), row["starts"]
                words = pa.array(row["words"].split(b" ")).cast(pa.string())
                n = np.bincount(ids[:starts], minlength=len(words))
                used = np.flatnonzero(n)
                used = used[used != END]
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * (len(used) + 1)), pa.concat_arrays([words.take(pa.array(used)), pa.array([""])]), pa.array([*n[used], n[used].sum()], pa.int64())], names=["lang", "phrase", "n"])
                yield from longer(ids, starts, words, row["lang"], np.asarray(row["places"] or [], np.int64))

    return shards.mapInArrow(run, "lang string, phrase string, n long")


def longer(ids: np.ndarray, starts: int, words: pa.Array, lang: str, places: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of phrases of two words and more all of whose pairs have one of the places."""
    if not len(places):
        return
    pair, left = ranks(ids, 2), reach(ids)
    passed = np.zeros(int(pair.max()) + 1, bool)
    passed[pair[places]] = True
    good = passed[pair] & (left >= 2)
    at = np.flatnonzero(good[:starts])
    after = np.concatenate([pair[2:] + 1, [0, 0]])[: len(pair)]
    order = at[np.lexsort((after[at], pair[at]))]  # the doubling's last step, only where a pair passed
    common = common_prefixes(ids, order, LONGEST)
    sound = good.copy()
    for m in range(2, LONGEST + 1):
        begins = intervals(common, m)
        n = np.diff(np.append(begins, len(order)))
        keep = sound[order[begins]] & (left[order[begins]] >= m)
        first, n = order[begins][keep], n[keep]
        phrase = pc.binary_join_element_wise(*[words.take(pa.array(ids[first + k])) for k in range(m)], " ")
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), phrase, pa.array(n, pa.int64())], names=["lang", "phrase", "n"])
        sound = sound & np.concatenate([good[m - 1 :], np.zeros(m - 1, bool)])


def frequent_phrases(docs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n): words and phrases up to LONGEST words that come ``least`` times or more in a language, and under "" all its words.

    Null texts count as empty and null languages as ``und``. Only ``text`` and ``lang`` are read.
    """
    shards = stored(word_shards(docs), "word-shards")
    total = F.sum("n").over(Window.partitionBy("hash"))
    passed = pair_counts(shards).withColumn("total", total).filter(F.col("total") >= least)
    back = passed.groupBy(F.shiftright("place", PLACE_BITS).alias("shard")).agg(F.collect_list((F.col("place") % (1 << PLACE_BITS)).cast("int")).alias("places"))
    counted = phrase_counts(shards.join(back, "shard", "left")).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return counted.filter((F.col("n") >= least) | (F.col("phrase") == ""))


def part(words: Column | str, first: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def with_best_cuts(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds l, r and score of the cut into two parts with the least score (the first of equal ones).

    ``phrases`` has lang, phrase, words and a. Single words are looked up in SALTS places each.
    """
    split = F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(k.alias("k"), part("words", F.lit(1), k).alias("left"), part("words", k + 1, F.size("words") - k).alias("right"))))
    cuts = phrases.select("lang", "phrase", "a", split.alias("cut"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"cut.{s}").alias("part")) for s in ("left", "right")]))
    asked = cuts.select("lang", "phrase", "a", "cut.k", sides.alias("s")).select("lang", "phrase", "a", "k", "s.*")
    single = ~F.contains(F.col("part"), F.lit(" "))
    asked = asked.withColumn("salt", F.when(single, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(0).cast("int"))
    places = F.when(~F.contains(F.col("phrase"), F.lit(" ")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = counts.filter("phrase <> ''").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"), F.explode(places).alias("salt"))
    found = asked.join(known, ["lang", "part", "salt"])
    counted = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    ways = range(1, LONGEST)
    wide = found.groupBy("lang", "phrase", "a").agg(*[counted(k, side).alias(f"{side}{k}") for k in ways for side in ("left", "right")])
    score = lambda k: F.expr(f"(CAST(a AS DECIMAL(19, 0)) * 2000000) div (CAST(left{k} AS DECIMAL(19, 0)) + CAST(right{k} AS DECIMAL(19, 0)))")
    cut = lambda k: F.when(F.col(f"left{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"left{k}").alias("l"), F.col(f"right{k}").alias("r")))
    return wide.select("lang", "phrase", "a", F.least(*map(cut, ways)).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def without_parts_of_longer(phrases: DataFrame, percent: int) -> DataFrame:
    """Drops phrases that lie in a longer one which comes at least ``percent`` of their times."""
    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: part("words", i, m))))
    inside = phrases.filter(size > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.expr(f"CAST(longer AS DECIMAL(19, 0)) * 100 >= CAST(a AS DECIMAL(19, 0)) * {percent}")
    return phrases.join(inside, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False))).drop("longer")


def first_by_score(scored: DataFrame, most: int, buckets: int) -> DataFrame:
    """Each language's first rows by score, a (both descending) and phrase, with their rank; chosen in parts of a language first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = scored.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
    within = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))
    near = dealt.withColumn("place", within).filter(F.col("place") <= most).drop("place", "bucket")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to LONGEST words.

    Words are what lies between spaces and tabs within pieces, which end at ``.,;:!?`` and line ends; A-Z are lower-cased.
    A phrase must come ``least`` times. Its score is 2,000,000 a / (l + r), cut to an integer, where l and r count its two
    parts; the cut with the least score holds, the first of equal ones. Phrases within a longer one that comes at least
    ``percent`` of their times are dropped. ``most`` rows a language, by score and a (descending) and the phrase's bytes.

    Null texts count as empty, null languages as ``und``; repeated rows count as often as they come. Without frequent
    phrases, and for an empty table, there are no rows. Other columns aren't read.
    """
    counts = stored(frequent_phrases(docs, least), "phrase-counts")
    phrases = counts.filter(F.contains(F.col("phrase"), F.lit(" "))).select("lang", "phrase", F.split("phrase", " ").alias("words"), F.col("n").alias("a"))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = first_by_score(with_best_cuts(without_parts_of_longer(phrases, percent), counts), most, buckets)
    totals = counts.filter("phrase = ''").select("lang", "n")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language over all texts; nulls and ties as in ``collocations``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
g AS (SELECT lang, ws[i : i + m - 1] AS ws FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m))),
f AS (SELECT lang, ws, array_to_string(ws, ' ') AS phrase, count(*) AS a FROM g GROUP BY lang, ws HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT * FROM f WHERE len(ws) > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, k, ls.a AS l, rs.a AS r, CAST(CAST(c.a AS HUGEINT) * 2000000 // (CAST(ls.a AS HUGEINT) + rs.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM c) c JOIN f ls ON ls.lang = c.lang AND ls.ws = c.ws[1 : k] JOIN f rs ON rs.lang = c.lang AND rs.ws = c.ws[k + 1 : len(c.ws)]),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts) WHERE place = 1),
inside AS (SELECT lang, ws[i : i + m - 1] AS ws, max(a) AS longer FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < len(ws)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b JOIN c USING (lang, phrase) LEFT JOIN inside s ON s.lang = c.lang AND s.ws = c.ws WHERE s.longer IS NULL OR CAST(s.longer AS HUGEINT) * 100 < CAST(c.a AS HUGEINT) * 80),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
