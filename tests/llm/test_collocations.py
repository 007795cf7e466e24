"""Collocations against counting phrases one by one."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxelmill.llm import collocations as co


def by_hand(rows, least, percent=80, most=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for m in range(1, 5):
                counts[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, of in counts.items():
        frequent = {p: n for p, n in of.items() if n >= least and len(p) > 1}
        scored = []
        for p, a in frequent.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * n >= percent * a and inside(q) for q, n in frequent.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (of[p[:k]] + of[p[k:]]), k, of[p[:k]], of[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(scored)[:most])]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def made_up(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["a", "B", "ccc", "É", "é", "d\x00", "e"]
    texts = ["".join(rng.choice(words) + rng.choice([" "] * 8 + ["\t", "  ", ". ", ",", "\n"]) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [(t, rng.choice(["en", "fr", None])) for t in texts] + [(None, "en"), ("", None), ("...", "xx"), ("one", "yy")]


@pytest.mark.parametrize("least,shard,stretch", [(2, 1 << 20, 1 << 20), (3, 64, 16), (30, 40, 7)])
def test_rows_are_those_of_counting(spark, monkeypatch, least, shard, stretch):
    """Also where pieces go on in the next shard, since shards and stretches are small."""
    monkeypatch.setattr(co, "SHARD_WORDS", shard)
    monkeypatch.setattr(co, "STRETCH_BYTES", stretch)
    rows = made_up(least, 120)
    docs = spark.createDataFrame([(t, lang, "x", 1) for t, lang in rows], "text string, lang string, phrase string, n int").repartition(3)
    found = rows_of(co.collocations(docs, least))
    assert found == by_hand(rows, least)
    assert found


def test_first_rows_only(spark):
    rows = made_up(5, 80)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert rows_of(co.collocations(docs, 2, most=7)) == by_hand(rows, 2, most=7)


def test_a_long_text_without_pieces(spark, monkeypatch):
    monkeypatch.setattr(co, "SHARD_WORDS", 1000)
    rows = [("one two three four five " * 2000, "en")]
    assert rows_of(co.collocations(spark.createDataFrame(rows, "text string, lang string"))) == by_hand(rows, 30)


def test_no_rows(spark):
    assert co.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert co.collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).count() == 0


def test_scores_beyond_64_bits(spark):
    """2,000,000 times a count of 10^13 passes a long."""
    a = 10**13 + 7
    counts = spark.createDataFrame([("en", "x", a), ("en", "y", a + 1), ("en", "x y", a)], "lang string, phrase string, n long")
    phrases = counts.filter("phrase = 'x y'").selectExpr("lang", "phrase", "split(phrase, ' ') AS words", "n AS a")
    assert co.with_best_cuts(phrases, counts).first().score == 2_000_000 * a // (2 * a + 1)


@pytest.mark.parametrize("words", [2, 4])
def test_order_is_that_of_suffixes(words):
    ids = np.random.default_rng(3).integers(0, 4, 300).astype(np.int32)
    rank = co.ranks(ids, words)
    padded = [*ids.tolist(), *[-1] * words]
    heads = [tuple(padded[i : i + words]) for i in range(len(ids))]
    assert [sorted(set(heads)).index(h) for h in heads] == rank.tolist()
    assert co.reach(ids).tolist() == [next((k for k in range(4) if padded[i + k] in (0, -1)), 4) if i + 4 <= len(ids) else next((k for k in range(4) if i + k >= len(ids) or ids[i + k] == 0), 4) for i in range(len(ids))]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_short_shards(n):
    assert co.reach(np.arange(1, n + 1, dtype=np.int32)).tolist() == list(range(n, 0, -1))
