import random
import re

import numpy as np
import pytest

from voxelmill.llm import embeddings, jaccard
from voxelmill.llm.components import components, local_labels

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_random_links(spark):
    picked = random.Random(1)
    links = [(picked.randint(0, 300), picked.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(1, 200)]
    table = spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long").repartition(5)
    got = {r["node"]: r["component"] for r in components(table).collect()}
    nodes = {n for link in links for n in link if link[0] != link[1]}
    want = roots(nodes, [x for x in links if x[0] != x[1]])
    assert got == want
    assert components(table.limit(0)).count() == 0


def test_local_labels_of_a_chain():
    nodes, low = local_labels(np.arange(1, 500), np.arange(0, 499))
    assert (low == 0).all() and len(nodes) == 500


def shingles(text, k):
    words = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def corpus(seed=0):
    picked = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [picked.choice(vocabulary) for _ in range(picked.randint(1, 160))]
        texts.append(" ".join(base))
        for _ in range(picked.randint(0, 6)):
            copy = list(base)
            for _ in range(picked.randint(0, 4)):
                copy[picked.randrange(len(copy))] = picked.choice(vocabulary)
            texts.append((" " if picked.random() < 0.5 else "\n").join(copy).upper() if picked.random() < 0.3 else " ".join(copy))
    return [*texts, None, "", " \t ", "one", "one", "ONE two", texts[0], "word " * 3000]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_similar_sets_by_brute_force(spark, k, percent):
    texts = corpus(k)
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, x string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_sets(docs, k, percent).collect()}
    sets = [shingles(t, k) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = roots(range(len(sets)), links)
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(sets))}


def test_a_cluster_of_near_copies_makes_no_pairs_of_all(spark, monkeypatch):
    """200 texts, each with its own two changed words: all are linked by their leaders, few pairs are compared."""
    counted = []
    compared = jaccard.compared
    monkeypatch.setattr(jaccard, "compared", lambda pairs, *a: (counted.append(pairs.count()), compared(pairs, *a))[1])
    base = [f"b{k}" for k in range(300)]
    rows = [(i, " ".join(w if k not in (i % 140, 150 + i % 149) else f"x{i}y{k}" for k, w in enumerate(base))) for i in range(200)]
    found = jaccard.similar_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0}
    assert sum(counted) < 10 * len(rows)


def test_similar_sets_of_odd_tables(documents):
    rows = jaccard.similar_sets(documents).collect()
    assert len(rows) == documents.count()
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows}
    assert {(1, 1, 1), (2, 0, 2), (3, 0, 3), (4, 1, 1), (None, 1, None), (6, 0, 6)} <= found
    assert jaccard.similar_sets(documents.limit(0)).count() == 0


def brute_vectors(rows):
    links, ids = [], [i for i, *_ in rows]
    for a in range(len(rows)):
        for b in range(a):
            (_, x, lx), (_, y, ly) = rows[a], rows[b]
            if lx is None or lx != ly or not x or not y or len(x) != len(y) or any(v is None or not np.isfinite(v) for v in x + y):
                continue
            n = np.linalg.norm(x) * np.linalg.norm(y)
            if n and np.dot(x, y) / n >= 0.98:
                links.append((ids[a], ids[b]))
    return links


def test_near_vectors_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    random_ = np.random.default_rng(0)
    rows, n = [], 0
    for _ in range(40):
        base = random_.normal(size=20)
        for _ in range(int(random_.integers(1, 5))):
            rows.append((n, (base + random_.normal(size=20) * 0.12).tolist(), int(random_.integers(0, 2))))
            n += 1
    hot = random_.normal(size=20)
    for _ in range(60):
        rows.append((n, (hot + random_.normal(size=20) * 0.05).tolist(), 0))
        n += 1
    rows += [(n + 1, hot.tolist(), 0), (n + 2, hot.tolist(), 0), (n + 3, (hot * 2).tolist(), 0), (n + 4, hot.tolist(), None), (n + 5, None, 0), (n + 6, [0.0] * 20, 0), (n + 7, [float("nan")] * 20, 0), (n + 8, [None] * 20, 0), (n + 9, [1.0], 0), (n + 10, [], 0)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, keys string").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(table).collect()}
    links = brute_vectors(rows)
    want = roots([i for i, *_ in rows], links)
    counts = {i: 0 for i, *_ in rows}
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    assert got == {i: (counts[i], want[i], want[i] == i) for i, *_ in rows}


def test_vectors_of_extreme_lengths(spark):
    rows = [(1, [1e-170, 2e-170]), (2, [1e-170, 2e-170]), (3, [1e160, 2e160]), (4, [1.0, 2.0]), (5, [1e300, -1e300]), (6, [5e-324, -5e-324]), (7, [float("inf"), 1.0]), (8, [1e160, 2.5e160])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(table).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 8: (4, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_vectors(empty).count() == 0


def test_recall_of_the_index():
    random_ = np.random.default_rng(5)
    x = random_.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = random_.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z
    for rows in (10_000, 10**7, 10**10):
        tables, hashes, probes = embeddings.hashing_plan(rows, 64)
        groups = np.zeros(len(x), np.uint64)
        meets = embeddings.first_meeting(embeddings.bucket_keys(x, groups, tables, hashes, probes), embeddings.bucket_keys(y, groups, tables, hashes, probes), tables)
        assert (meets != np.iinfo(np.int64).max).mean() >= 0.99


def test_rows_of_unshared_ngrams_go_before_lists(spark, monkeypatch):
    """Only n-grams of several rows are gathered whole, and copies of one set in several tasks make no list."""
    made, store = {}, jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: made.setdefault(name, []).append(table := store(df, name)) or made[name].append(table.collect()) or table)
    text = lambda start: " ".join(f"w{i}" for i in range(start, start + 40))
    rows = [(i, text(1000 * i)) for i in range(20)] + [(30, text(0)), (31, text(1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(11, "doc_id")
    found = {r["doc_id"]: r["component_id"] for r in jaccard.similar_sets(docs, 3, 90).collect()}
    assert found == {i: 0 if i >= 30 else i for i, _ in rows}
    prefixes, shared, members = (made[name][1] for name in ("prefixes", "shared-rows", "members"))
    assert len(shared) < len(prefixes) and len({r["x"] for r in members}) == 2
