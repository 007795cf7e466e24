"""Whitening against dense numpy and exact integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.llm import whitening as wh


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, v, "x", 3.5) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>, component string, whitened double")


def by_hand(vectors, most=32):
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(int) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    exact = x.astype(object) * n - sums
    centred = (x * n - sums) / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:most]
    order = order[values[order] > 1e-12 * values.max()]
    return [int(v) for v in (exact * exact).sum(axis=1)], centred @ axes[:, order] / np.sqrt(values[order]), values[order] / np.trace(covariance)


@pytest.mark.parametrize("width,n", [(3, 40), (40, 300)])
def test_rows_are_those_of_numpy(spark, width, n):
    rng = np.random.default_rng(width)
    vectors = (rng.normal(size=(n, width)) * np.linspace(1, 9, width)).astype(np.float32)
    given = [v.tolist() for v in vectors]
    bad = [None, [float("nan")] * width, [float("inf")] + [0.0] * (width - 1), [None] + [1.0] * (width - 1), []]
    found = wh.whiten(frame(spark, given + bad).repartition(3), "embedding", ["vec_id"]).orderBy("vec_id", "component").collect()
    deviations, whitened, explained = by_hand(vectors)
    k = min(32, width)
    assert len(found) == n * k and [r.component for r in found[:k]] == list(range(1, k + 1))
    assert {r.n for r in found} == {n} and len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    table = np.array([r.whitened for r in found]).reshape(n, k)
    signs = np.sign((table * whitened).sum(axis=0))
    assert np.allclose(table * signs, whitened, atol=1e-8)
    assert [int(found[i * k].deviation) for i in range(n)] == deviations
    assert np.allclose([r.explained for r in found[:k]], explained, rtol=1e-9)


def test_components_without_variance_have_no_rows(spark):
    rows = wh.whiten(frame(spark, [[0.0, 1.0, 2.0], [1.0, 1.0, 4.0], [5.0, 1.0, 12.0]]), "embedding", ["vec_id"]).collect()
    assert {r.component for r in rows} == {1} and len(rows) == 3


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_nothing_to_whiten(spark, vectors):
    found = wh.whiten(frame(spark, vectors), "embedding", ["vec_id"])
    assert found.count() == 0
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_repeated_rows_and_null_ids_count(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0])], "vec_id long, embedding array<double>")
    rows = wh.whiten(vectors, "embedding", ["vec_id"]).collect()
    assert len(rows) == 3 and {r.n for r in rows} == {3}


def test_lengths_must_agree(spark):
    with pytest.raises(ValueError, match="one length"):
        wh.whiten(frame(spark, [[1.0], [1.0, 2.0]]), "embedding", ["vec_id"])


def test_deviations_beyond_a_long_are_exact():
    x = np.array([[3, 1_000_000], [1_000_001, 0]])
    n, sums = 10**10, np.array([10**16, 7])
    exact = [[int(v) * n - int(s) for v, s in zip(row, sums)] for row in x]
    off, squares = wh.deviations(x, n, sums)
    assert [int(s) for s in squares] == [sum(v * v for v in row) for row in exact]
    assert np.allclose(off, np.array(exact, float))


def test_integers_are_floors(spark):
    row = frame(spark, [[-0.01, 0.015625, 0.0]], "double").select(wh.as_integers("embedding").alias("x")).first()
    assert row.x == [999_999, 1_000_001, 1_000_000]


def test_query(spark):
    found = wh.op13_whitening(spark, "/root/testdata/sf0.001")
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    worst = found.agg(F.max("identity_error").alias("e"), F.max("component").alias("k")).first()
    assert worst.e <= 1e-4 and worst.k == 32
