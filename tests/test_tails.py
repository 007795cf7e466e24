"""Tail probabilities in columns against plain Python, exact sums and resamples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.functions import tails
from voxelmill.operators import block_statistics as bs

from . import plain_tails as plain


def values(spark, expression, rows, names):
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{n} double" for n in names))
    return [r["p"] for r in frame.select("id", expression(*[F.col(n) for n in names]).alias("p")).orderBy("id").collect()]


def test_normal_distribution(spark):
    z = [-38.0, -9.1, -7.08, -7.05, -3.0, -0.5, 0.0, 1e-9, 1.96, 7.05, 8.0, 20.0]
    assert values(spark, tails.normal_below, [(v,) for v in z], ["z"]) == pytest.approx([0.5 * math.erfc(-v / math.sqrt(2)) for v in z], rel=1e-7, abs=1e-15)


def test_log_gamma(spark):
    x = [0.5, 1.0, 1.5, 2.0, 7.3, 100.0, 1e6]
    assert values(spark, tails.log_gamma, [(v,) for v in x], ["x"]) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)


def test_chi_square(spark):
    rows = [(x, df) for df in (1, 2, 5, 14, 99) for x in (0.0, 0.3, 2.0, 14.0, 60.0, 300.0)]
    found = values(spark, tails.chi2_tail, rows, ["x", "df"])
    assert found == pytest.approx([plain.chi2_tail(*r) for r in rows], rel=1e-9, abs=1e-14)
    assert found[rows.index((14.0, 2))] == pytest.approx(math.exp(-7), rel=1e-12)


def test_f(spark):
    rows = [(f, a, b) for a, b in ((1, 1), (7, 7), (14, 336), (3, 40), (14, 9986)) for f in (0.0, 0.1, 1.0, 3.7, 40.0, math.inf)]
    found = values(spark, tails.f_tail, rows, ["f", "df1", "df2"])
    assert found == pytest.approx([plain.f_tail(*r) for r in rows], rel=1e-8, abs=1e-14)
    assert found[rows.index((1.0, 7, 7))] == pytest.approx(0.5)


def test_signs_are_exact(spark):
    rows = [(k, n) for n in (0, 1, 5, 25, 60) for k in range(n + 1)]
    assert values(spark, tails.sign_tail, rows, ["plus", "n"]) == pytest.approx([sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n for k, n in rows], rel=1e-10)


def test_range_of_normals(spark):
    rows = [(q, k) for k in (2, 3, 15) for q in (0.0, 0.4, 1.3, 3.6, 8.0)]
    found = values(spark, tails.range_tail, rows, ["q", "k"])
    assert found == pytest.approx([plain.range_tail(*r) for r in rows], abs=2e-6)
    assert found[rows.index((1.3, 2))] == pytest.approx(math.erfc(1.3 / 2), abs=1e-12)


def exact_median_ends(x):
    """All resamples of a few values, each as likely."""
    grid = np.array(np.meshgrid(*[x] * len(x))).reshape(len(x), -1)
    medians = np.sort(np.median(grid, axis=0))
    return [medians[math.ceil(share * len(medians) - 1e-9) - 1] for share in (0.025, 0.975)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7])
def test_interval_is_that_of_all_resamples(spark, n):
    x = np.round(np.random.default_rng(n).normal(size=n), 1)
    frame = spark.createDataFrame([("a", float(v)) for v in x] + [("a", None), ("a", math.nan)], "k string, d double")
    row = bs.bootstrap_median(frame, ["k"]).first()
    assert [row["low"], row["high"]] == pytest.approx(exact_median_ends(x))
    assert row["median"] == pytest.approx(float(np.median(x)))


@pytest.mark.parametrize("n", [40, 41, 3000, 3001])
def test_interval_agrees_with_resamples(spark, n):
    x = np.sort(np.random.default_rng(n).normal(size=n))
    rng, medians = np.random.default_rng(42), []
    for _ in range(100):
        medians.append(np.median(x[rng.integers(0, n, (100, n))], axis=1))
    row = bs.bootstrap_median(spark.createDataFrame([("a", float(v)) for v in x], "k string, d double"), ["k"]).first()
    share = lambda v: (np.concatenate(medians) <= v).mean()
    assert share(row["low"]) == pytest.approx(0.025, abs=0.01) or n < 50
    assert share(row["low"]) >= 0.02 and share(row["low"] - 1e-9) <= 0.03
    assert share(row["high"]) >= 0.97 and share(row["high"] - 1e-9) <= 0.98


def design(spark, groups):
    rows = [(g, f"b{b}", c, float(v)) for g, blocks in groups.items() for b, block in enumerate(blocks) for c, v in zip("pqrst", block, strict=False)]
    frame = spark.createDataFrame(rows, "grp string, block string, config string, v double")
    return bs.rank_in_blocks(frame, ["grp", "block"], "v")


def test_posthoc_waits_for_its_gate(spark):
    rng = np.random.default_rng(1)
    clear = [[9, 8.9, 5, 4.9, 1] + rng.normal(size=5) * 0.2 for _ in range(12)]
    ranked = design(spark, {"clear": clear, "noise": rng.normal(size=(12, 5)), "two": [[1, 0]] * 30})
    pairs = bs.gated_posthoc(ranked, "grp", "block", "config").collect()
    assert {r["grp"] for r in pairs} == {"clear"} and len(pairs) == 10
    assert {(r["config"], r["other"]) for r in pairs if r["p"] < 0.05} >= {("p", "s"), ("p", "t"), ("q", "t")}
    bars = bs.rank_bars(ranked, "grp", "block", "config").collect()
    position = {c: i for i, c in enumerate(r["config"] for r in bs.mean_ranks(ranked.filter("grp = 'clear'"), "grp", "config").orderBy("mean_rank").collect())}
    alike = {frozenset((r["config"], r["other"])) for r in pairs if r["p"] >= 0.05}
    by_place = sorted(position, key=position.get)
    runs = {(i, j) for i in range(5) for j in range(i + 1, 5) if all(frozenset((by_place[a], by_place[b])) in alike for a in range(i, j + 1) for b in range(a + 1, j + 1))}
    longest = {(i, j) for i, j in runs if not any(a <= i and j <= b and (a, b) != (i, j) for a, b in runs)}
    assert {(position[r["first"]], position[r["last"]]) for r in bars} == longest
