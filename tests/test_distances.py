"""Distance maps against all pairs, and lower envelopes against all parabolas."""

import numpy as np
import pytest

from voxelmill.operators import distances


@pytest.mark.parametrize("seed", range(4))
def test_envelopes_are_minima_over_all_parabolas(seed):
    rng = np.random.default_rng(seed)
    columns, most = 60, 12
    counts = rng.integers(1, most + 1, columns)
    positions, heights = np.zeros((most, columns)), np.zeros((most, columns))
    for c, n in enumerate(counts):
        positions[:n, c] = np.sort(rng.choice(np.arange(-20, 30), n, replace=False))
        heights[:n, c] = rng.choice([0.0, 1.0, 4.0, 250.0], n) if seed % 2 else rng.random(n) * 300
    targets = np.sort(rng.integers(-30, 40, (15, columns)), axis=0).astype(float)
    found = distances.envelope_minima(positions, heights, counts, 0.49, targets)
    for c, n in enumerate(counts):
        expected = (heights[:n, c] + 0.49 * (targets[:, c, None] - positions[:n, c]) ** 2).min(axis=1)
        assert np.allclose(found[:, c], expected, atol=1e-9)


def voxels(spark, rows):
    return spark.createDataFrame([(k, *map(int, v)) for k, v in rows], "k string, z int, y int, x int")


@pytest.mark.parametrize("stretch", [1, 1 << 19])
def test_distances_are_those_to_the_nearest_of_all(spark, monkeypatch, stretch):
    monkeypatch.setattr(distances, "STRETCH", stretch)
    rng = np.random.default_rng(11)
    spacing = np.array((2.5, 1.0, 0.75))
    sources = {k: rng.integers(-40, span, (n, 3)) for k, n, span in (("a", 200, 120), ("b", 1, 5), ("c", 30, -30), ("gone", 4, 9))}
    asked = {k: rng.integers(-90, span, (n, 3)) for k, n, span in (("a", 150, 200), ("b", 40, 300), ("c", 25, 1), ("none", 5, 3))}
    table = lambda of: voxels(spark, [(k, v) for k, rows in of.items() for v in [*rows, rows[0]]]).repartition(3)
    found = distances.distances_to(table(sources), table(asked), ["k"], tuple(spacing)).collect()
    nearest = lambda k, v: float(np.sqrt((((sources[k] - v) * spacing) ** 2).sum(axis=1)).min())
    expected = {(k, *map(int, v)): nearest(k, v) for k, rows in asked.items() if k in sources for v in rows}
    assert len(found) == len(expected)
    assert {tuple(r)[:4]: r["d"] for r in found} == pytest.approx(expected)


def test_slices_and_lines_are_the_largest_groups(spark):
    """A volume's sources are never in one row: a row has a slice's sources, or a line's values along z for a tile."""
    rows = voxels(spark, [("a", (z, y, 0)) for z in range(30) for y in range(20)])
    plan = distances.distances_to(rows, rows, ["k"], (1.0, 1.0, 1.0))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(y" in plan and "Join Inner" in plan and "FlatMapGroups" not in plan


def test_nothing_asked_and_no_sources(spark):
    rows, none = voxels(spark, [("a", (0, 0, 0))]), voxels(spark, [("a", (0, 0, 0))]).limit(0)
    assert distances.distances_to(rows, none, ["k"], (1.0, 1.0, 1.0)).count() == 0
    assert distances.distances_to(none, rows, ["k"], (1.0, 1.0, 1.0)).count() == 0
