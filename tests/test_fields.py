"""Smoothing, soft Dice and cubic splines against dense numpy."""

import numpy as np
import pytest

from voxelmill.operators import fields, geometry, losses

SHAPE = (9, 7, 5)
FIELD = "k string, z int, y int, x int, value double"


def rows_of(spark, key, array, floor=None):
    at = np.argwhere(array != 0) if floor is None else np.argwhere(array != floor)
    return spark.createDataFrame([(key, *map(int, v), float(array[tuple(v)])) for v in at], FIELD)


def dense_kernel(n, sigma):
    radius, out = int(4 * sigma + 0.5), np.zeros((n, n))
    bell = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    line = np.pad(np.arange(n), radius, mode="symmetric")
    for t in range(n):
        np.add.at(out[t], line[t : t + 2 * radius + 1], bell / bell.sum())
    return out


def test_smoothing_is_that_of_mirrored_lines(spark):
    array = np.random.default_rng(0).normal(size=SHAPE) * (np.random.default_rng(1).random(SHAPE) < 0.2)
    expected = np.einsum("az,by,cx,zyx->abc", *[dense_kernel(n, 2.0) for n in SHAPE], array)
    found = fields.smoothed(rows_of(spark, "a", array), ["k"], SHAPE).collect()
    assert {(r["z"], r["y"], r["x"]): r["value"] for r in found} == pytest.approx({tuple(map(int, v)): expected[tuple(v)] for v in np.ndindex(SHAPE)}, abs=1e-12)


def test_soft_dice(spark):
    rng = np.random.default_rng(2)
    a, b = (rng.random(SHAPE) < 0.3).astype(float), (rng.random(SHAPE) < 0.2).astype(float)
    p, q = (np.einsum("az,by,cx,zyx->abc", *[dense_kernel(n, 2.0) for n in SHAPE], m) for m in (a, b))
    rows = [(v, s, *map(int, at)) for v, masks in ((1, (a, b)), (2, (a, a)), (3, (a, 0 * a))) for s, m in zip("ab", masks, strict=True) for at in np.argwhere(m)]
    found = {r["volume"]: r["soft_dice_loss"] for r in fields.soft_dice(spark.createDataFrame(rows, "volume long, side string, z int, y int, x int"), "a", "b", SHAPE).collect()}
    assert found == pytest.approx({1: 1 - 2 * (p * q).sum() / (p + q).sum(), 2: 1 - (p * p).sum() / p.sum(), 3: 1.0})


def collocation(n):
    """The values at the voxels as sums of mirrored cubic splines."""
    out = np.zeros((n, n))
    for k in range(n):
        for step, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
            at = abs(k + step)
            out[k, at if at < n else 2 * (n - 1) - at] += w
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 12])
def test_recursions_solve_the_spline_equations(n):
    values = np.random.default_rng(n).normal(size=(n, 4))
    found = fields.spline_lines(values.copy())
    assert np.allclose(found if n == 1 else collocation(n) @ found, values)


def bell(t):
    t = abs(t)
    return (4 - 6 * t**2 + 3 * t**3) / 6 if t < 1 else (2 - t) ** 3 / 6 if t < 2 else 0.0


@pytest.mark.parametrize("pose", [(0, 0, 0, 0, 0, 0), (0.5, -0.25, 1.0, 0, 0, 0), (0.3, 0, 0, 0.2, -0.1, 0.3), (99, 0, 0, 0, 0, 0)])
@pytest.mark.parametrize("background", [0.0, -1000.0])
def test_cubic_warp_is_that_of_dense_splines(spark, pose, background):
    rng = np.random.default_rng(7)
    array = np.where(rng.random(SHAPE) < 0.6, rng.normal(size=SHAPE) * 50, background)
    c = array
    for axis, n in enumerate(SHAPE):
        c = np.moveaxis(np.tensordot(np.linalg.inv(collocation(n)), c, axes=(1, axis)), 0, axis)
    matrices = geometry.with_matrix(spark.createDataFrame([("a", "one", *map(float, pose))], "k string, pose string, tz double, ty double, tx double, rz double, ry double, rx double"), SHAPE)
    m = matrices.first()
    back, offset = np.array([[m[f"i{r}{k}"] for k in range(3)] for r in range(3)]), np.array([m[f"o{r}"] for r in range(3)])
    expected = {}
    for v in np.ndindex(SHAPE):
        s = np.round(back @ np.array(v) + offset, 6)
        value = background
        if ((s >= 0) & (s <= np.array(SHAPE) - 1)).all():
            value = 0.0
            for shift in np.ndindex(4, 4, 4):
                at = np.floor(s).astype(int) + np.array(shift) - 1
                mirrored = tuple(n - 1 - abs(n - 1 - abs(i)) for i, n in zip(at, SHAPE, strict=True))
                value += np.prod([bell(a - b) for a, b in zip(s, at, strict=True)]) * c[mirrored]
        expected[v] = value
    found = fields.warp_cubic(rows_of(spark, "a", array, background), matrices, ["k"], ["k"], SHAPE, background, 9).collect()
    assert {(r["z"], r["y"], r["x"]): r["value"] for r in found} == pytest.approx(expected, abs=1e-7)


def test_losses_of_poses(spark):
    """A cube under the pose that lays it onto its shifted copy, under none, and out of the grid; an unknown loss is refused."""
    shape = (12, 9, 9)
    cube = [(z, y, x) for z in range(3, 7) for y in range(3, 6) for x in range(3, 6)]
    rows = [(1, "f", z + 2, y, x - 1) for z, y, x in cube] + [(1, "m", *v) for v in cube] + [(2, "f", 1, 1, 1)]
    masks = spark.createDataFrame(rows, "volume long, side string, z int, y int, x int")
    poses = [(v, n, *map(float, p)) for v in (1, 2) for n, p in (("right", (2, 0, -1, 0, 0, 0)), ("none", (0,) * 6), ("away", (50, 0, 0, 0, 0, 0)))]
    matrices = geometry.with_matrix(spark.createDataFrame(poses, "volume long, pose string, tz double, ty double, tx double, rz double, ry double, rx double"), shape)
    found = {r["pose"]: r for r in losses.pose_losses(masks, matrices, shape, (1.0, 1.0, 1.0), "f", "m").collect()}
    assert set(found) == {"right", "none", "away"} and {r["volume"] for r in found.values()} == {1}
    assert (found["right"]["dsc"], found["right"]["assd"], found["right"]["hd95"]) == (0, 0, 0)
    assert found["none"]["dsc"] == pytest.approx(1 - 2 * (2 * 3 * 2) / 72) and found["none"]["assd"] > 0
    assert found["right"]["soft_dice"] < found["none"]["soft_dice"] < found["away"]["soft_dice"] == 1
    assert (found["away"]["dsc"], found["away"]["assd"], found["away"]["hd95"]) == (1, losses.PENALTY, losses.PENALTY)
    with pytest.raises(ValueError, match="unknown losses: mutual"):
        losses.pose_losses(masks, matrices, shape, (1.0, 1.0, 1.0), "f", "m", ("dsc", "mutual"))


@pytest.mark.parametrize("block", [3, 64])
def test_soft_dice_shuffles_no_smoothed_values(spark, block):
    """Values of both masks meet in blocks, also where volumes have several; what is shuffled is the voxels and two sums of each block."""
    rng = np.random.default_rng(12)
    a, b = ((rng.random(SHAPE) < 0.1) * rng.random(SHAPE) for _ in range(2))
    p, q = (np.einsum("az,by,cx,zyx->abc", *[dense_kernel(n, 0.5) for n in SHAPE], m) for m in (a, b))
    rows = [(1, s, *map(int, at), float(m[tuple(at)])) for s, m in zip("ab", (a, b), strict=True) for at in np.argwhere(m)]
    found = fields.soft_dice_of(spark.createDataFrame(rows, "volume long, side string, z int, y int, x int, value double"), "a", "b", SHAPE, 0.5, block)
    assert found.first()["soft_dice_loss"] == pytest.approx(1 - 2 * (p * q).sum() / (p + q).sum())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and "Join" not in plan
