"""Operators on cases worked out by hand, and those that SQL can't express against plain Python."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import block_statistics as bs
from voxelmill.operators import cohorts, geometry, grids, masks, series

VOXELS = "volume long, side string, z int, y int, x int"


def test_tied_ranks_share_their_mean(spark):
    rows = spark.createDataFrame([("b", c, v) for c, v in (("w", 5.0), ("x", 5.0), ("y", 7.0), ("z", 1.0))], "block string, config string, v double")
    ranks = {r["config"]: r["rank"] for r in bs.rank_in_blocks(rows, ["block"], "v").collect()}
    assert ranks == {"w": 2.5, "x": 2.5, "y": 1.0, "z": 4.0}


def test_upsert_replaces_repeated_keys_and_keeps_the_rest(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "config string, v int")
    new = spark.createDataFrame([("a", 9), ("a", 10), ("c", 4)], "config string, v int")
    assert sorted(map(tuple, bs.upsert(old, new, "config").collect())) == [("a", 9), ("a", 10), ("b", 3), ("c", 4)]


def test_duplicate_phases_go_altogether(spark):
    rows = spark.createDataFrame([("p", "pv"), ("p", "arterial"), ("p", "arterial"), ("q", "pv")], "name string, phase string")
    assert sorted(map(tuple, cohorts.unambiguous(rows).select("name", "phase").collect())) == [("p", "pv"), ("q", "pv")]


def test_overlap_of_empty_and_equal_masks(spark):
    cube = list(product(range(3), repeat=3))
    rows = [(1, s, *v) for s in "ab" for v in cube] + [(2, "a", *v) for v in cube]
    found = {r["volume"]: r for r in masks.overlap(spark.createDataFrame(rows, VOXELS), "a", "b").collect()}
    assert found[1]["dsc"] == 1 and found[2]["dsc"] == 0


def test_masks_meet_in_columns(spark):
    """Overlap by columns of 64 voxels: beyond and below a column, repeated voxels, sides that aren't compared; one row is grouped for each column."""
    rng = np.random.default_rng(13)
    rows = [(int(v), str(s), int(z), int(y), int(x)) for v, s, z, y, x in zip(rng.integers(0, 3, 4000), rng.choice(list("abc"), 4000), rng.integers(-70, 140, 4000), rng.integers(0, 3, 4000), rng.integers(0, 2, 4000), strict=True)]
    found = masks.overlap(spark.createDataFrame(rows, VOXELS).repartition(3), "a", "b")
    of = lambda v, s: {r[2:] for r in rows if r[:2] == (v, s)}
    assert {tuple(r)[:5] for r in found.collect()} == {(v, len(of(v, "a")), len(of(v, "b")), len(of(v, "a") & of(v, "b")), len(of(v, "a") | of(v, "b"))) for v in range(3)}
    assert "bit_or" in found._jdf.queryExecution().optimizedPlan().toString()


def test_resampled_masks_meet_their_grids_in_columns(spark):
    """Repeated voxels give no repeated ones, and slices are counted by their bits, also beyond and below 64."""
    rows = spark.createDataFrame([(1, "a", z, 2, 1) for z in (0, 3, 64, 130, 130)], VOXELS)
    own = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.0, 2.0, 1.0, 1.0, 200, 5, 5)], "volume long, side string, oz double, oy double, ox double, sz double, sy double, sx double, nz int, ny int, nx int")
    near = grids.resample_nearest(rows, own, grids.common_grid(own, ["volume"]), ["volume", "side"], ["volume"])
    assert sorted(tuple(r)[2:] for r in near.collect()) == [(z, 2, 1) for z in (0, 3, 64, 130)]
    assert "bit_or" in near._jdf.queryExecution().optimizedPlan().toString()
    found = series.survival(rows.withColumn("z", F.col("z") - 70), near, ["volume", "side"])
    assert tuple(found.first()) == (1, "a", 4, 4, 1.0) and "count(distinct" not in found._jdf.queryExecution().analyzed().toString().lower()


def test_cube_without_its_inside(spark):
    rows = spark.createDataFrame([(1, "a", *v) for v in product(range(5), repeat=3)], VOXELS)
    assert masks.boundary(rows, ["volume", "side"]).count() == 125 - 27


def test_boundaries_meet_across_tiles(spark):
    """Two masks around the corner of eight tiles, also below zero, with holes and repeated voxels; voxels aren't spread over their neighbours."""
    rng = np.random.default_rng(14)
    sets = {s: {tuple(int(c) for c in at - 4 + shift) for at in np.argwhere(rng.random((9, 8, 8)) < 0.97)} for s, shift in (("a", 0), ("b", 64))}
    rows = [(1, s, *v) for s, m in sets.items() for v in [*m, *list(m)[:20]]]
    found = masks.boundary(spark.createDataFrame(rows, VOXELS).repartition(3), ["volume", "side"])
    around = [d for d in product((-1, 0, 1), repeat=3) if any(d)]
    expected = sorted((1, s, *v) for s, m in sets.items() for v in m if any(tuple(c + i for c, i in zip(v, d, strict=True)) not in m for d in around))
    assert sorted(map(tuple, found.collect())) == expected and len(expected) < sum(map(len, sets.values()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and "Join" not in plan


def test_bundle_takes_repeated_voxels(spark):
    rows = [(1, s, *v) for s in "ab" for v in product(range(3), repeat=3)] + [(1, "b", 0, 0, 5)]
    bundle = lambda r: masks.metric_bundle(spark.createDataFrame(r, VOXELS), "a", "b", (1.0, 1.0, 1.0)).collect()
    assert bundle(rows * 2) == bundle(rows)


def test_surface_distances_by_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = (np.unique(rng.integers(0, 6, (40, 3)), axis=0) for _ in range(2))
    rows = spark.createDataFrame([(1, s, *map(int, v)) for s, m in (("a", a), ("b", b)) for v in m], VOXELS)
    spacing = (2.0, 1.0, 0.5)
    edges = {s: [(r["z"], r["y"], r["x"]) for r in masks.boundary(rows.filter(F.col("side") == s), ["volume", "side"]).collect()] for s in "ab"}
    far = lambda p, q: math.sqrt(sum(((i - j) * s) ** 2 for i, j, s in zip(p, q, spacing, strict=True)))
    expected = sorted(round(min(far(p, q) for q in edges[t]), 9) for s, t in ("ab", "ba") for p in edges[s])
    assert sorted(round(r["d"], 9) for r in masks.surface_distances(rows, "a", "b", spacing).collect()) == expected


def test_largest_part_by_flood_fill(spark):
    rng = np.random.default_rng(6)
    cells = {tuple(map(int, v)) for v in rng.integers(0, 7, (120, 3))}
    parts, left = [], set(cells)
    while left:
        part, todo = set(), [min(left)]
        while todo:
            v = todo.pop()
            if v in left:
                left.remove(v)
                part.add(v)
                todo += [tuple(c + d * (i == axis) for i, c in enumerate(v)) for axis in range(3) for d in (-1, 1)]
        parts.append(part)
    best = max(parts, key=lambda p: (len(p), tuple(-c for c in min(p))))
    rows = spark.createDataFrame([(1, *v) for v in cells], "volume long, z int, y int, x int")
    assert {(r["z"], r["y"], r["x"]) for r in geometry.largest_component(rows, "volume").collect()} == best


def test_no_task_holds_a_whole_mask(spark):
    """Parts of many masks at once, equal ones by their first voxel, without a grouped Python function."""
    rows = [("a", z, 0, 0) for z in range(300)] + [("a", z, 5, 5) for z in range(299)] + [("b", 9, 9, 9), ("b", 1, 2, 3), ("b", 1, 2, 5)]
    found = geometry.largest_component(spark.createDataFrame(rows, "volume string, z int, y int, x int").repartition(5), "volume")
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == sorted([*rows[:300], ("b", 1, 2, 3)])


def test_surfaces_far_apart_meet_across_cells(spark):
    rng = np.random.default_rng(9)
    a = np.unique(rng.integers(0, 40, (60, 3)), axis=0)
    b = np.unique(rng.integers(-50, 90, (60, 3)), axis=0)
    rows = spark.createDataFrame([(1, s, *map(int, v)) for s, m in (("a", a), ("b", b)) for v in m], VOXELS)
    spacing = np.array((2.5, 1.0, 0.5))
    expected = sorted(round(float(np.sqrt((((p - other) * spacing) ** 2).sum(axis=1)).min()), 6) for one, other in ((a, b), (b, a)) for p in one)
    assert sorted(round(r["d"], 6) for r in masks.surface_distances(rows, "a", "b", tuple(spacing)).collect()) == expected


def test_bundle_keeps_pairs_with_an_empty_mask(spark):
    rows = [(1, s, *v) for s in "ab" for v in product(range(2), repeat=3)] + [(2, "a", 0, 0, 0)]
    found = {r["volume"]: r.asDict() for r in masks.metric_bundle(spark.createDataFrame(rows, VOXELS), "a", "b", (1.0, 1.0, 1.0)).collect()}
    assert found[1] == {"volume": 1, "dsc": 1.0, "assd": 0.0, "hd": 0.0, "hd95": 0.0, "nsd": 1.0}
    assert found[2] == {"volume": 2, "dsc": 0.0, "assd": None, "hd": None, "hd95": None, "nsd": None}


def test_a_required_row_that_is_missing_is_an_error(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early")], "k string, n int, v string")
    assert series.required_rows(spark.createDataFrame([("a",)], "k string"), rows, ["k"], ["n"]).collect() == [("a", 1, "early")]
    with pytest.raises(Exception, match="no row for b"):
        series.required_rows(spark.createDataFrame([("b",)], "k string"), rows, ["k"], ["n"]).collect()


@pytest.mark.parametrize("cosines, turns, flips", [((1, 0, 0, 0, 1, 0), 0, ()), ((-1, 0, 0, 0, 1, 0), 0, (1,)), ((1, 0, 0, 0, -1, 0), 0, (0,)), ((-1, 0, 0, 0, -1, 0), 2, ()), ((0, 1, 0, 1, 0, 0), 1, ()), ((0, 1, 0, -1, 0, 0), 3, ())])
def test_orientation_is_that_of_turned_planes(spark, cosines, turns, flips):
    plane = np.zeros((3, 4), bool)
    plane[0, 1] = plane[2, 3] = plane[1, 0] = True
    rows = [(0, int(y), int(x), 3, 4, [float(c) for c in cosines]) for y, x in np.argwhere(plane)]
    expected = np.flip(np.rot90(plane, turns), flips) if flips else np.rot90(plane, turns)
    found = series.reoriented(spark.createDataFrame(rows, "z int, y int, x int, ny int, nx int, cosines array<double>"), "cosines").collect()
    assert {(r["y"], r["x"]) for r in found} == {tuple(map(int, v)) for v in np.argwhere(expected)}
    assert {(r["ny"], r["nx"]) for r in found} == {expected.shape}


def test_extremes_pass_over_missing_values(spark):
    rows = spark.createDataFrame([("p", 0.5, -0.75), ("p", math.nan, 0.5), ("p", 0.75, None), ("q", math.nan, None)], "k string, dsc double, rvd double")
    assert sorted(map(tuple, grids.extremes(rows, "k").collect())) == [("p", 0.5, 0.75), ("q", None, None)]


def test_texts_of_vectors(spark):
    texts = spark.createDataFrame([("[1.5, -2e-3,3 ]",), ("[]",), ("[x,1]",), (None,)], "t string")
    assert [r[0] for r in texts.select(series.text_vector(F.col("t"))).collect()] == [[1.5, -0.002, 3.0], [], [None, 1.0], None]


def test_start_pose_carries_the_moving_centroid_onto_the_fixed_one(spark):
    """A warp under the pose of ``centroid_shift`` moves the moving mask, not the other way round."""
    fixed, moving = [(10, 5, 4), (12, 5, 4)], [(7, 2, 6), (9, 2, 6)]
    rows = spark.createDataFrame([(1, s, *v) for s, m in (("f", fixed), ("m", moving)) for v in m], VOXELS)
    pose = masks.centroid_shift(rows, "f", "m").drop("volume")
    assert tuple(pose.first())[:3] == (3.0, 3.0, -2.0)
    poses = geometry.with_matrix(pose.withColumn("volume", F.lit(1)), (20, 10, 10))
    found = geometry.warp_nearest(rows.filter("side = 'm'"), poses, ["volume"], ["volume"], (20, 10, 10))
    assert sorted(tuple(r)[1:] for r in found.collect()) == fixed


@pytest.mark.parametrize("heights, first, uniform", [((3.0, 2.0, 0.985), 1.0, False), ((2.015, 1.0, 0.0), 1.015, False), ((2.0095, 1.0, 0.0), 1.0095, True), ((5.0,), None, True)])
def test_gaps_are_compared_with_the_topmost(spark, heights, first, uniform):
    row = masks.gaps(spark.createDataFrame([("a", h) for h in heights], "k string, z double"), ["k"]).first()
    assert row["uniform"] is uniform
    assert row["first_gap"] == (None if first is None else pytest.approx(first))


@pytest.mark.parametrize("thickness, heights, step", [(2.5, (4.0,), 2.5), (None, (4.0,), 1.0), (2.5, (4.0, 1.0, 0.5), 3.0)])
def test_step_of_a_grid(spark, thickness, heights, step):
    rows = spark.createDataFrame([("s", z, 0.0, 0.0, 1.0, 1.0, thickness) for z in heights], "k string, z double, y0 double, x0 double, dy double, dx double, thickness double")
    assert geometry.grid_from_slices(rows, "k").first()["sz"] == step


def test_series_match_their_own_patient_only(spark):
    series_rows = spark.createDataFrame([("p", 1, " 1.2.3 ", "Liver CT", 9), ("q", 2, None, "liver (ct)", 9), ("q", 3, None, "CT, Liver", 7), ("q", 4, None, "Arms", None)], "patient string, row int, uid string, description string, n int")
    folders = spark.createDataFrame([("p", "a", "1.2.3", "x", 0), ("q", "b", "1.2.3", "ct liver", 9), ("q", "c", None, "Ct  liver", 1), ("r", "d", "1.2.3", "ct liver", 9), ("q", "e", None, None, 9), (None, "f", "1.2.3", "ct liver", 9)], "patient string, folder string, uid string, description string, n_slices int")
    assert sorted(map(tuple, cohorts.match_series(folders, series_rows).collect())) == [("a", 1, "uid"), ("b", 2, "description and slices"), ("c", 3, "description")]


def test_missing_values_are_no_differences(spark):
    rows = spark.createDataFrame([("g", "a", "t", 2.0, 1.0), ("g", "b", "t", math.nan, 1.0), ("g", "c", "t", None, 1.0), ("g", "d", "t", 1.0, math.nan), ("g", "e", "t", 1.0, 3.0)], "phase string, block string, config string, metric double, control double")
    found = bs.with_controls(rows, "phase", "block", "config", "metric", "control")
    assert sorted(r["block"] for r in found.collect()) == ["a", "e"]
    assert tuple(bs.paired_summary(found, ["config"]).select("n", "zeros", "plus", "minus").first()) == (2, 0, 1, 1)
    assert bs.no_improvement(found, ["config"]).first()["pct_worse"] == 50


def test_of_equally_frequent_acquisitions_the_first_met_stays(spark):
    rows = [("v", ["0", "0", str(z)], None, a, None, seen) for seen, (z, a) in enumerate([(1, 4), (2, 7), (3, 7), (4, 4), (9, None)])]
    found = series.series_slices(spark.createDataFrame(rows, "volume string, position array<string>, location string, acquisition int, wanted int, seen int"), "volume")
    assert [(r["z"], r["place"]) for r in found.orderBy("place").collect()] == [(4.0, 0), (1.0, 1)]
    assert {r["acquisition"] for r in found.collect()} == {4}


def test_an_incomplete_design_fails(spark):
    rows = spark.createDataFrame([("g", "a", "t", 1.0), ("g", "a", "u", 2.0), ("g", "b", "t", 3.0)], "phase string, block string, config string, metric double")
    check = bs.block_check(rows, "phase", "block", "config", "metric", 2)
    with pytest.raises(Exception, match="incomplete block design: g"):
        bs.require_complete(check, "phase").collect()
    whole = bs.block_check(rows.filter("block = 'a'"), "phase", "block", "config", "metric", 2)
    assert bs.require_complete(whole, "phase").first()["complete"]


POSE = "volume long, tz double, ty double, tx double, rz double, ry double, rx double"


def dense_warp(mask, pose):
    """Trilinear interpolation at every output voxel, by numpy: zero where the source point is outside the grid."""
    tz, ty, tx, rz, ry, rx = pose
    turn = lambda a, i, j: np.array([[math.cos(a) if r == c and r in (i, j) else 1.0 if r == c else -math.sin(a) if (r, c) == (i, j) else math.sin(a) if (r, c) == (j, i) else 0.0 for c in range(3)] for r in range(3)])
    # axes (z, y, x) are rows 0 to 2; rz turns the first two, ry the first and third (the other way), rx the last two
    back = (turn(rz, 0, 1) @ turn(-ry, 0, 2) @ turn(rx, 1, 2)).T
    centre = np.array(mask.shape) / 2
    out = np.stack(np.meshgrid(*map(np.arange, mask.shape), indexing="ij"), axis=-1).reshape(-1, 3)
    source = np.round(out @ back.T + centre - back @ centre - back @ np.array((tz, ty, tx)), 6)
    inside = ((source >= 0) & (source <= np.array(mask.shape) - 1)).all(axis=1)
    low, value = np.floor(source).astype(int), np.zeros(len(out))
    for corner in product((0, 1), repeat=3):
        weight = np.prod(np.where(corner, source - low, 1 - (source - low)), axis=1)
        value += weight * mask[tuple(np.minimum(low.clip(0) + corner, np.array(mask.shape) - 1).T)]
    return np.where(inside, value, 0).reshape(mask.shape)


@pytest.mark.parametrize("pose", [(0.5, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0), (1.25, -2.0, 0.5, 0.3, -0.2, 0.1), (0, 0, 0, math.pi / 2, 0, 0), (30.0, 0, 0, 0, 0, 0)])
def test_warps_of_a_cube_and_of_noise(spark, pose):
    """The 10-voxel cube of 20^3 moved by parts of a voxel and turned, and a random mask up to the grid's edge."""
    shape = (20, 20, 20)
    cube, noise = np.zeros(shape), (np.random.default_rng(4).random(shape) < 0.2).astype(float)
    cube[5:15, 5:15, 5:15] = 1
    rows = [(v, *map(int, at)) for v, m in ((1, cube), (2, noise)) for at in np.argwhere(m)]
    frame = spark.createDataFrame(rows, "volume long, z int, y int, x int")
    matrices = geometry.with_matrix(spark.createDataFrame([(v, *map(float, pose)) for v in (1, 2)], POSE), shape)
    found = {(r[0], *r[1:4]): r[4] for r in geometry.warp_linear(frame, matrices, ["volume"], ["volume"], shape).collect()}
    for v, m in ((1, cube), (2, noise)):
        expected = dense_warp(m, pose)
        assert {k[1:]: x for k, x in found.items() if k[0] == v} == pytest.approx({tuple(map(int, at)): expected[tuple(at)] for at in np.argwhere(expected > 5e-10)}, abs=1e-8)
        # above one half, no ties but at the half-voxel shift
        binary = {tuple(r)[1:] for r in geometry.warp_binary(frame.filter(F.col("volume") == v), matrices, ["volume"], ["volume"], shape).collect()}
        assert binary == {tuple(map(int, at)) for at in np.argwhere(np.round(expected, 9) > 0.5)}


def test_inverse_warp_undoes_a_shift(spark):
    shape = (12, 9, 9)
    rows = [(1, int(z), int(y), int(x)) for z, y, x in np.random.default_rng(8).integers(3, 6, (20, 3))]
    frame = spark.createDataFrame(rows, "volume long, z int, y int, x int").distinct()
    matrices = geometry.with_matrix(spark.createDataFrame([(1, 2.0, -1.0, 1.0, 0.0, 0.0, 0.0)], POSE), shape)
    there = geometry.warp_binary(frame, matrices, ["volume"], ["volume"], shape)
    back = geometry.warp_binary(there, geometry.inverted(matrices), ["volume"], ["volume"], shape)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, frame.collect()))


def test_warps_list_no_grid(spark):
    rows = spark.createDataFrame([(1, 2, 2, 2)], "volume long, z int, y int, x int")
    matrices = geometry.with_matrix(spark.createDataFrame([(1, 0.5, 0.0, 0.0, 0.1, 0.0, 0.0)], POSE), (10_000, 10_000, 10_000))
    plan = geometry.warp_binary(rows, matrices, ["volume"], ["volume"], (10_000, 10_000, 10_000))
    assert "Range" not in plan._jdf.queryExecution().optimizedPlan().toString() and plan.count() <= 8


def test_warps_meet_across_tiles(spark):
    """A mask of several tiles and columns, turned, with repeated voxels, against the dense warp; each tile gets what is around it."""
    shape, pose = (150, 70, 5), (3.5, -2.25, 0.5, 0.2, 0.05, -0.02)
    mask = np.zeros(shape)
    mask[40:140, 20:68, 1:4] = np.random.default_rng(3).random((100, 48, 3)) < 0.7
    rows = [(1, *map(int, at)) for at in np.argwhere(mask)]
    frame = spark.createDataFrame([*rows, *rows[:50]], "volume long, z int, y int, x int").repartition(3)
    matrices = geometry.with_matrix(spark.createDataFrame([(1, *pose)], POSE), shape)
    found = {tuple(r)[1:4]: r["value"] for r in geometry.warp_linear(frame, matrices, ["volume"], ["volume"], shape).collect()}
    expected = dense_warp(mask, pose)
    assert found == pytest.approx({tuple(map(int, at)): expected[tuple(at)] for at in np.argwhere(expected > 5e-10)}, abs=1e-8)


def test_warps_shuffle_columns_of_voxels(spark):
    """No row for each voxel and its surroundings: what is grouped are columns of 64 voxels, and warped voxels aren't."""
    rows = spark.range(200).select(F.lit(1).cast("long").alias("volume"), *[F.expr(e).cast("int").alias(c) for c, e in (("z", "id % 50"), ("y", "id div 50"), ("x", "0"))])
    matrices = geometry.with_matrix(spark.createDataFrame([(1, 0.5, 0.0, 0.0, 0.1, 0.0, 0.0)], POSE), (51, 11, 9))
    plan = geometry.warp_binary(rows, matrices, ["volume"], ["volume"], (51, 11, 9))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "sum(" not in plan and plan.count("Aggregate") == 2 and "bit_or" in plan


def nearest_by_hand(left, right, limit):
    out = []
    for k, at in left:
        near = sorted((abs(at - r), -r) for q, r in right if q == k and k is not None and r is not None and at is not None and abs(at - r) < limit)
        out.append((k, at, -near[0][1] if near else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, span", [(0, 40), (1, 4), (2, 4000)])
def test_nearest_partners_by_all_pairs(spark, seed, span):
    """Ties, repeated rows, places on both sides, rows without key or place, and a key that has nearly all rows."""
    rng = np.random.default_rng(seed)
    draw = lambda n: [(str(rng.choice(["hot"] * 9 + ["b", "c"])), float(rng.integers(0, span)) / 2) for _ in range(n)]
    left, right = draw(300) + [(None, 1.0), ("hot", None), ("alone", 1.0)], draw(200) + [(None, 1.0), ("hot", None)]
    table = lambda rows: spark.createDataFrame(rows, "k string, t double").repartition(3)
    found = masks.nearest_within(table(left), table(right), "k", "t", 2.0).collect()
    assert sorted(map(tuple, found), key=str) == nearest_by_hand(left, right, 2.0)


def test_nearest_partners_need_no_pairs(spark):
    """Where all share a key and lie within the limit, no join is by key and place alone."""
    rows = spark.range(3000).select(F.lit("hot").alias("k"), (F.col("id") / 3000).alias("t"))
    found = masks.nearest_within(rows, rows.withColumn("t", F.col("t") + 1e-5), "k", "t", 3600.0)
    assert found.count() == 3000
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert len(joins) == 1 and "_range" in joins[0]
    assert found.filter("abs(other - t) > 0.0001").isEmpty()


def test_failed_items_are_set_aside(spark):
    rows = [("p", "pv", 1), ("p", "arterial", 2), ("q", "pv", -1), ("q", "arterial", 3), ("r", "arterial", -5), ("r", "pv", None), (None, "pv", -1), (None, "arterial", 2)]
    items = spark.createDataFrame(rows, "patient string, phase string, n int")
    good, failed = series.set_aside(items, {"negative": F.col("n") < 0, "large": F.col("n") < -3}, "pv")
    assert sorted(map(tuple, good.collect()), key=str) == sorted([("p", "pv", 1), ("p", "arterial", 2), ("r", "pv", None), (None, "arterial", 2)], key=str)
    assert sorted(((r["patient"], r["phase"], r["error"]) for r in failed.collect()), key=str) == sorted([("q", "pv", "negative"), ("q", "arterial", "pv failed"), ("r", "arterial", "negative"), (None, "pv", "negative")], key=str)
    known = spark.createDataFrame([("q", "pv"), ("q", "arterial"), ("s", "arterial")], "patient string, phase string")
    report = {(r["kind"], r["reason"]): r["n"] for r in series.outcome_report(known, good.filter("patient IS NOT NULL"), failed.filter("patient IS NOT NULL"), "pv").collect()}
    assert report == {("patients", "usable"): 2, ("patients", "fewer than 2 phases"): 1, ("patients", "no pv"): 1, ("items", "negative"): 2, ("items", "pv failed"): 1}
