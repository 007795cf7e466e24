"""Arrays in files against numpy's own reading and writing."""

import numpy as np
import pytest

from voxelmill.sources import npy


@pytest.mark.parametrize("kind", ["b1", "u1", "i2", "<i4", ">i4", "f4", ">f8", "u4"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_reads_what_numpy_has_written(spark, tmp_path, kind, order):
    array = np.asarray(np.random.default_rng(1).integers(0, 3, (4, 3, 5)).astype(kind), order=order)
    np.save(tmp_path / "a.npy", array)
    read = spark.read.format("npy") if spark.dataSource.register(npy.NpyDataSource) is None else None
    found = read.option("splitBytes", "37").option("axes", "z,y,x").load(str(tmp_path))
    assert found.rdd.getNumPartitions() > 1
    rows = found.collect()
    assert len(rows) == array.size and all(r["value"] == array[r["z"], r["y"], r["x"]] for r in rows)
    assert len({(r["z"], r["y"], r["x"]) for r in rows}) == array.size


def test_small_files_share_a_task_and_zeros_can_be_left_out(spark, tmp_path):
    (tmp_path / "deeper").mkdir()
    for name, values in (("b", [0, 4, 0]), ("a", [1, 0, 2]), ("deeper/c", [0, 0, 0])):
        np.save(tmp_path / f"{name}.npy", np.array(values, np.int64))
    found = npy.read_arrays(spark, str(tmp_path), nonzero=True)
    assert found.rdd.getNumPartitions() == 1 and found.columns == ["file", "i0", "value"]
    assert [(r["file"].rsplit("/", 1)[1], r["i0"], r["value"]) for r in found.collect()] == [("a.npy", 0, 1), ("a.npy", 2, 2), ("b.npy", 1, 4)]


def test_numpy_reads_what_is_written(spark, tmp_path):
    rows = [("p/one.npy", [3, 2, 4], 2, 1, 3, 7), ("p/one.npy", [3, 2, 4], 0, 0, 1, 5), ("p/one.npy", [3, 2, 4], 0, 0, 1, 4), ("two.npy", [1, 1, 90], 0, 0, 60, 1), (None, [1, 1, 1], 0, 0, 0, 1), ("two.npy", [1, 1, 90], 0, None, 0, 1)]
    frame = spark.createDataFrame(rows, "file string, shape array<int>, z int, y int, x int, value int").repartition(3)
    for _ in range(2):  # a rerun replaces the files
        npy.write_arrays(frame, str(tmp_path), ["z", "y", "x"])
    one, two = np.load(tmp_path / "p" / "one.npy"), np.load(tmp_path / "two.npy")
    assert one.dtype == np.uint8 and one.shape == (3, 2, 4) and one.sum() == 12 and one[2, 1, 3] == 7 and one[0, 0, 1] == 5
    assert two.shape == (1, 1, 90) and np.flatnonzero(two).tolist() == [60]
    assert sorted(p.name for p in tmp_path.rglob("*")) == ["one.npy", "p", "two.npy"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    np.save(tmp_path / "kept.npy", np.arange(3, dtype=np.uint8))
    bad = spark.createDataFrame([("a.npy", [2], 0, 1), ("b.npy", [2], 5, 1)], "file string, shape array<int>, i int, value int")
    with pytest.raises(Exception, match="invalid entry"):
        npy.write_arrays(bad, str(tmp_path), ["i"])
    assert [p.name for p in tmp_path.iterdir()] == ["kept.npy"]


def test_files_must_be_alike(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((2, 2)))
    np.save(tmp_path / "b.npy", np.zeros(3))
    with pytest.raises(Exception, match="other axes"):
        npy.read_arrays(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="no .npy files"):
        npy.read_arrays(spark, str(tmp_path / "nowhere")).collect()


def test_empty_arrays_and_scalars(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((0, 3), np.uint8))
    assert npy.read_arrays(spark, str(tmp_path)).count() == 0
    np.save(tmp_path / "a.npy", np.array(2.5))
    assert [tuple(r)[1:] for r in npy.read_arrays(spark, str(tmp_path)).collect()] == [(2.5,)]
