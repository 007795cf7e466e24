"""Results in files: encodings, order, and a table that batches are put into."""

import pytest
from pyspark.sql import functions as F

from voxelmill.sources import master, tables

SCHEMA = "name string, metric double, n int"


def test_each_file_has_its_own_encoding_and_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,metric,n\r\nfígado,1.5,3\r\n\"x, y\",,\r\n".encode())
    (tmp_path / "b.csv").write_bytes("n,name\nbad,fígado\n7,\n".encode("latin-1"))
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper" / "c.csv").write_bytes(b"name\n")
    found = {(r["file"].rsplit("/", 1)[1], r["name"], r["metric"], r["n"]) for r in tables.read_results(spark, str(tmp_path), SCHEMA).collect()}
    assert found == {("a.csv", "fígado", 1.5, 3), ("a.csv", "x, y", None, None), ("b.csv", "fígado", None, None), ("b.csv", None, None, 7)}


def test_files_are_in_order(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") * 37 % 101).alias("key"), "id").repartition(4)
    tables.write_in_order(rows, str(tmp_path / "t"), "key", "id")
    lines = [line for p in sorted((tmp_path / "t").glob("part-*")) for line in p.read_text().splitlines() if line != "key,id"]
    keys = [tuple(map(int, line.split(","))) for line in lines]
    assert keys == sorted(keys) and len(keys) == 500


def batch(spark, rows):
    return spark.createDataFrame(rows, "config string, v int")


def rows_of(spark, path):
    return sorted(map(tuple, master.read(spark, path, "config", "v int, config string").select("config", "v").collect()))


def test_batches_replace_their_configurations(spark, tmp_path):
    path = str(tmp_path / "m")
    assert master.latest(spark, path) == 0
    assert master.put(batch(spark, [("a", 1), ("a", 2), ("b", 3)]), path, "config", "first") == 1
    assert master.put(batch(spark, [("a", 9), ("c", 4)]), path, "config", "second") == 2
    expected = [("a", 9), ("b", 3), ("c", 4)]
    assert rows_of(spark, path) == expected
    master.put(batch(spark, [("a", 9), ("c", 4)]), path, "config", "second")
    assert rows_of(spark, path) == expected
    old = master.read(spark, path, "config", "v int, config string")  # planned before, read after the next batch
    master.put(batch(spark, [("b", 0)]), path, "config", "third")
    assert old.count() == 3 and rows_of(spark, path) == [("a", 9), ("b", 0), ("c", 4)]


def test_a_batch_that_fails_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "m")
    master.put(batch(spark, [("a", 1)]), path, "config", "first")
    with pytest.raises(Exception, match="no config"):
        master.put(batch(spark, [("a", 2), (None, 3)]), path, "config", "second")
    assert rows_of(spark, path) == [("a", 1)]
    master.put(batch(spark, [("a", 2)]), path, "config", "second")
    assert rows_of(spark, path) == [("a", 2)]


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    master.put(batch(spark, [("a", 1)]), path, "config", "first")
    monkeypatch.setattr(master, "latest", lambda *_: 0)
    with pytest.raises(RuntimeError, match="another batch"):
        master.put(batch(spark, [("a", 2)]), path, "config", "second")
    monkeypatch.undo()
    assert rows_of(spark, path) == [("a", 1)] and not list((tmp_path / "m" / "manifest").glob("_attempt*"))
