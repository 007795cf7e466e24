"""Queries that write files made of the supplied tables and read them back, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxelmill.operators import series
from voxelmill.shared import fresh_path
from voxelmill.sources import master, npy, tables, views
from voxelmill.sources.views import EXPERIMENTS, HISTORIES, MASKS

from . import imaging
from .imaging import GRID

#: A configuration's label with a letter that the two encodings write differently.
LABELLED = "àrea "


def mask_files(spark, d):
    """Each supplier's masks as one file a side, read back without background."""
    path = fresh_path(spark, "mask-files")
    voxels = views.masks(spark, d).withColumns({"file": F.concat_ws("/", F.col("volume").cast("string"), F.concat("side", F.lit("_segmentation.npy"))), "shape": F.array(*map(F.lit, GRID)), "value": F.lit(1)})
    npy.write_arrays(voxels, path, ["z", "y", "x"])
    found = npy.read_arrays(spark, path, ["z", "y", "x"], nonzero=True)
    part = lambda k: F.regexp_extract("file", "([0-9]+)/([A-Z])_segmentation.npy$", k)
    return found.select(part(1).cast("long").alias("volume"), part(2).alias("side"), "z", "y", "x")


def history_files(spark, d):
    """Each run's losses, or losses and scores where it has an even number, as one file; the two kinds lie in folders of their own."""
    path = fresh_path(spark, "history-files")
    runs = views.histories(spark, d)
    length = F.count(F.lit(1)).over(Window.partitionBy("run"))
    placed = runs.withColumns({"idx": F.col("idx").cast("int"), "n": length.cast("int"), "file": F.concat(F.col("run").cast("string"), F.lit(".npy"))})
    single = placed.filter("run % 2 = 1").select("file", F.array("n").alias("shape"), "idx", F.col("loss").alias("value"))
    columns = F.explode(F.array(F.struct(F.lit(0).alias("column"), F.col("loss").alias("value")), F.struct(F.lit(1).alias("column"), F.col("dsc").alias("value"))))
    double = placed.filter("run % 2 = 0").select("file", F.array("n", F.lit(2)).alias("shape"), "idx", columns.alias("c")).select("file", "shape", "idx", "c.*")
    npy.write_arrays(single, f"{path}/losses", ["idx"], "f8")
    npy.write_arrays(double, f"{path}/both", ["idx", "column"], "f8")
    run = F.regexp_extract("file", "([0-9]+).npy$", 1).cast("long").alias("run")
    losses = npy.read_arrays(spark, f"{path}/losses", ["idx"]).select(run, "idx", F.col("value").alias("loss"), F.lit(None).cast("double").alias("dsc"))
    value = lambda k: F.max(F.when(F.col("column") == k, F.col("value")))
    both = npy.read_arrays(spark, f"{path}/both", ["idx", "column"]).groupBy(run, "idx").agg(value(0).alias("loss"), value(1).alias("dsc"))
    return losses.unionByName(both).select("run", F.col("idx").cast("long").alias("idx"), "loss", "dsc")


def result_files(spark, d):
    """Experiments written phase by phase, the even one's files in Latin-1 and with other columns first, read back together."""
    path = fresh_path(spark, "result-files")
    facts = views.experiments(spark, d).select("block", "phase", F.concat(F.lit(LABELLED), "config").alias("config"), F.when(F.col("cost") > 2, F.col("metric")).alias("metric"), "cost")
    tables.write_results(facts.filter("phase = 'odd'"), f"{path}/odd")
    tables.write_results(facts.filter("phase = 'even'").select("cost", "config", "metric", "phase", "block"), f"{path}/even", "ISO-8859-1")
    return tables.read_results(spark, path, "block string, phase string, config string, metric double, cost long, absent string").drop("file")


def committed_master(spark, d):
    """A table of results after two batches of configurations, the second of which is put in twice."""
    path = fresh_path(spark, "master")
    facts = views.experiments(spark, d).select("block", "phase", "config", "metric")
    raised = lambda prefix, by: facts.filter(F.col("config").startswith(prefix)).withColumn("metric", F.round(F.col("metric") + by, 6))
    master.put(facts, path, "config", "all")
    master.put(raised("1-", 1), path, "config", "urgent")
    for _ in range(2):
        master.put(raised("2-", 2).unionByName(raised("1-URGENT_F", 5)), path, "config", "high")
    return master.read(spark, path, "config", "block string, phase string, metric double, config string").select("block", "phase", "config", "metric")


def tasks_left(spark, d):
    """Tasks of which the committed table has no result: those of one optimizer, and of one block, haven't been run."""
    path = fresh_path(spark, "master")
    facts = views.experiments(spark, d).select("block", "phase", "config", "metric")
    master.put(facts.filter("config NOT LIKE '%/_P' ESCAPE '/' AND block <> 'FRANCE'"), path, "config", "some")
    done = master.read(spark, path, "config", "block string, phase string, metric double, config string")
    return series.not_done(facts.select("block", "phase", "config"), done, ["block", "phase", "config"])


def quality_file(spark, d):
    """The most suspicious patients first, written in that order and read back."""
    path = fresh_path(spark, "quality")
    found = imaging.quality(spark, d).withColumn("worst", F.least("dsc_pv_pre", "dsc_art_pre", "dsc_pv_art"))
    tables.write_in_order(found.withColumn("suspicion", F.coalesce("worst", F.lit(1.0))), path, "suspicion", "patient")
    return tables.read_results(spark, path, "patient long, dsc_pv_pre double, dsc_art_pre double, dsc_pv_art double, worst double").drop("file")


def slice_files(spark, d):
    """Series folders of empty slice files listed and counted; suffixes are in either case, and other files don't count."""
    path = fresh_path(spark, "slice-files")
    rows = tables.table(spark, d, "nation").select(F.col("n_regionkey").alias("folder"), F.concat(F.col("n_name"), F.when(F.col("n_nationkey") % 3 == 0, ".DCM").when(F.col("n_nationkey") % 3 == 1, ".dcm").otherwise(".npy")).alias("name"))
    npy.write_arrays(rows.select(F.concat_ws("/", F.col("folder").cast("string"), F.regexp_replace("name", " ", "_")).alias("file"), F.array(F.lit(1)).alias("shape"), F.lit(0).alias("i"), F.lit(0).alias("value")), path, ["i"])
    listed = tables.list_files(spark, path)
    folder = F.regexp_extract("folder", "([0-9]+)$", 1).cast("int").alias("folder")
    counted = tables.count_slices(listed).select(folder, "n_slices")
    ends = listed.groupBy(folder).agg(F.min("name").alias("first"), F.count(F.lit(1)).alias("n_files"))
    return ends.join(counted, "folder", "left")


QUERIES = {
    "mask_files": mask_files,
    "history_files": history_files,
    "result_files": result_files,
    "committed_master": committed_master,
    "tasks_left": tasks_left,
    "quality_file": quality_file,
    "slice_files": slice_files,
}

ORACLE_SQL = {
    "mask_files": f"WITH {MASKS} SELECT volume, side, z, y, x FROM vox",
    "history_files": f"WITH {HISTORIES} SELECT run, idx, loss, CASE WHEN run % 2 = 0 THEN dsc END AS dsc FROM hist",
    "result_files": f"WITH {EXPERIMENTS} SELECT block, phase, '{LABELLED}' || config AS config, CASE WHEN cost > 2 THEN metric END AS metric, cost, CAST(NULL AS VARCHAR) AS absent FROM exp",
    "committed_master": f"""WITH {EXPERIMENTS} SELECT block, phase, config, CASE WHEN config = '1-URGENT_F' THEN round(metric + 5, 6) WHEN config LIKE '1-%' THEN round(metric + 1, 6) WHEN config LIKE '2-%' THEN round(metric + 2, 6) ELSE metric END AS metric FROM exp""",
    "tasks_left": f"WITH {EXPERIMENTS} SELECT block, phase, config FROM exp WHERE config LIKE '%/_P' ESCAPE '/' OR block = 'FRANCE'",
    "quality_file": imaging.ORACLE_SQL["pair_quality"],
    "slice_files": """WITH f AS (SELECT n_regionkey AS folder, replace(n_name, ' ', '_') || CASE n_nationkey % 3 WHEN 0 THEN '.DCM' WHEN 1 THEN '.dcm' ELSE '.npy' END AS name FROM nation)
SELECT folder, min(name) AS first, count(*) AS n_files, nullif(count(*) FILTER (lower(name) LIKE '%.dcm'), 0) AS n_slices FROM f GROUP BY folder""",
}
