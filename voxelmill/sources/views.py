"""Views of the supplied tables that stand for experiments, masks, catalogues, studies and histories.

Every view is given as a DataFrame and as the same relation in DuckDB SQL (for WITH).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table


def experiments(spark: SparkSession, folder: str) -> DataFrame:
    """(block, phase, loss, optimizer, config, metric, cost, control, start): nations, parity of the order's month, priorities, states."""
    orders, customer, nation = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    rows = (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("block"), F.when(F.month("o_orderdate") % 2 == 0, "even").otherwise("odd").alias("phase"), F.col("o_orderpriority").alias("loss"), F.col("o_orderstatus").alias("optimizer"), "o_totalprice")
    )
    facts = rows.groupBy("block", "phase", "loss", "optimizer").agg(F.round(F.avg("o_totalprice"), 6).alias("metric"), F.count(F.lit(1)).alias("cost"))
    controls = rows.groupBy("block", "phase").agg(F.round(F.avg("o_totalprice"), 6).alias("control"), F.min("o_totalprice").alias("start"))
    return facts.join(controls, ["block", "phase"]).withColumn("config", F.concat_ws("_", "loss", "optimizer"))


EXPERIMENTS = """
exp_rows AS (SELECT n_name AS block, CASE WHEN month(o_orderdate) % 2 = 0 THEN 'even' ELSE 'odd' END AS phase, o_orderpriority AS loss, o_orderstatus AS optimizer, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
exp AS (SELECT f.*, c.control, c.start, f.loss || '_' || f.optimizer AS config
  FROM (SELECT block, phase, loss, optimizer, round(avg(o_totalprice), 6) AS metric, count(*) AS cost FROM exp_rows GROUP BY ALL) f
  JOIN (SELECT block, phase, round(avg(o_totalprice), 6) AS control, min(o_totalprice) AS start FROM exp_rows GROUP BY ALL) c USING (block, phase))"""


def masks(spark: SparkSession, folder: str) -> DataFrame:
    """(volume, side, z, y, x): two masks for each supplier."""
    return repeated_voxels(spark, folder).distinct()


def repeated_voxels(spark: SparkSession, folder: str) -> DataFrame:
    """``masks`` with a row for each line item, for operators to which repeated voxels make no difference."""
    return table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("volume"), F.col("l_linestatus").alias("side"), *voxel_columns())


def voxel_columns() -> list:
    return [F.col("l_quantity").cast("int").alias("z"), F.round(F.col("l_discount") * 100).cast("int").alias("y"), F.round(F.col("l_tax") * 100).cast("int").alias("x")]


VOXEL = "CAST(l_quantity AS INTEGER) AS z, CAST(round(l_discount * 100) AS INTEGER) AS y, CAST(round(l_tax * 100) AS INTEGER) AS x"
MASKS = f"vox AS (SELECT DISTINCT l_suppkey AS volume, l_linestatus AS side, {VOXEL} FROM lineitem)"
#: A dense mask's voxel stands for at least its share of so many parts of the table.
DENSE_PARTS = 15_000


def dense_masks(spark: SparkSession, folder: str) -> DataFrame:
    """(volume, side, z, y, x): two masks with an interior, of the voxels with enough rows."""
    rows = table(spark, folder, "lineitem")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    counted = rows.select(F.col("l_linestatus").alias("side"), *voxel_columns()).groupBy("side", "z", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(total)).filter(F.col("n") * DENSE_PARTS >= F.col("total")).select(F.lit(0).cast("long").alias("volume"), "side", "z", "y", "x")


DENSE_MASKS = f"""dense_n AS (SELECT l_linestatus AS side, {VOXEL}, count(*) AS n FROM lineitem GROUP BY ALL),
dense AS (SELECT CAST(0 AS BIGINT) AS volume, side, z, y, x FROM dense_n WHERE n * {DENSE_PARTS} >= (SELECT count(*) FROM lineitem))"""


def solid_masks(spark: SparkSession, folder: str) -> DataFrame:
    """(volume, side, z, y, x): the masks of ``masks`` with all between the lowest and the highest voxel of each column."""
    ends = repeated_voxels(spark, folder).groupBy("volume", "side", "y", "x").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    return ends.select("volume", "side", F.explode(F.sequence("low", "high")).alias("z"), "y", "x")


SOLID_MASKS = f"""{MASKS}, solid AS (SELECT volume, side, CAST(unnest(range(low, high + 1)) AS INTEGER) AS z, y, x FROM (SELECT volume, side, y, x, min(z) AS low, max(z) AS high FROM vox GROUP BY ALL))"""


def labelled_voxels(spark: SparkSession, folder: str) -> DataFrame:
    """(volume, z, y, x, label): label 2 for returned rows, 1 for the others; voxels may have both."""
    label = F.when(F.col("l_returnflag") == "R", 2).otherwise(1)
    return table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("volume"), *voxel_columns(), label.alias("label"))


LABELLED = f"lab AS (SELECT l_suppkey AS volume, {VOXEL}, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS label FROM lineitem)"


def series(spark: SparkSession, folder: str) -> DataFrame:
    """(row, uid, description, n): catalogue rows; some have their uid in the description, of these some have another one in its place, and some have none."""
    key, uid = F.col("p_partkey"), F.concat(F.lit("1.2."), F.col("p_partkey").cast("string"))
    return table(spark, folder, "part").select(
        key.alias("row"),
        F.when(key % 5 > 1, uid).when(key % 10 == 0, F.lit("0.0")).alias("uid"),
        F.when(key % 5 == 0, uid).otherwise(F.concat(F.lit(" "), F.upper("p_name"), F.lit("  (CT)."))).alias("description"),
        F.col("p_size").alias("n"),
    )


SERIES = """series AS (SELECT p_partkey AS row, CASE WHEN p_partkey % 5 > 1 THEN '1.2.' || p_partkey WHEN p_partkey % 10 = 0 THEN '0.0' END AS uid,
  CASE WHEN p_partkey % 5 = 0 THEN '1.2.' || p_partkey ELSE ' ' || upper(p_name) || '  (CT).' END AS description, p_size AS n FROM part)"""


def raw_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue rows as they are typed in: padded names, phases in mixed case, uids in either column."""
    key = F.col("row")
    phase = F.element_at(F.array(*map(F.lit, (" PV", "Arterial ", "pre-contrast", "delayed", "pv"))), (key % 5 + 1).cast("int"))
    return series(spark, folder).select("*", F.concat(F.lit(" p"), (key % 40).cast("string"), F.lit("  ")).alias("name"), phase.alias("phase"), F.date_add(F.lit("2020-01-01").cast("date"), (key % 3).cast("int")).alias("study_date"))


RAW_CATALOGUE = SERIES + """, raw AS (SELECT *, ' p' || (row % 40) || '  ' AS name, [' PV', 'Arterial ', 'pre-contrast', 'delayed', 'pv'][row % 5 + 1] AS phase, DATE '2020-01-01' + CAST(row % 3 AS INTEGER) AS study_date FROM series),
catalogue AS (SELECT row, trim(name) AS name, lower(trim(phase)) AS phase, study_date, n,
  CASE WHEN regexp_matches(description, '^[0-9.]+$') AND contains(description, '.') THEN description ELSE uid END AS uid,
  CASE WHEN NOT (regexp_matches(description, '^[0-9.]+$') AND contains(description, '.')) THEN description END AS description FROM raw)"""


def folders(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, uid, description, n_slices): series folders to be matched with the catalogue."""
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.alias("folder"),
        F.when(key % 3 == 0, F.concat(F.lit("1.2."), key.cast("string"))).otherwise(F.concat(F.lit("9.9."), key.cast("string"))).alias("uid"),
        F.concat(F.col("p_name"), F.when(key % 7 == 0, F.lit(" other")).otherwise(F.lit(" ct"))).alias("description"),
        F.when(key % 2 == 0, F.col("p_size")).otherwise(F.lit(0)).alias("n_slices"),
    )


FOLDERS = """folders AS (SELECT p_partkey AS folder, CASE WHEN p_partkey % 3 = 0 THEN '1.2.' || p_partkey ELSE '9.9.' || p_partkey END AS uid,
  p_name || CASE WHEN p_partkey % 7 = 0 THEN ' other' ELSE ' ct' END AS description, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END AS n_slices FROM part)"""


def studies(spark: SparkSession, folder: str) -> DataFrame:
    """(name, study_date, phase, series): customers' orders as imaging studies."""
    phases = {"1-URGENT": "pv", "2-HIGH": "arterial", "3-MEDIUM": "pre-contrast"}
    phase = F.coalesce(F.create_map(*[F.lit(x) for pair in phases.items() for x in pair])[F.col("o_orderpriority")], F.lit("delayed"))
    day = F.date_trunc("month", "o_orderdate").cast("date")
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("name"), day.alias("study_date"), phase.alias("phase"), F.col("o_orderkey").alias("series"))


STUDIES = """studies AS (SELECT o_custkey AS name, CAST(date_trunc('month', o_orderdate) AS DATE) AS study_date,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'pv' WHEN '2-HIGH' THEN 'arterial' WHEN '3-MEDIUM' THEN 'pre-contrast' ELSE 'delayed' END AS phase, o_orderkey AS series FROM orders)"""


def histories(spark: SparkSession, folder: str) -> DataFrame:
    """(run, idx, loss, dsc): users' events in order as evaluations of a run."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select(F.col("user_id").alias("run"), (F.row_number().over(order) - 1).alias("idx"), F.col("value").alias("loss"), F.round(F.col("value") / 10, 0).alias("dsc"))


HISTORIES = "hist AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS loss, round(value / 10, 0) AS dsc FROM events)"
