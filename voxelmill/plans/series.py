"""Queries on series of slices, physical grids and what is to be done with them, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill.operators import cohorts, geometry, grids, masks, series
from voxelmill.sources import views
from voxelmill.sources.tables import table
from voxelmill.sources.views import DENSE_MASKS, EXPERIMENTS, MASKS, STUDIES

from . import imaging, statistics
from .imaging import SHAPE, SPACING, rounded

AXES = ("z", "y", "x")
#: Origin and signed step by axis of the grids of the two sides.
GRIDS = {"F": ((100.0, 0.0, 0.0), (-1.0, 0.5, 0.5)), "O": ((99.5, 0.25, -0.25), (-2.0, 0.5, 1.0))}
#: In-plane orientations (name, six direction cosines).
ORIENTATIONS = {
    "standard": (1, 0, 0, 0, 1, 0), "rows": (-1, 0, 0, 0, 1, 0), "columns": (1, 0, 0, 0, -1, 0), "both": (-1, 0, 0, 0, -1, 0),
    "quarter": (0, 1, 0, 1, 0, 0), "three quarters": (0, 1, 0, -1, 0, 0), "tilted": (0.9999, 0.0001, 0, 0, 0.9999, 0),
}


def slices(spark, d):
    """(volume, position, location, acquisition, wanted, seen): line items as slices; some have no height, some no acquisition."""
    item, z = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    height = F.when(item == 6, "n/a").otherwise(z.cast("string"))
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("volume"),
        F.when(item != 7, F.array(F.lit("0"), F.lit("0"), height)).alias("position"),
        F.when((item != 7) | (F.col("l_orderkey") % 2 != 0), (z + 100).cast("string")).alias("location"),
        F.when(item % 3 != 0, item % 3).alias("acquisition"),
        F.when(F.col("l_suppkey") % 3 == 1, 2).when(F.col("l_suppkey") % 3 == 2, 9).alias("wanted"),
        (F.col("l_orderkey") * 10 + item).alias("seen"),
    )


SLICES = """slices AS (SELECT l_suppkey AS volume, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS height,
  CASE WHEN l_linenumber <> 7 OR l_orderkey % 2 <> 0 THEN CAST(CAST(l_quantity AS INTEGER) + 100 AS VARCHAR) END AS location,
  CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber % 3 END AS acquisition, CASE l_suppkey % 3 WHEN 1 THEN 2 WHEN 2 THEN 9 END AS wanted, l_orderkey * 10 + l_linenumber AS seen FROM lineitem)"""


def frames(spark, d):
    """(volume, side, frame, z, y0, x0, dy, dx, between, cosines): line items as frames of segmentations."""
    item = F.col("l_linenumber")
    cosines = lambda name: F.array(*[F.lit(float(c)) for c in ORIENTATIONS[name]])
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("volume"),
        F.col("l_linestatus").alias("side"),
        (F.col("l_orderkey") * 10 + item).alias("frame"),
        (F.col("l_quantity").cast("double") * 1.25).alias("z"),
        (item * 0.5).alias("y0"),
        (item * -0.25).alias("x0"),
        F.lit(0.5).alias("dy"),
        F.lit(0.75).alias("dx"),
        F.when(item % 2 == 0, 2.5).alias("between"),
        F.when(item % 2 == 0, cosines("standard")).otherwise(cosines("quarter")).alias("cosines"),
    )


FRAMES = """frames AS (SELECT l_suppkey AS volume, l_linestatus AS side, l_orderkey * 10 + l_linenumber AS frame, CAST(l_quantity AS DOUBLE) * 1.25 AS z, l_linenumber AS item FROM lineitem)"""


def grid_table(keys):
    """Every mask's grid, from its side."""
    pick = lambda part, i: F.when(F.col("side") == "F", GRIDS["F"][part][i]).otherwise(GRIDS["O"][part][i])
    columns = {f"{p}{a}": pick(part, i) for part, p in enumerate("os") for i, a in enumerate(AXES)}
    return keys.select("volume", "side").distinct().withColumns({**columns, **{f"n{a}": F.lit(SHAPE[a]) for a in AXES}})


def grids_sql(source: str) -> str:
    columns = ", ".join(f"CAST(CASE side WHEN 'F' THEN {GRIDS['F'][part][i]} ELSE {GRIDS['O'][part][i]} END AS DOUBLE) AS {p}{a}" for part, p in enumerate("os") for i, a in enumerate(AXES))
    sizes = ", ".join(f"{SHAPE[a]} AS n{a}" for a in AXES)
    low = lambda a: f"min(least(o{a}, o{a} + s{a} * (n{a} - 1)))"
    high = lambda a: f"max(greatest(o{a}, o{a} + s{a} * (n{a} - 1)))"
    target = ", ".join(f"{low(a)} AS to{a}, min(abs(s{a})) AS ts{a}, CAST(ceil(({high(a)} - {low(a)}) / min(abs(s{a}))) AS INTEGER) + 1 AS tn{a}" for a in AXES)
    return f"""grids AS (SELECT DISTINCT volume, side, {columns}, {sizes} FROM {source}), common AS (SELECT volume, {target} FROM grids GROUP BY volume)"""


def places_sql() -> str:
    """For every axis and target index i the place on each source grid."""
    return ", ".join(f"at_{a} AS (SELECT volume, side, n{a} AS n, i, (to{a} + i * ts{a} - o{a}) / s{a} AS place FROM (SELECT *, unnest(range(tn{a})) AS i FROM grids JOIN common USING (volume)))" for a in AXES)


def nearest_sql(source: str) -> str:
    joins = " ".join(f"JOIN at_{a} ON at_{a}.volume = v.volume AND at_{a}.side = v.side AND floor(at_{a}.place + 0.5) = v.{a}" for a in AXES)
    return f"""{grids_sql(source)}, {places_sql()}, near AS (SELECT v.volume, v.side, {', '.join(f'CAST(at_{a}.i AS INTEGER) AS {a}' for a in AXES)} FROM {source} v {joins})"""


def resampled(spark, d):
    voxels = views.repeated_voxels(spark, d)
    own = grid_table(voxels)
    return grids.resample_nearest(voxels, own, grids.common_grid(own, ["volume"]), ["volume", "side"], ["volume"])


def counts(spark, d):
    """(volume, side, z, y, x, hu): the number of line items at each voxel as a CT."""
    rows = table(spark, d, "lineitem").select(F.lit(0).alias("volume"), F.col("l_linestatus").alias("side"), *views.voxel_columns())
    return rows.groupBy("volume", "side", *AXES).agg(F.count(F.lit(1)).alias("hu"))


def resample_linear(spark, d):
    values = counts(spark, d)
    own = grid_table(values)
    return grids.resample_linear(values, own, grids.common_grid(own, ["volume"]), ["volume", "side"], ["volume"])


def linear_sql() -> str:
    weights = ", ".join(
        f"w_{a} AS (SELECT volume, side, i, k, 1 - abs(place - k) AS w FROM (SELECT *, unnest([floor(place), floor(place) + 1]) AS k FROM at_{a} WHERE place BETWEEN 0 AND n - 1) WHERE abs(place - k) < 1)" for a in AXES
    )
    joins = " ".join(f"JOIN w_{a} ON w_{a}.volume = v.volume AND w_{a}.side = v.side AND w_{a}.k = v.{a}" for a in AXES)
    return f"""WITH cts AS (SELECT 0 AS volume, l_linestatus AS side, {views.VOXEL}, count(*) AS hu FROM lineitem GROUP BY ALL), {grids_sql('cts')}, {places_sql()}, {weights}
SELECT v.volume, v.side, {', '.join(f'w_{a}.i AS {a}' for a in AXES)}, round(sum(hu * w_z.w * w_y.w * w_x.w), 6) AS value FROM cts v {joins} GROUP BY ALL"""


def pair_score(spark, d):
    voxels = views.repeated_voxels(spark, d)
    found = grids.pair_scores(voxels, grid_table(voxels), "F", "O").select("volume", "n_a", "n_b", "dsc", "rvd")
    return rounded(found, 6, "dsc", "rvd")


def metric_bundle(spark, d):
    return rounded(masks.metric_bundle(views.repeated_voxels(spark, d), "F", "O", SPACING), 6, "dsc", "assd", "hd", "hd95", "nsd")


def pair_extremes(spark, d):
    """The worst Dice and the largest volume difference of each patient's pairs of masks, by return flag."""
    flags = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("volume"), F.col("l_returnflag").alias("side"), *views.voxel_columns()).distinct()
    pairs = [masks.overlap(flags, a, b) for a, b in (("A", "N"), ("R", "N"), ("A", "R"))]
    scores = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).filter("n_a > 0 AND n_b > 0")
    return rounded(grids.extremes(scores, "volume"), 4, "min_dsc", "max_abs_rvd")


def extremes_sql() -> str:
    pair = lambda a, b: f"SELECT volume, sum(CAST({a} AS INTEGER)) AS n_a, sum(CAST({b} AS INTEGER)) AS n_b, sum(CAST({a} AND {b} AS INTEGER)) AS n_both FROM f GROUP BY volume"
    return f"""WITH f AS (SELECT l_suppkey AS volume, {views.VOXEL}, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'N') AS n, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL),
p AS ({pair('a', 'n')} UNION ALL {pair('r', 'n')} UNION ALL {pair('a', 'r')})
SELECT volume, round(min(2.0::DOUBLE * n_both / (n_a + n_b)), 4) AS min_dsc, round(max(abs(CAST(n_a AS DOUBLE) - n_b) / n_b), 4) AS max_abs_rvd FROM p WHERE n_a > 0 AND n_b > 0 GROUP BY volume"""


def inverse_warp(spark, d):
    """Where the voxels of both masks go under each pose."""
    voxels = views.dense_masks(spark, d)
    moved = geometry.moved_points(voxels, imaging.posed(voxels), ["volume"])
    return moved.select("side", "pose", *AXES, *[(F.round(f"s{r}", 6) + 0.0).alias(f"s{r}") for r in range(3)])


def phase_shapes(spark, d):
    """Phases of which the mask, in every other patient of the rows of one status only, has the shape of the series."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("patient"), F.col("l_returnflag").alias("phase"), "l_linestatus", *views.voxel_columns())
    shape = [F.count_distinct(a).alias(f"n{a}") for a in AXES]
    return series.phases_with_masks(rows.groupBy("patient", "phase").agg(*shape), rows.filter("l_linestatus = 'F' OR patient % 2 = 0").groupBy("patient", "phase").agg(*shape), ["patient", "phase"])


def shapes_sql() -> str:
    shape = lambda where: f"SELECT l_suppkey AS patient, l_returnflag AS phase, count(DISTINCT z) AS nz, count(DISTINCT y) AS ny, count(DISTINCT x) AS nx FROM (SELECT *, {views.VOXEL} FROM lineitem {where}) GROUP BY ALL"
    return f"{shape('')} INTERSECT {shape("WHERE l_linestatus = 'F' OR l_suppkey % 2 = 0")}"


def first_results(spark, d):
    """The first configuration of every block and phase; all of them must have one."""
    facts = views.experiments(spark, d).select("block", "phase", "config", "metric", "cost")
    return series.required_rows(facts.select("block", "phase").distinct(), facts, ["block", "phase"], ["config"])


def open_tasks(spark, d):
    done = views.experiments(spark, d).filter("loss LIKE '1-%'").select("block", F.col("phase").alias("moving"), "config")
    return series.not_done(statistics.grid_tasks(spark, d), done, ["block", "moving", "config"])


def gated_tasks(spark, d):
    usable = cohorts.usable_phases(imaging.quality(spark, d), imaging.USABLE)
    present = views.masks(spark, d).filter("side = 'F'").select(F.col("volume").alias("patient"))
    return series.registration_tasks(usable, present, "pv", ["arterial", "pre-contrast"])


def figure_names(spark, d):
    key = F.col("c_custkey")
    end = F.when(key % 5 == 0, "").when(key % 7 == 0, "_ct1_ct2").otherwise(F.concat(F.lit("_ct"), (key % 3).cast("string")))
    named = table(spark, d, "customer").select(key.alias("key"), F.concat(F.lit("Visualize_"), F.col("c_name"), end, F.lit(".jpg")).alias("file"))
    patient, label = series.figure_name(F.col("file"))
    return named.select("key", patient.alias("patient"), label.alias("label"))


def parameter_texts(spark, d):
    """Three numbers of each customer, written as text and read back."""
    values = F.array(F.col("c_acctbal").cast("double"), F.col("c_acctbal").cast("double") / 7, F.col("c_nationkey").cast("double"))
    read = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), series.text_vector(series.vector_text(values)).alias("v"))
    return read.select("key", F.size("v").alias("n"), *[F.col("v")[i].alias(f"v{i}") for i in range(3)])


def clipped_anchor(spark, d):
    boxes = masks.slice_boxes(views.masks(spark, d), "volume", "side")
    aimed = boxes.withColumns({"wanted": (F.col("volume") * 7 % 80 - 10).cast("int"), "slices": (F.col("volume") % 20 + 15).cast("int")})
    return series.clipped_anchor(aimed, ["volume", "side"], "wanted", "slices")


def slice_survival(spark, d):
    return rounded(series.survival(views.repeated_voxels(spark, d), resampled(spark, d), ["volume", "side"]), 6, "ratio")


def outcome_counts(spark, d):
    studies = views.studies(spark, d).filter(F.col("phase").isin(*cohorts.PHASES)).select(F.col("name").alias("patient"), "phase")
    return series.outcomes(table(spark, d, "customer").select(F.col("c_custkey").alias("patient")).join(studies, "patient", "left"), "pv")


def run_outcomes(spark, d):
    """Studies as items of a run of which some fail, some were done before, and some patients lose their pv phase."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    items = views.studies(spark, d).filter(F.col("phase").isin(*cohorts.PHASES)).join(orders, F.col("series") == F.col("o_orderkey")).select(F.col("name").alias("patient"), "phase", "series", "o_orderstatus", "o_totalprice")
    before = items.filter("series % 5 = 0")
    faults = {"unreadable": F.col("series") % 11 == 0, "no slices": F.col("o_orderstatus") == "P", "other shape": F.col("o_totalprice") < 60_000}
    good, failed = series.set_aside(items.filter("series % 5 <> 0"), faults, "pv")
    return series.outcome_report(before, good, failed, "pv")


def reoriented(spark, d):
    turns = spark.createDataFrame([(n, [float(x) for x in c]) for n, c in ORIENTATIONS.items()], "orientation string, cosines array<double>")
    voxels = views.dense_masks(spark, d).filter("side = 'F'").select(*AXES, F.lit(SHAPE["y"]).alias("ny"), F.lit(SHAPE["x"]).alias("nx"))
    return series.reoriented(voxels.crossJoin(F.broadcast(turns)), "cosines").drop("cosines")  # orientations are a few rows


def reoriented_sql() -> str:
    ny, nx = SHAPE["y"], SHAPE["x"]
    moves = {
        "standard": ("y", "x", ny, nx), "tilted": ("y", "x", ny, nx), "rows": ("y", f"{nx - 1} - x", ny, nx), "columns": (f"{ny - 1} - y", "x", ny, nx),
        "both": (f"{ny - 1} - y", f"{nx - 1} - x", ny, nx), "quarter": (f"{nx - 1} - x", "y", nx, ny), "three quarters": ("x", f"{ny - 1} - y", nx, ny),
    }
    return f"WITH {DENSE_MASKS} " + " UNION ALL ".join(f"SELECT '{n}' AS orientation, z, {y} AS y, {x} AS x, {h} AS ny, {w} AS nx FROM dense WHERE side = 'F'" for n, (y, x, h, w) in moves.items())


QUERIES = {
    "series_slices": lambda s, d: series.series_slices(slices(s, d), "volume").select("volume", "acquisition", "z", "place"),
    "slice_heights": lambda s, d: series.heights(views.masks(s, d), ["volume", "side"]),
    "slice_spacing": lambda s, d: frames(s, d).groupBy("volume", "side").agg(F.sum(series.slice_spacing(F.col("between"), F.col("dy"))).alias("total")),
    "phase_shapes": phase_shapes,
    "first_results": first_results,
    "open_tasks": open_tasks,
    "gated_tasks": gated_tasks,
    "figure_names": figure_names,
    "parameter_texts": parameter_texts,
    "axis_slice": lambda s, d: series.axis_slice(views.masks(s, d), "y", 5),
    "clipped_anchor": clipped_anchor,
    "slice_survival": slice_survival,
    "outcome_counts": outcome_counts,
    "run_outcomes": run_outcomes,
    "reoriented": reoriented,
    "grid_from_seg": lambda s, d: rounded(grids.grid_from_frames(frames(s, d), ["volume", "side"]), 6, "dz"),
    "grid_from_ct": lambda s, d: geometry.grid_from_slices(frames(s, d).groupBy("volume", "z").agg(F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.min("dy").alias("dy"), F.min("dx").alias("dx"), F.min("between").alias("thickness")), "volume"),
    "common_grid": lambda s, d: grids.common_grid(grid_table(views.masks(s, d)), ["volume"]),
    "resample_nearest": resampled,
    "resample_linear": resample_linear,
    "pair_score": pair_score,
    "metric_bundle": metric_bundle,
    "pair_extremes": pair_extremes,
    "inverse_warp": inverse_warp,
}

ORACLE_SQL = {
    "series_slices": f"""WITH {SLICES}, placed AS (SELECT * FROM (SELECT *, coalesce(try_cast(height AS DOUBLE), try_cast(location AS DOUBLE)) AS z FROM slices) WHERE z IS NOT NULL),
counted AS (SELECT volume, acquisition, coalesce(bool_or(acquisition = wanted), false) AS hit, count(*) AS n, min(seen) AS first FROM placed GROUP BY ALL),
chosen AS (SELECT volume, acquisition FROM (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY hit DESC, n DESC, first) AS best FROM counted) WHERE best = 1)
SELECT p.volume, p.acquisition, p.z, row_number() OVER (PARTITION BY p.volume ORDER BY p.z DESC) - 1 AS place FROM placed p JOIN chosen c ON p.volume = c.volume AND p.acquisition IS NOT DISTINCT FROM c.acquisition""",
    "slice_heights": f"WITH {MASKS} SELECT volume, side, z, dense_rank() OVER (PARTITION BY volume, side ORDER BY z DESC) - 1 AS place FROM (SELECT DISTINCT volume, side, z FROM vox)",
    "slice_spacing": "SELECT l_suppkey AS volume, l_linestatus AS side, sum(CASE WHEN l_linenumber % 2 = 0 THEN 2.5::DOUBLE ELSE 0.5::DOUBLE END) AS total FROM lineitem GROUP BY ALL",
    "phase_shapes": shapes_sql(),
    "first_results": f"WITH {EXPERIMENTS} SELECT block, phase, config, metric, cost FROM (SELECT *, row_number() OVER (PARTITION BY block, phase ORDER BY config) AS place FROM exp) WHERE place = 1",
    "open_tasks": f"WITH {EXPERIMENTS}, g AS ({statistics.ORACLE_SQL['grid_tasks']}) SELECT g.* FROM g ANTI JOIN (SELECT block, phase AS moving, config FROM exp WHERE loss LIKE '1-%') e USING (block, moving, config)",
    "gated_tasks": f"""WITH g AS ({imaging.ORACLE_SQL['quality_gate']}), s AS (SELECT patient, string_split(phases, '|') AS p FROM g)
SELECT patient, 'pv' AS fixed, moving FROM s, (VALUES ('arterial'), ('pre-contrast')) m(moving) WHERE list_contains(p, 'pv') AND list_contains(p, moving) AND patient IN (SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'F')""",
    "figure_names": """WITH n AS (SELECT c_custkey AS key, string_split(c_name || CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN '_ct1_ct2' ELSE '_ct' || (c_custkey % 3) END, '_ct') AS p FROM customer)
SELECT key, CASE WHEN len(p) = 1 THEN p[1] ELSE array_to_string(p[:-2], '_ct') END AS patient, CASE WHEN len(p) = 1 THEN '' ELSE 'CT' || p[-1] END AS label FROM n""",
    "parameter_texts": "SELECT c_custkey AS key, 3 AS n, round(CAST(c_acctbal AS DOUBLE), 4) AS v0, round(CAST(c_acctbal AS DOUBLE) / 7, 4) AS v1, CAST(c_nationkey AS DOUBLE) AS v2 FROM customer",
    "axis_slice": f"WITH {MASKS} SELECT volume, side, z, x FROM vox WHERE y = 5",
    "clipped_anchor": f"""WITH {MASKS}, b AS (SELECT DISTINCT volume, side, z, greatest(0, least(volume * 7 % 80 - 10, volume % 20 + 14)) AS aim FROM vox WHERE z < volume % 20 + 15)
SELECT volume, side, z, gap FROM (SELECT volume, side, z, abs(z - aim) AS gap, row_number() OVER (PARTITION BY volume, side ORDER BY abs(z - aim), z) AS place FROM b) WHERE place = 1""",
    "slice_survival": f"""WITH {MASKS}, {nearest_sql('vox')}, b AS (SELECT volume, side, count(DISTINCT z) AS n_before FROM vox GROUP BY ALL), a AS (SELECT volume, side, count(DISTINCT z) AS n_after FROM near GROUP BY ALL)
SELECT volume, side, n_before, coalesce(n_after, 0) AS n_after, round(coalesce(n_after, 0) / n_before, 6) AS ratio FROM b LEFT JOIN a USING (volume, side)""",
    "outcome_counts": f"""WITH {STUDIES}, p AS (SELECT c_custkey, bool_or(coalesce(phase = 'pv', false)) AS pv, count(DISTINCT phase) AS n FROM customer LEFT JOIN (SELECT * FROM studies WHERE phase IN ('pre-contrast', 'arterial', 'pv')) s ON c_custkey = name GROUP BY ALL)
SELECT CASE WHEN NOT pv THEN 'no pv' WHEN n < 2 THEN 'fewer than 2 phases' ELSE 'usable' END AS reason, count(*) AS n FROM p GROUP BY ALL""",
    "run_outcomes": f"""WITH {STUDIES}, i AS (SELECT name AS patient, phase, series, CASE WHEN series % 11 = 0 THEN 'unreadable' WHEN o_orderstatus = 'P' THEN 'no slices' WHEN o_totalprice < 60000 THEN 'other shape' END AS error
  FROM studies JOIN orders ON series = o_orderkey WHERE phase IN ('pre-contrast', 'arterial', 'pv')),
m AS (SELECT *, coalesce(error, CASE WHEN patient IN (SELECT patient FROM i WHERE series % 5 <> 0 AND phase = 'pv' AND error IS NOT NULL) THEN 'pv failed' END) AS reason FROM i WHERE series % 5 <> 0),
p AS (SELECT patient, bool_or(coalesce(phase = 'pv', false)) AS pv, count(DISTINCT phase) AS n FROM (SELECT patient, phase FROM i WHERE series % 5 = 0 UNION ALL SELECT patient, CASE WHEN reason IS NULL THEN phase END FROM m) GROUP BY patient)
SELECT 'patients' AS kind, CASE WHEN NOT pv THEN 'no pv' WHEN n < 2 THEN 'fewer than 2 phases' ELSE 'usable' END AS reason, count(*) AS n FROM p GROUP BY ALL
UNION ALL SELECT 'items', reason, count(*) FROM m WHERE reason IS NOT NULL GROUP BY reason""",
    "reoriented": reoriented_sql(),
    "grid_from_seg": f"""WITH {FRAMES}, h AS (SELECT volume, side, count(DISTINCT z) AS nz, max(z) AS oz, min(z) AS low FROM frames GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY volume, side ORDER BY z DESC, frame DESC) AS place FROM frames) WHERE place = 1)
SELECT h.volume, h.side, h.oz, t.item * 0.5::DOUBLE AS oy, t.item * -0.25::DOUBLE AS ox, CASE WHEN nz > 1 THEN round((oz - low) / (nz - 1), 6) WHEN t.item % 2 = 0 THEN 2.5 ELSE 1.0 END AS dz,
  0.5::DOUBLE AS dy, 0.75::DOUBLE AS dx, nz, 0.0::DOUBLE AS cx, 0.0::DOUBLE AS cy, CASE WHEN t.item % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS cz FROM h JOIN t ON h.volume = t.volume AND h.side = t.side""",
    "grid_from_ct": f"""WITH {FRAMES}, s AS (SELECT volume, z, min(item * 0.5::DOUBLE) AS oy, min(item * -0.25::DOUBLE) AS ox, min(CASE WHEN item % 2 = 0 THEN 2.5::DOUBLE END) AS thickness FROM frames GROUP BY ALL),
p AS (SELECT *, row_number() OVER w AS place, lead(z) OVER w AS next, count(*) OVER (PARTITION BY volume) AS n FROM s WINDOW w AS (PARTITION BY volume ORDER BY z DESC))
SELECT volume, z AS oz, oy, ox, coalesce(z - next, thickness, 1.0::DOUBLE) AS sz, 0.5::DOUBLE AS sy, 0.75::DOUBLE AS sx, n FROM p WHERE place = 1""",
    "common_grid": f"WITH {MASKS}, {grids_sql('vox')} SELECT volume, {', '.join(f't{p}{a} AS {p}{a}' for p in 'osn' for a in AXES)} FROM common",
    "resample_nearest": f"WITH {MASKS}, {nearest_sql('vox')} SELECT * FROM near",
    "resample_linear": linear_sql(),
    "pair_score": f"""WITH {MASKS}, {nearest_sql('vox')}, f AS (SELECT volume, z, y, x, max(CAST(side = 'F' AS INTEGER)) AS a, max(CAST(side = 'O' AS INTEGER)) AS b FROM near GROUP BY ALL),
n AS (SELECT volume, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b, sum(a * b) AS n_both FROM f GROUP BY volume)
SELECT volume, n_a, n_b, round(2.0::DOUBLE * n_both / (n_a + n_b), 6) AS dsc, round((CAST(n_a AS DOUBLE) - n_b) / nullif(n_b, 0), 6) AS rvd FROM n""",
    "metric_bundle": f"SELECT volume, dsc, assd, hd, hd95, nsd FROM (SELECT volume, dsc FROM ({imaging.ORACLE_SQL['mask_overlap']}) WHERE volume >= 0) LEFT JOIN ({imaging.ORACLE_SQL['surface_metrics']}) USING (volume)",
    "pair_extremes": extremes_sql(),
    "inverse_warp": f"""WITH {imaging.matrix_sql()}, {DENSE_MASKS} SELECT side, pose, z, y, x, {', '.join(f'round(i0{r} * (z - o0) + i1{r} * (y - o1) + i2{r} * (x - o2), 6) + 0.0 AS s{r}' for r in range(3))} FROM dense, mat""",
}
