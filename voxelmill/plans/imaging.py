"""Queries on masks, catalogues, histories and geometry, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill.operators import cohorts, fields, geometry, histories, intensity, losses, masks, registration
from voxelmill.sources import views
from voxelmill.sources.tables import table
from voxelmill.sources.views import DENSE_MASKS, FOLDERS, HISTORIES, LABELLED, MASKS, RAW_CATALOGUE, SERIES, SOLID_MASKS, STUDIES

SPACING = (1.0, 0.5, 0.5)
SHAPE = {"z": 51, "y": 11, "x": 9}
GRID = tuple(SHAPE.values())
LIMIT = 3600.0
#: Poses (name, tz, ty, tx, rz, ry, rx).
POSES = [("identity", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("half", 0.5, 0.0, 0.0, 0.0, 0.0, 0.0), ("shift", 2.0, -1.0, 1.0, 0.0, 0.0, 0.0), ("turn", 0.25, 0.0, 0.0, 0.1, -0.05, 0.2)]
EDGE_OF = """(SELECT m.* FROM {m} m ANTI JOIN (SELECT volume, side, z + i AS z, y + j AS y, x + k AS x FROM {m},
    (SELECT i, j, k FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k) WHERE i <> 0 OR j <> 0 OR k <> 0)
    GROUP BY ALL HAVING count(*) = 26) b USING (volume, side, z, y, x))"""


def rounded(df, digits: int, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def mask_overlap(spark, d):
    both = views.masks(spark, d).unionByName(views.dense_masks(spark, d).withColumn("volume", F.lit(-1).cast("long")))
    return rounded(masks.overlap(both, "F", "O"), 6, "dsc", "dsc_loss", "rvd")


def label_merge(spark, d):
    voxels = views.labelled_voxels(spark, d)
    merged = masks.merge_labels(voxels).groupBy("volume", "label").agg(F.count(F.lit(1)).alias("n"))
    census = masks.label_census(voxels).select("volume", "several")
    return merged.join(census, "volume")


def surface(view):
    def query(spark, d):
        found = masks.surface_metrics(masks.surface_distances(view(spark, d), "F", "O", SPACING))
        return rounded(found, 6, "assd", "hd", "hd95", "nsd")

    return query


def surface_sql(relation: str, name: str) -> str:
    gap = " + ".join(f"pow((p.{c} - q.{c}) * {s}, 2)" for c, s in zip("zyx", SPACING, strict=True))
    return f"""WITH {relation}, edge AS {EDGE_OF.format(m=name)},
dist AS (SELECT p.volume, p.side AS direction, p.z, p.y, p.x, sqrt(min({gap})) AS d FROM edge p JOIN edge q ON p.volume = q.volume AND p.side <> q.side GROUP BY ALL),
way AS (SELECT volume, direction, sum(d) AS total, count(d) AS n, max(d) AS largest, quantile_cont(d, 0.95) AS p95, count(*) FILTER (d <= 2.0) AS near FROM dist GROUP BY ALL)
SELECT volume, round(sum(total) / sum(n), 6) AS assd, round(max(largest), 6) AS hd, round(max(p95), 6) AS hd95, round(sum(near) / sum(n), 6) AS nsd FROM way GROUP BY volume"""


def clicks(spark, d, kind: str):
    return table(spark, d, "events").filter(F.col("event_type") == kind).select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("moment"))


def quality(spark, d):
    """(patient, dsc_pv_pre, dsc_art_pre, dsc_pv_art): each supplier's masks by return flag compared in pairs; missing where a mask is."""
    voxels = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("patient"), F.col("l_returnflag").alias("side"), *views.voxel_columns()[1:], (F.col("l_quantity") / 10).cast("int").alias("z"))
    columns = masks.packed_sides(voxels, ["patient"], ["A", "N", "R"])
    on = dict(zip("ANR", map(F.col, ("_s0", "_s1", "_s2")), strict=True))
    size = lambda bits: F.sum(F.bit_count(bits).cast("long"))
    dice = lambda a, b: F.round(F.try_divide(2.0 * size(on[a].bitwiseAND(on[b])), size(on[a]) + size(on[b])), 4)
    return columns.groupBy("patient").agg(dice("A", "N").alias("dsc_pv_pre"), dice("R", "N").alias("dsc_art_pre"), dice("A", "R").alias("dsc_pv_art"))


QUALITY = """flags AS (SELECT DISTINCT l_suppkey AS patient, l_returnflag AS side, CAST(trunc(l_quantity / 10) AS INTEGER) AS z, CAST(round(l_discount * 100) AS INTEGER) AS y, CAST(round(l_tax * 100) AS INTEGER) AS x FROM lineitem),
voxels AS (SELECT patient, z, y, x, max(CAST(side = 'A' AS INTEGER)) AS a, max(CAST(side = 'N' AS INTEGER)) AS n, max(CAST(side = 'R' AS INTEGER)) AS r FROM flags GROUP BY ALL),
quality AS (SELECT patient, round(2.0 * sum(a * n) / nullif(sum(a) + sum(n), 0), 4) AS dsc_pv_pre, round(2.0 * sum(r * n) / nullif(sum(r) + sum(n), 0), 4) AS dsc_art_pre,
  round(2.0 * sum(a * r) / nullif(sum(a) + sum(r), 0), 4) AS dsc_pv_art FROM voxels GROUP BY patient)"""
#: The supplied masks overlap less than real ones.
USABLE = 0.4


def pair_quality(spark, d):
    """The worst pair of each patient, most suspicious first; patients without any pair count as 1."""
    found = quality(spark, d).withColumn("worst", F.least("dsc_pv_pre", "dsc_art_pre", "dsc_pv_art"))
    return found.orderBy(F.coalesce("worst", F.lit(1.0)), "patient")


def hu_window(spark, d):
    """Windowed prices by supplier with their outer percentiles."""
    hu = intensity.to_hu(F.col("l_extendedprice"), F.lit(0.01), F.when(F.col("l_returnflag") == "R", -200.0))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("volume"), F.round(hu, 4).alias("hu"))
    shown = rows.withColumn("shown", intensity.windowed(F.col("hu"), *intensity.WINDOWS["abdomen"]))
    ends = rounded(intensity.percentiles(rows, "volume", "hu"), 4, "p01", "p99")
    return shown.groupBy("volume").agg(F.sum("shown").alias("total"), F.min("shown").alias("low"), F.max("shown").alias("high")).join(ends, "volume")


PRESETS = (*intensity.WINDOWS, "none")


def window_presets(spark, d):
    """Prices by supplier under every window, and under the one that follows from mean and spread."""
    hu = intensity.to_hu(F.col("l_extendedprice"), F.lit(0.01), F.when(F.col("l_returnflag") == "R", -200.0))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("volume"), F.round(hu, 4).alias("hu"))
    out = None
    for preset in PRESETS:
        levels = intensity.window_levels(rows, "volume", "hu", preset)
        total = F.sum("pixel") if preset in intensity.WINDOWS else F.lit(None)  # where bounds aren't exact, pixels at a step aren't either
        one = levels.groupBy("volume").agg(F.max("lower").alias("lower"), F.max("upper").alias("upper"), F.avg("level").alias("mean_level"), total.cast("long").alias("pixels"))
        one = rounded(one, 3, "lower", "upper", "mean_level").withColumn("preset", F.lit(preset))
        out = one if out is None else out.unionByName(one)
    return out


def series_lists(spark, d):
    lists = cohorts.series_lists(cohorts.cleaned_catalogue(views.raw_catalogue(spark, d)))
    return lists.select("name", F.size("series").alias("n_series"), F.array_join(F.transform("series", lambda s: s["row"].cast("string")), "|").alias("rows"), F.array_join(F.transform("series", lambda s: s["phase"]), "|").alias("phases"))


ANGLES = {"rz": 0.02, "ry": -0.03, "rx": 0.05}


def posed(volumes, shape=GRID, poses=POSES):
    """(volume, pose and its matrix): every volume under each of some poses."""
    names = ("pose", *geometry.SHIFTS, *geometry.ANGLES)
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in poses]))
    return geometry.with_matrix(volumes.select("volume").distinct().select("volume", each.alias("p")).select("volume", "p.*"), shape)


def start_poses(spark, d):
    """(volume and the matrix of its start pose): the centroids' shift with some rotation by volume."""
    shift = rounded(masks.centroid_shift(views.solid_masks(spark, d), "F", "O"), 6, *geometry.SHIFTS)
    turned = {a: step * (F.col("volume") % (3 + k) - 1) for k, (a, step) in enumerate(ANGLES.items())}
    return geometry.with_matrix(shift.withColumns(turned), GRID)


def rigid_matrix(spark, d):
    """The start pose of every volume as a matrix and an offset."""
    names = [f"i{r}{c}" for r in range(3) for c in range(3)] + [f"o{r}" for r in range(3)]
    return start_poses(spark, d).select("volume", *[(F.round(n, 6) + 0.0).alias(n) for n in names])


def warp(linear: bool):
    def query(spark, d):
        both, keys = views.dense_masks(spark, d), ["side", "pose"]
        return geometry.warp_linear(both, posed(both), ["volume"], keys, GRID, 6) if linear else geometry.warp_nearest(both, posed(both), ["volume"], keys, GRID)

    return query


def warp_binary(inverse: bool):
    def query(spark, d):
        """Every volume's moving mask laid onto the fixed one, or its fixed mask taken back."""
        matrices = start_poses(spark, d)
        side = views.solid_masks(spark, d).filter(F.col("side") == ("F" if inverse else "O"))
        return geometry.warp_binary(side, geometry.inverted(matrices) if inverse else matrices, ["volume"], ["volume"], GRID)

    return query


AIR = -1000.0


def tomograms(spark, d):
    """(volume, side, z, y, x, value): mean prices by voxel as two dense volumes; places without any are air."""
    rows = table(spark, d, "lineitem").select(F.lit(0).cast("long").alias("volume"), F.col("l_linestatus").alias("side"), *views.voxel_columns(), "l_extendedprice")
    return rows.groupBy("volume", "side", "z", "y", "x").agg(F.expr("CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) div (count(*) * 10000) - 200 AS DOUBLE)").alias("value"))


TOMOGRAMS = f"ct AS (SELECT CAST(0 AS BIGINT) AS volume, l_linestatus AS side, {views.VOXEL}, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // (count(*) * 10000) - 200 AS DOUBLE) AS value FROM lineitem GROUP BY ALL)"


def warp_cubic(spark, d):
    """Both dense masks as continuous fields under every pose."""
    both = views.dense_masks(spark, d).withColumn("value", F.lit(1.0))
    return fields.warp_cubic(both, posed(both), ["volume"], ["volume", "side"], GRID).drop("volume")


def warp_tomogram(spark, d):
    """Both volumes of prices under every pose, with air outside."""
    both = tomograms(spark, d)
    return fields.warp_cubic(both, posed(both), ["volume"], ["volume", "side"], GRID, AIR, 4).drop("volume")


def cubic_sql(field: str, background: float, digits: int) -> str:
    """Both masks' or volumes' values at every place of the grid under every pose."""
    return f"""WITH {field}, {matrix_sql()}, {points_sql()}, {cubic_parts()}
SELECT side, pose, g.z, g.y, g.x, round(coalesce(s.value, 0.0) + {background}::DOUBLE, {digits}) + 0.0 AS value
FROM (SELECT * FROM (SELECT DISTINCT side FROM field), (SELECT pose FROM poses), grid) g LEFT JOIN sums s USING (side, pose, z, y, x)"""


def cubic_parts() -> str:
    """Spline coefficients by their closed form (mirrored powers of the pole), axis by axis, and 64 of them at every point."""
    pole, passes, source = fields.POLE, [], "field"
    for axis, n in zip("zyx", GRID, strict=True):
        period = 2 * (n - 1)
        other = ", ".join(c for c in "zyx" if c != axis)
        power = lambda e: f"pow({pole}::DOUBLE, ({e})::DOUBLE)"  # noqa: E731, B023
        weight = f"({power('abs(k - j)')} + {power(f'{period} - abs(k - j)')} + {power('k + j')} + {power(f'{period} - (k + j)')}) / (1 - {power(str(period))}) * (CASE WHEN j = 0 OR j = {n - 1} THEN 0.5 ELSE 1 END) * {-6 * pole / (1 - pole * pole)}::DOUBLE"
        passes.append(f"w{axis} AS (SELECT CAST(k AS INTEGER) AS k, CAST(j AS INTEGER) AS j, {weight} AS w FROM (SELECT unnest(range({n})) AS k), (SELECT unnest(range({n})) AS j))")
        passes.append(f"c{axis} AS (SELECT side, {other}, k AS {axis}, sum(value * w) AS value FROM {source} JOIN w{axis} ON {axis} = j GROUP BY ALL)")
        source = f"c{axis}"
    basis = lambda s, i: {0: f"pow(1 - f{s}, 3) / 6", 1: f"(4 - 6 * pow(f{s}, 2) + 3 * pow(f{s}, 3)) / 6", 2: f"(1 + 3 * f{s} + 3 * pow(f{s}, 2) - 3 * pow(f{s}, 3)) / 6", 3: f"pow(f{s}, 3) / 6"}[i]
    weights = " * ".join(f"(CASE i{s} " + " ".join(f"WHEN {i} THEN {basis(s, i)}" for i in range(4)) + " END)" for s in range(3))
    at = lambda s, n: f"CAST({n - 1} - abs({n - 1} - abs(floor(s{s}) + i{s} - 1)) AS INTEGER)"
    return f"""{", ".join(passes)},
offs AS (SELECT * FROM {", ".join(f"(SELECT unnest([0, 1, 2, 3]) AS i{s})" for s in range(3))}),
parts AS (SELECT *, {", ".join(f"s{s} - floor(s{s}) AS f{s}" for s in range(3))} FROM points),
asked AS (SELECT pose, z, y, x, {", ".join(f"{at(s, n)} AS n{s}" for s, n in enumerate(GRID))}, {weights} AS w FROM parts, offs),
sums AS (SELECT side, pose, a.z, a.y, a.x, sum(a.w * c.value) AS value FROM asked a JOIN cx c ON a.n0 = c.z AND a.n1 = c.y AND a.n2 = c.x GROUP BY ALL)"""


CELLS = ["cos(rz)*cos(ry)", "cos(rz)*sin(ry)*sin(rx)-sin(rz)*cos(rx)", "cos(rz)*sin(ry)*cos(rx)+sin(rz)*sin(rx)", "sin(rz)*cos(ry)", "sin(rz)*sin(ry)*sin(rx)+cos(rz)*cos(rx)", "sin(rz)*sin(ry)*cos(rx)-cos(rz)*sin(rx)", "-sin(ry)", "cos(ry)*sin(rx)", "cos(ry)*cos(rx)"]


def matrices_of(poses: str) -> str:
    inverse = ", ".join(f"{CELLS[c * 3 + r]} AS i{r}{c}" for r in range(3) for c in range(3))
    centre = [n / 2 for n in GRID]
    offsets = ", ".join(f"{centre[r]} - (" + " + ".join(f"i{r}{c} * ({centre[c]} + {t})" for c, t in enumerate(("tz", "ty", "tx"))) + f") AS o{r}" for r in range(3))
    return f"inv AS (SELECT *, {inverse} FROM {poses}), mat AS (SELECT *, {offsets} FROM inv)"


def matrix_sql(poses=POSES) -> str:
    rows = ", ".join(f"('{n}', {', '.join(map(str, v))})" for n, *v in poses)
    return f"""poses AS (SELECT pose, tz::DOUBLE AS tz, ty::DOUBLE AS ty, tx::DOUBLE AS tx, rz::DOUBLE AS rz, ry::DOUBLE AS ry, rx::DOUBLE AS rx FROM (VALUES {rows}) v(pose, tz, ty, tx, rz, ry, rx)),
{matrices_of("poses")}"""


def start_sql() -> str:
    """Centroids' shifts of the solid masks with some rotation, and their matrices."""
    shifts = ", ".join(f"round(avg({a}) FILTER (side = 'F') - avg({a}) FILTER (side = 'O'), 6) AS t{a}" for a in "zyx")
    turns = ", ".join(f"{step}::DOUBLE * (volume % {3 + k} - 1) AS {a}" for k, (a, step) in enumerate(ANGLES.items()))
    return f"""{SOLID_MASKS}, starts AS (SELECT volume, {shifts}, {turns} FROM solid GROUP BY volume HAVING count(DISTINCT side) = 2), {matrices_of("starts")}"""


def inverted_sql() -> str:
    cells = ", ".join(f"i{c}{r} AS i{r}{c}" for r in range(3) for c in range(3))
    offsets = ", ".join("-(" + " + ".join(f"i{c}{r} * o{c}" for c in range(3)) + f") AS o{r}" for r in range(3))
    return f"back AS (SELECT volume, {cells}, {offsets} FROM mat)"


def points_sql(matrices: str = "mat") -> str:
    """Every voxel of the grid under every matrix with its source point, where that is within the grid."""
    z, y, x = GRID
    at = ", ".join(f"round(i{r}0 * z + i{r}1 * y + i{r}2 * x + o{r}, 6) AS s{r}" for r in range(3))
    inside = " AND ".join(f"s{r} BETWEEN 0 AND {n - 1}" for r, n in enumerate(GRID))
    return f"""grid AS (SELECT z, y, x FROM (SELECT CAST(unnest(range({z})) AS INTEGER) AS z), (SELECT CAST(unnest(range({y})) AS INTEGER) AS y), (SELECT CAST(unnest(range({x})) AS INTEGER) AS x)),
points AS (SELECT * FROM (SELECT {matrices}.*, grid.*, {at} FROM grid, {matrices}) WHERE {inside})"""


CORNERS = """(SELECT *, CAST(floor(s0) + i AS INTEGER) AS n0, CAST(floor(s1) + j AS INTEGER) AS n1, CAST(floor(s2) + k AS INTEGER) AS n2,
  (CASE i WHEN 1 THEN s0 - floor(s0) ELSE 1 - (s0 - floor(s0)) END) * (CASE j WHEN 1 THEN s1 - floor(s1) ELSE 1 - (s1 - floor(s1)) END) * (CASE k WHEN 1 THEN s2 - floor(s2) ELSE 1 - (s2 - floor(s2)) END) AS w
  FROM points, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j), (SELECT unnest([0, 1]) AS k))"""


def binary_sql(side: str, matrices: str) -> str:
    return f"""{points_sql(matrices)}, c AS (SELECT * FROM {CORNERS} WHERE w > 0)
SELECT c.volume, c.z, c.y, c.x FROM c JOIN solid m ON c.volume = m.volume AND m.side = '{side}' AND n0 = m.z AND n1 = m.y AND n2 = m.x GROUP BY ALL HAVING round(sum(w), 9) > 0.5"""


def soft_dice_sql() -> str:
    return f"""WITH {MASKS}, vox1 AS (SELECT *, 1.0::DOUBLE AS value FROM vox), {smoothing_parts("vox1")}
SELECT volume, round(1 - 2 * sum(p * q) / (sum(p) + sum(q)), 6) AS soft_dice_loss FROM pq GROUP BY volume"""


def smoothing_parts(source: str) -> str:
    """Kernels by axis as sums over the mirrored images of each source, and three joins with them."""
    radius, passes = int(fields.TRUNCATE * fields.SIGMA + 0.5), []
    for axis, n in zip("zyx", GRID, strict=True):
        other = ", ".join(c for c in "zyx" if c != axis)
        passes.append(f"""bell{axis} AS (SELECT CAST(t AS INTEGER) AS t, least((t + k + {20 * n}) % {2 * n}, {2 * n - 1} - (t + k + {20 * n}) % {2 * n}) AS s, exp(-0.5 * k * k / {fields.SIGMA ** 2}) AS w FROM (SELECT unnest(range({n})) AS t), (SELECT unnest(range({-radius}, {radius + 1})) AS k)),
k{axis} AS (SELECT t, s, sum(w) / (SELECT sum(w) FROM bell{axis} WHERE t = 0) AS w FROM bell{axis} GROUP BY t, s)""")
        passes.append(f"g{axis} AS (SELECT volume, side, {other}, t AS {axis}, sum(value * w) AS value FROM {source} JOIN k{axis} ON {axis} = s GROUP BY ALL)")
        source = f"g{axis}"
    return f"""{", ".join(passes)},
pq AS (SELECT volume, z, y, x, coalesce(sum(value) FILTER (side = 'F'), 0) AS p, coalesce(sum(value) FILTER (side = 'O'), 0) AS q FROM gx GROUP BY ALL)"""


#: Poses whose losses are compared; the last one takes the mask away.
TRIED = [*POSES, ("away", 99.0, 0.0, 0.0, 0.0, 0.0, 0.0)]


def pose_losses(spark, d):
    """Every loss of laying one dense mask onto the other, under every pose."""
    both = views.dense_masks(spark, d)
    found = losses.pose_losses(both, posed(both, poses=TRIED), GRID, SPACING, "F", "O")
    return rounded(found.drop("volume"), 5, *losses.LOSSES)


def losses_sql() -> str:
    surfaces = surface_sql("x AS (SELECT 1)", "posed").split("x AS (SELECT 1), ", 1)[1]
    return f"""WITH {DENSE_MASKS}, {matrix_sql(TRIED)}, {points_sql()}, field AS (SELECT side, z, y, x, 1.0::DOUBLE AS value FROM dense WHERE side = 'O'), {cubic_parts()},
warped AS (SELECT pose, c.z, c.y, c.x FROM {CORNERS} c JOIN dense m ON m.side = 'O' AND n0 = m.z AND n1 = m.y AND n2 = m.x WHERE w > 0 GROUP BY ALL HAVING round(sum(w), 9) > 0.5),
posed AS (SELECT pose AS volume, side, z, y, x FROM dense, poses WHERE side = 'F' UNION ALL SELECT pose, 'O', z, y, x FROM warped),
soft AS (SELECT pose AS volume, side, z, y, x, 1.0::DOUBLE AS value FROM dense, poses WHERE side = 'F' UNION ALL SELECT pose, 'O', z, y, x, round(value, 6) FROM sums), {smoothing_parts("soft")},
sd AS (SELECT volume, 1 - 2 * sum(p * q) / (sum(p) + sum(q)) AS soft_dice FROM pq GROUP BY volume),
f AS (SELECT volume, z, y, x, max(CAST(side = 'F' AS INTEGER)) AS a, max(CAST(side = 'O' AS INTEGER)) AS b FROM posed GROUP BY ALL),
ov AS (SELECT volume, 1 - 2.0::DOUBLE * sum(a * b) / (sum(a) + sum(b)) AS dsc FROM f GROUP BY volume), surf AS (WITH {surfaces})
SELECT p.pose, round(dsc, 5) AS dsc, round(soft_dice, 5) AS soft_dice, round(coalesce(assd, {losses.PENALTY}), 5) AS assd, round(coalesce(hd95, {losses.PENALTY}), 5) AS hd95
FROM poses p LEFT JOIN ov ON ov.volume = p.pose LEFT JOIN sd ON sd.volume = p.pose LEFT JOIN surf ON surf.volume = p.pose"""


def largest_component(spark, d):
    return geometry.largest_component(views.dense_masks(spark, d).withColumn("volume", F.col("side")), "volume")


def registration_grid(spark, d):
    """The two dense masks registered under every configuration."""
    return registration.register(views.dense_masks(spark, d), registration.grid(spark), "F", "O", GRID, SPACING)


#: Patients among whom series and folders are dealt.
PATIENTS = 40


def prioritized_match(spark, d):
    """The folders of each patient matched with the patient's own catalogue rows, some of which have blanks around their uid."""
    listed = views.series(spark, d).withColumns({"patient": F.col("row") % PATIENTS, "uid": F.when(F.col("row") % 4 == 0, F.concat(F.lit(" "), "uid", F.lit(" "))).otherwise(F.col("uid"))})
    return cohorts.match_series(views.folders(spark, d).withColumn("patient", F.col("folder") % PATIENTS), listed)


def session_pick(spark, d):
    orders = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 97 == 0, "undated").otherwise(F.concat(F.date_format("o_orderdate", "MM-dd-yyyy"), F.lit("-"), F.col("o_orderkey").cast("string")))
    return cohorts.pick_sessions(orders.select(F.col("o_custkey").alias("patient"), text.alias("session")))


def convergence_best(spark, d):
    best = histories.running_best(views.histories(spark, d))
    last = best.groupBy("run").agg(F.max_by("best_dsc", "idx").alias("final_best_dsc"), F.round(F.sum("best_loss"), 4).alias("area"))
    return histories.summary(views.histories(spark, d)).join(last, "run")


def prompt_anchors(spark, d):
    keys = ["volume", "side"]
    return masks.prompt_slices(masks.slice_boxes(views.dense_masks(spark, d), *keys), keys, 7)


def nearest_slice(spark, d):
    """The slice of each mask nearest to the middle of its volume's common extent."""
    voxels = views.masks(spark, d)
    target = voxels.groupBy("volume").agg(((F.min("z") + F.max("z")) / 2).alias("target"))
    slices = voxels.filter("side = 'F'").select("volume", "z").distinct().join(target, "volume")
    return masks.nearest_slice(slices, "volume", "z", F.col("target"))


QUERIES = {
    "earliest_study": lambda s, d: cohorts.earliest_studies(views.studies(s, d)).withColumn("study_date", F.date_format("study_date", "yyyy-MM-dd")),
    "cohort_having": lambda s, d: cohorts.cohort(cohorts.unambiguous(views.studies(s, d)), discarded=(1, 2, 3)),
    "normalized_desc": lambda s, d: cohorts.cleaned_series(views.series(s, d)).withColumn("words", cohorts.normalised(F.col("description"))),
    "prioritized_match": prioritized_match,
    "session_pick": session_pick,
    "modal_value": lambda s, d: masks.modal_value(table(s, d, "lineitem").select(F.col("l_suppkey").alias("volume"), "l_linenumber", F.struct("l_shipdate", "l_orderkey").alias("seen")), ["volume"], "l_linenumber", "seen"),
    "label_merge": label_merge,
    "mask_overlap": mask_overlap,
    "mask_centroid_shift": lambda s, d: rounded(masks.centroid_shift(views.masks(s, d), "F", "O"), 6, "tz", "ty", "tx"),
    "slice_bbox": lambda s, d: masks.slice_boxes(views.masks(s, d), "volume", "side"),
    "prompt_anchors": prompt_anchors,
    "union_roi": lambda s, d: masks.union_box(views.masks(s, d), SHAPE),
    "boundary_voxels": lambda s, d: masks.boundary(views.dense_masks(s, d), ["volume", "side"]),
    "surface_metrics": surface(views.repeated_voxels),
    "surface_metrics_dense": surface(views.dense_masks),
    "asof_tolerance": lambda s, d: masks.nearest_within(clicks(s, d, "click"), clicks(s, d, "purchase"), "key", "moment", LIMIT),
    "nearest_slice": nearest_slice,
    "pair_quality": pair_quality,
    "quality_gate": lambda s, d: cohorts.usable_phases(quality(s, d), USABLE),
    "convergence_best": convergence_best,
    "hu_window": hu_window,
    "window_presets": window_presets,
    "cleaned_catalogue": lambda s, d: cohorts.cleaned_catalogue(views.raw_catalogue(s, d)).withColumn("study_date", F.col("study_date").cast("string")),
    "series_lists": series_lists,
    "z_gaps": lambda s, d: rounded(masks.gaps(views.masks(s, d), ["volume", "side"]), 6, "mean_gap"),
    "median_index": lambda s, d: masks.middle(views.masks(s, d), "volume", "z", SHAPE["z"] // 2),
    "rigid_matrix": rigid_matrix,
    "warp_nearest": warp(False),
    "warp_linear": warp(True),
    "warp_binary": warp_binary(False),
    "warp_back": warp_binary(True),
    "warp_cubic": warp_cubic,
    "warp_tomogram": warp_tomogram,
    "pose_losses": pose_losses,
    "soft_dice": lambda s, d: rounded(fields.soft_dice(views.masks(s, d), "F", "O", GRID), 6, "soft_dice_loss"),
    "largest_component": largest_component,
    "registration_grid": registration_grid,
}

NORMALISED = "coalesce(array_to_string(list_sort(string_split(trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')), ' ')), ' '), '')"
CLEANED = SERIES + f""",
cleaned AS (SELECT row, CASE WHEN regexp_matches(description, '^[0-9.]+$') AND contains(description, '.') THEN description ELSE uid END AS uid,
  CASE WHEN NOT (regexp_matches(description, '^[0-9.]+$') AND contains(description, '.')) THEN description END AS description, n FROM series),
entries AS (SELECT *, {NORMALISED} AS words FROM cleaned)"""

ORACLE_SQL = {
    "earliest_study": f"WITH {STUDIES} SELECT name, strftime(study_date, '%Y-%m-%d') AS study_date, phase, series FROM (SELECT *, min(study_date) OVER (PARTITION BY name) AS first_date FROM studies) WHERE study_date = first_date AND phase IN ('pre-contrast', 'arterial', 'pv')",
    "cohort_having": f"""WITH {STUDIES}, once AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY name, phase) AS times FROM studies) WHERE times = 1 AND name NOT IN (1, 2, 3))
SELECT name, array_to_string(list_sort(list(DISTINCT phase)), '|') AS phases FROM once GROUP BY name HAVING count(DISTINCT phase) >= 2 AND bool_or(phase = 'pv')""",
    "normalized_desc": f"WITH {CLEANED} SELECT row, uid, description, n, words FROM entries",
    "prioritized_match": f"""WITH {CLEANED}, {FOLDERS}, f AS (SELECT folder, folder % {PATIENTS} AS patient, uid, n_slices, {NORMALISED} AS words FROM folders), e AS (SELECT *, row % {PATIENTS} AS patient FROM entries),
u AS (SELECT patient, trim(uid) AS uid, max(row) AS r FROM e WHERE uid IS NOT NULL GROUP BY ALL), b AS (SELECT patient, words, n, max(row) AS r FROM e WHERE description IS NOT NULL GROUP BY ALL), w AS (SELECT patient, words, max(row) AS r FROM e WHERE description IS NOT NULL GROUP BY ALL)
SELECT folder, coalesce(u.r, b.r, w.r) AS row, CASE WHEN u.r IS NOT NULL THEN 'uid' WHEN b.r IS NOT NULL THEN 'description and slices' ELSE 'description' END AS matched_by
FROM f LEFT JOIN u ON f.patient = u.patient AND f.uid = u.uid LEFT JOIN b ON f.patient = b.patient AND f.words = b.words AND f.n_slices = b.n LEFT JOIN w ON f.patient = w.patient AND f.words = w.words WHERE coalesce(u.r, b.r, w.r) IS NOT NULL""",
    "session_pick": """WITH s AS (SELECT o_custkey AS patient, CASE WHEN o_orderkey % 97 = 0 THEN 'undated' ELSE strftime(o_orderdate, '%m-%d-%Y') || '-' || o_orderkey END AS session FROM orders),
t AS (SELECT *, try_strptime(substr(session, 1, 10), '%m-%d-%Y') AS day FROM s)
SELECT patient, session FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY day, session) AS place, bool_or(day IS NULL) OVER (PARTITION BY patient) AS bad FROM t) WHERE place = 1 AND NOT bad""",
    "modal_value": """WITH c AS (SELECT l_suppkey AS volume, l_linenumber, count(*) AS n, min({'s': l_shipdate, 'o': l_orderkey}) AS seen FROM lineitem GROUP BY ALL)
SELECT volume, l_linenumber, n FROM (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY n DESC, seen, l_linenumber) AS place FROM c) WHERE place = 1""",
    "label_merge": f"""WITH {LABELLED}, m AS (SELECT volume, z, y, x, max(label) AS label FROM lab GROUP BY ALL)
SELECT m.volume, m.label, count(*) AS n, any_value(s.several) AS several FROM m JOIN (SELECT volume, count(DISTINCT label) > 1 AS several FROM lab GROUP BY volume) s USING (volume) GROUP BY m.volume, m.label""",
    "mask_overlap": f"""WITH {MASKS}, {DENSE_MASKS}, al AS (SELECT * FROM vox UNION ALL SELECT -1, side, z, y, x FROM dense),
f AS (SELECT volume, z, y, x, max(CAST(side = 'F' AS INTEGER)) AS a, max(CAST(side = 'O' AS INTEGER)) AS b FROM al GROUP BY ALL),
s AS (SELECT volume, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b, CAST(sum(a * b) AS BIGINT) AS n_both, count(*) AS n_any FROM f GROUP BY volume)
SELECT *, round(2.0 * n_both / (n_a + n_b), 6) AS dsc, round(1 - 2.0 * n_both / (n_a + n_b), 6) AS dsc_loss, round((n_a - n_b) / nullif(n_b, 0)::DOUBLE, 6) AS rvd FROM s""",
    "mask_centroid_shift": f"""WITH {MASKS}, c AS (SELECT volume, side, avg(z) AS z, avg(y) AS y, avg(x) AS x FROM vox GROUP BY ALL)
SELECT volume, round(f.z - m.z, 6) AS tz, round(f.y - m.y, 6) AS ty, round(f.x - m.x, 6) AS tx, 0.0::DOUBLE AS rz, 0.0::DOUBLE AS ry, 0.0::DOUBLE AS rx FROM (SELECT * FROM c WHERE side = 'F') f JOIN (SELECT * FROM c WHERE side = 'O') m USING (volume)""",
    "slice_bbox": f"WITH {MASKS} SELECT volume, side, z, count(*) AS n, min(x) AS x_min, min(y) AS y_min, max(x) + 1 AS x_max, max(y) + 1 AS y_max FROM vox GROUP BY ALL",
    "prompt_anchors": f"""WITH {DENSE_MASKS}, b AS (SELECT volume, side, z, count(*) AS n, min(x) AS x_min, min(y) AS y_min, max(x) + 1 AS x_max, max(y) + 1 AS y_max FROM dense GROUP BY ALL),
e AS (SELECT *, min(z) OVER w AS z0, max(z) OVER w AS z1, greatest(1, count(*) OVER w // 7) AS step, first_value(z) OVER (PARTITION BY volume, side ORDER BY n DESC, z) AS fullest FROM b WINDOW w AS (PARTITION BY volume, side))
SELECT volume, side, z, n, x_min, y_min, x_max, y_max FROM e WHERE (z - z0) % step = 0 OR z = z1 OR z = fullest""",
    "union_roi": f"""WITH {MASKS} SELECT volume, greatest(0, min(z) - 3) AS z_min, greatest(0, min(y) - 3) AS y_min, greatest(0, min(x) - 3) AS x_min,
least({SHAPE['z']}, max(z) + 4) AS z_max, least({SHAPE['y']}, max(y) + 4) AS y_max, least({SHAPE['x']}, max(x) + 4) AS x_max FROM vox GROUP BY volume""",
    "boundary_voxels": f"WITH {DENSE_MASKS} SELECT * FROM {EDGE_OF.format(m='dense')}",
    "surface_metrics": surface_sql(MASKS, "vox"),
    "surface_metrics_dense": surface_sql(DENSE_MASKS, "dense"),
    "asof_tolerance": f"""WITH e AS (SELECT user_id AS key, epoch_us(ts) / 1e6 AS moment, event_type FROM events), l AS (SELECT key, moment FROM e WHERE event_type = 'click'), r AS (SELECT key, moment AS other FROM e WHERE event_type = 'purchase'),
p AS (SELECT DISTINCT l.key, l.moment, r.other FROM l JOIN r ON l.key = r.key AND abs(l.moment - r.other) < {LIMIT}), b AS (SELECT key, moment, other FROM (SELECT *, row_number() OVER (PARTITION BY key, moment ORDER BY abs(moment - other), other DESC) AS place FROM p) WHERE place = 1)
SELECT l.key, l.moment, b.other FROM l LEFT JOIN b ON l.key = b.key AND l.moment = b.moment""",
    "nearest_slice": f"""WITH {MASKS}, t AS (SELECT volume, (min(z) + max(z)) / 2 AS target FROM vox GROUP BY volume), s AS (SELECT DISTINCT volume, z, target FROM vox JOIN t USING (volume) WHERE side = 'F')
SELECT volume, z AS slice, abs(z - target) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY abs(z - target), z) AS place FROM s) WHERE place = 1""",
    "pair_quality": f"WITH {QUALITY} SELECT *, least(dsc_pv_pre, dsc_art_pre, dsc_pv_art) AS worst FROM quality",
    "quality_gate": f"""WITH {QUALITY}, p AS (SELECT patient, CASE WHEN dsc_pv_pre >= {USABLE} THEN ['pv', 'pre-contrast'] ELSE [] END || CASE WHEN dsc_art_pre >= {USABLE} THEN ['arterial', 'pre-contrast'] ELSE [] END AS l FROM quality)
SELECT patient, array_to_string(list_sort(list_distinct(l)), '|') AS phases FROM p WHERE len(l) > 0""",
    "convergence_best": f"""WITH {HISTORIES}, b AS (SELECT *, min(loss) OVER w AS best_loss, max(dsc) OVER w AS best_dsc, count(*) OVER (PARTITION BY run) AS n FROM hist WINDOW w AS (PARTITION BY run ORDER BY idx ROWS UNBOUNDED PRECEDING))
SELECT run, arg_min(loss, idx) AS first_loss, arg_max(loss, idx) AS last_loss, min(loss) AS min_loss, max(dsc) AS max_dsc, count(DISTINCT dsc) AS n_dsc, max(CASE WHEN idx = n // 5 THEN loss END) AS reference_loss,
  arg_max(best_dsc, idx) AS final_best_dsc, round(sum(best_loss), 4) AS area FROM b GROUP BY run""",
    "hu_window": """WITH h AS (SELECT l_suppkey AS volume, round(l_extendedprice * 0.01::DOUBLE + CASE WHEN l_returnflag = 'R' THEN -200.0 ELSE 0.0 END, 4) AS hu FROM lineitem),
s AS (SELECT *, CAST(trunc((greatest(-160.0, least(240.0, hu)) + 160.0) / 400.0 * 255) AS INTEGER) AS shown FROM h)
SELECT volume, CAST(sum(shown) AS BIGINT) AS total, min(shown) AS low, max(shown) AS high, round(quantile_cont(hu, 0.01), 4) AS p01, round(quantile_cont(hu, 0.99), 4) AS p99 FROM s GROUP BY volume""",
    "window_presets": """WITH h AS (SELECT l_suppkey AS volume, round(l_extendedprice * 0.01::DOUBLE + CASE WHEN l_returnflag = 'R' THEN -200.0 ELSE 0.0 END, 4) AS hu FROM lineitem),
s AS (SELECT volume, avg(hu) AS m, stddev_pop(hu) AS sd, min(hu) AS least, max(hu) AS most FROM h GROUP BY volume),
w(preset, a, b) AS (VALUES ('abdomen', -160.0::DOUBLE, 240.0::DOUBLE), ('liver', -15.0, 135.0), ('lung', -1350.0, 150.0), ('bone', -500.0, 1300.0), ('soft_tissue', -125.0, 225.0), ('none', NULL, NULL)),
k AS (SELECT volume, preset, coalesce(a, m - 2 * sd) AS lower, coalesce(b, m + 2 * sd) AS upper, least, most FROM s, w),
c AS (SELECT *, greatest(lower, least(upper, least)) AS low, greatest(lower, least(upper, most)) AS high FROM k),
v AS (SELECT c.*, (greatest(lower, least(upper, hu)) - low) / (high - low + 1e-12::DOUBLE) * 255 AS level FROM c JOIN h USING (volume))
SELECT volume, preset, round(max(lower), 3) AS lower, round(max(upper), 3) AS upper, round(avg(level), 3) AS mean_level, CASE WHEN preset <> 'none' THEN CAST(sum(CAST(trunc(level) AS BIGINT)) AS BIGINT) END AS pixels FROM v GROUP BY volume, preset""",
    "cleaned_catalogue": f"WITH {RAW_CATALOGUE} SELECT row, uid, description, n, name, phase, CAST(study_date AS VARCHAR) AS study_date FROM catalogue",
    "series_lists": f"""WITH {RAW_CATALOGUE}, f AS (SELECT *, min(study_date) OVER (PARTITION BY name) AS first FROM catalogue)
SELECT name, CAST(count(*) AS INTEGER) AS n_series, string_agg(CAST(row AS VARCHAR), '|' ORDER BY row) AS rows, string_agg(phase, '|' ORDER BY row) AS phases FROM f WHERE study_date = first AND phase IN ('pre-contrast', 'arterial', 'pv') GROUP BY name""",
    "z_gaps": f"""WITH {MASKS}, g AS (SELECT volume, side, z - lead(z) OVER w AS gap, first_value(z) OVER w - nth_value(z, 2) OVER (PARTITION BY volume, side ORDER BY z DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS top FROM (SELECT DISTINCT volume, side, z FROM vox) WINDOW w AS (PARTITION BY volume, side ORDER BY z DESC))
SELECT volume, side, round(avg(gap), 6) AS mean_gap, min(gap) AS min_gap, max(gap) AS max_gap, max(top) AS first_gap, coalesce(bool_and(abs(gap - top) <= 0.01 + 0.00001 * abs(top)), true) AS uniform FROM g GROUP BY volume, side""",
    "median_index": f"WITH {MASKS} SELECT volume, CAST(trunc(median(z)) AS INTEGER) AS index FROM vox GROUP BY volume",
    "rigid_matrix": f"WITH {start_sql()} SELECT volume, " + ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in [*(f"i{r}{c}" for r in range(3) for c in range(3)), "o0", "o1", "o2"]) + " FROM mat",
    "warp_nearest": f"WITH {DENSE_MASKS}, {matrix_sql()}, {points_sql()} SELECT side, pose, p.z, p.y, p.x FROM points p JOIN dense m ON floor(s0 + 0.5) = m.z AND floor(s1 + 0.5) = m.y AND floor(s2 + 0.5) = m.x",
    "warp_linear": f"""WITH {DENSE_MASKS}, {matrix_sql()}, {points_sql()}, c AS {CORNERS}
SELECT side, pose, c.z, c.y, c.x, round(sum(w), 6) AS value FROM c JOIN dense m ON n0 = m.z AND n1 = m.y AND n2 = m.x WHERE w > 0 GROUP BY ALL""",
    "warp_binary": f"WITH {start_sql()}, {binary_sql('O', 'mat')}",
    "warp_back": f"WITH {start_sql()}, {inverted_sql()}, {binary_sql('F', 'back')}",
    "warp_cubic": cubic_sql(f"{DENSE_MASKS}, field AS (SELECT side, z, y, x, 1.0::DOUBLE AS value FROM dense)", 0.0, 6),
    "warp_tomogram": cubic_sql(f"{TOMOGRAMS}, field AS (SELECT side, z, y, x, value + 1000.0 AS value FROM ct)", AIR, 4),
    "soft_dice": soft_dice_sql(),
    "pose_losses": losses_sql(),
}
