"""Image series: their slices, heights and orientation, phases with masks, lookups, what is left to do and how it ended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .intensity import slice_height
from .masks import BIT

#: A direction counts as the standard one, or as none, within this.
ALIKE = 1e-3
#: Beyond this a direction's share along the other axis means that rows and columns are exchanged.
EXCHANGED = 0.9


def series_slices(slices: DataFrame, key: str) -> DataFrame:
    """A series' slices with their height ``z`` and ``place`` from the top, 0 first; of one acquisition only.

    ``slices`` has position, location, acquisition, wanted and seen, the order in which they are read. Slices without a
    height go. Of the others those of the wanted acquisition stay; where none is wanted, or there, those of the most
    frequent one (no acquisition counts as one of its own; of equally frequent ones that which is met first stays).
    """
    placed = slices.withColumn("z", slice_height(F.col("position"), F.col("location"))).filter("z IS NOT NULL")
    wanted = F.coalesce(F.col("acquisition") == F.col("wanted"), F.lit(False))
    counted = placed.groupBy(key, "acquisition").agg(F.max(wanted).alias("_wanted"), F.count(F.lit(1)).alias("_n"), F.min("seen").alias("_seen"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_wanted"), F.desc("_n"), F.asc("_seen")))
    chosen = counted.withColumn("_best", best).filter("_best = 1").select(key, F.col("acquisition").alias("_acquisition"))
    kept = placed.join(chosen.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")) & F.col("acquisition").eqNullSafe(F.col("_acquisition")))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("z"))) - 1
    return kept.drop("_key", "_acquisition").withColumn("place", place)


def heights(frames: DataFrame, keys: Sequence[str], z: str = "z") -> DataFrame:
    """(keys, z, place): the different heights from top to bottom, 0 first."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(z))) - 1
    return frames.select(*keys, z).distinct().withColumn("place", place)


def slice_spacing(between: Column, thickness: Column) -> Column:
    """The spacing between slices, else their thickness."""
    return F.coalesce(between, thickness)


def phases_with_masks(series: DataFrame, masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series that have a mask of the same shape (nz, ny, nx); a shape that isn't known equals none."""
    shape = ["nz", "ny", "nx"]
    return series.join(masks.select(*keys, *shape), [*keys, *shape], "left_semi")


def required_rows(wanted: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """For each row of ``wanted`` (keys) the first row with these keys in ``order``; one that has none is an error."""
    others = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_first"))
    named = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    sure = F.when(F.col("_first").isNull(), F.raise_error(F.concat(F.lit("no row for "), named)).cast(first.schema["_first"].dataType)).otherwise(F.col("_first"))
    return wanted.select(*keys).join(first, list(keys), "left").withColumn("_first", sure).select(*keys, "_first.*")


def not_done(tasks: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks whose result isn't there yet, so that a rerun does only what is missing."""
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def registration_tasks(usable: DataFrame, present: DataFrame, fixed: str, moving: Sequence[str]) -> DataFrame:
    """(patient, fixed, moving): patients whose quality allows the fixed phase, who are present, by moving phase allowed.

    ``usable`` has the allowed phases as text with bars between them.
    """
    allowed = usable.join(present.select("patient").distinct(), "patient", "left_semi").withColumn("_phases", F.split("phases", "[|]")).filter(F.array_contains("_phases", fixed))
    return allowed.select("patient", F.lit(fixed).alias("fixed"), F.explode(F.array_intersect(F.array(*map(F.lit, moving)), F.col("_phases"))).alias("moving"))


def figure_name(name: Column) -> tuple[Column, Column]:
    """Patient and label of a figure's file name, parted at the last "_ct"; without one all is the patient and the label empty."""
    stem = F.replace(F.replace(name, F.lit("Visualize_")), F.lit(".jpg"))
    parted = stem.contains("_ct")
    patient = F.when(parted, F.regexp_extract(stem, "(?s)^(.*)_ct", 1)).otherwise(stem)
    return patient, F.when(parted, F.concat(F.lit("CT"), F.regexp_extract(stem, "(?s)^.*_ct(.*)$", 1))).otherwise(F.lit(""))


def vector_text(values: Column, digits: int = 4) -> Column:
    """Numbers as text in square brackets, with commas."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.round(v, digits).cast("string")), ","), F.lit("]"))


def text_vector(text: Column) -> Column:
    """The numbers of such a text; white space is of no account, an empty vector has none, unreadable ones are null."""
    inner = F.regexp_replace(F.regexp_replace(text, r"\s+", ""), r"^\[|\]$", "")
    return F.when(inner == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(inner, ","), lambda v: v.try_cast("double")))


def axis_slice(voxels: DataFrame, axis: str, index: Column | int) -> DataFrame:
    """The voxels of one plane across an axis (z, y or x), which goes."""
    return voxels.filter(F.col(axis) == index).drop(axis)


def clipped_anchor(boxes: DataFrame, keys: Sequence[str], wanted: str, slices: str) -> DataFrame:
    """Per group the slice ``z`` nearest to the wanted one after that is cut to 0 to slices - 1; only slices in there count.

    Of equally near ones the lower. Groups without any slice in range have none and are left out.
    """
    aim = F.greatest(F.lit(0), F.least(F.col(wanted), F.col(slices) - 1))
    inside = boxes.filter((F.col(slices) > 0) & (F.col("z") < F.col(slices)))
    return inside.groupBy(*keys).agg(F.min(F.struct(F.abs(F.col("z") - aim).alias("gap"), "z")).alias("best")).select(*keys, "best.z", "best.gap")


def survival(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group the number of slices with voxels before and after resampling, and their ratio; 0 if there were none."""
    blocks = lambda rows: rows.groupBy(*keys, F.floor(F.col("z") / 64).alias("_block")).agg(F.expr(f"bit_or({BIT})").alias("slices"))
    slices = lambda rows, name: blocks(rows).groupBy(*keys).agg(F.coalesce(F.sum(F.bit_count("slices").cast("long")), F.lit(0)).alias(name))
    both = slices(before, "n_before").join(slices(after, "n_after"), list(keys), "full").fillna(0, ["n_before", "n_after"])
    return both.withColumn("ratio", F.coalesce(F.try_divide(F.col("n_after"), F.col("n_before")), F.lit(0.0)))


def set_aside(items: DataFrame, faults: dict[str, Column], required: str) -> tuple[DataFrame, DataFrame]:
    """Items (patient, phase and more) that have no fault, and those that go, with their ``error``.

    The first fault that holds is an item's error; a null test is no fault. Where a patient's ``required`` phase fails, the
    patient's other phases go with it. The marked items are stored once, so both outputs tell of the same run.
    """
    first = F.coalesce(*[F.when(test, F.lit(name)) for name, test in faults.items()], F.lit(None).cast("string"))
    marked = items.withColumn("error", first)
    lost = F.max((F.coalesce(F.col("phase") == required, F.lit(False)) & F.col("error").isNotNull()).cast("int")).over(Window.partitionBy("patient")) == 1
    whole = stored(marked.withColumn("error", F.coalesce("error", F.when(lost & F.col("patient").isNotNull(), f"{required} failed"))), "marked")
    return whole.filter("error IS NULL").drop("error"), whole.filter("error IS NOT NULL")


def outcome_report(known: DataFrame, good: DataFrame, failed: DataFrame, required: str) -> DataFrame:
    """(kind, reason, n): patients by ``outcomes`` of what is there already and what is new, and failed items by error.

    ``known`` and ``good`` have patient and phase; patients all of whose items failed count as lacking the required phase.
    """
    none = failed.select("patient", F.lit(None).cast("string").alias("phase"))
    patients = outcomes(known.select("patient", "phase").unionByName(good.select("patient", "phase")).unionByName(none), required)
    items = failed.groupBy(F.col("error").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return patients.select(F.lit("patients").alias("kind"), "reason", "n").unionByName(items.select(F.lit("items").alias("kind"), "reason", "n"))


def outcomes(done: DataFrame, required: str, least: int = 2) -> DataFrame:
    """(reason, n): how many patients are usable, lack the required phase, or have too few; ``done`` has null for no phase."""
    sets = done.groupBy("patient").agg(F.collect_set("phase").alias("phases"))
    reason = F.when(~F.array_contains("phases", required), f"no {required}").when(F.size("phases") < least, f"fewer than {least} phases").otherwise("usable")
    return sets.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def repair(cosines: Column) -> tuple[Column, Column, Column]:
    """(quarter turns, flip along x, flip along y) that bring an in-plane orientation of six direction cosines to the standard one.

    Nothing is to be done where the cosines are the standard ones. Two flips are half a turn.
    """
    c = [cosines[i] for i in range(6)]
    standard = F.lit(True)
    for value, aim in zip(c, (1, 0, 0, 0, 1, 0), strict=True):
        standard = standard & (F.abs(value - aim) <= ALIKE + 1e-5 * aim)
    rows, columns = c[0] < 0, c[4] < 0
    turns = F.when(standard, 0).when(rows & columns, 2).when(F.abs(c[3]) > EXCHANGED, F.when(c[3] > 0, 1).otherwise(3)).otherwise(0)
    both = rows & columns
    return turns, ~standard & rows & ~both, ~standard & columns & ~both


def reoriented(voxels: DataFrame, cosines: str) -> DataFrame:
    """Voxels (y, x on a plane of ny by nx) in the standard orientation: quarter turns from y to x first, then flips."""
    turns, flip_x, flip_y = repair(F.col(cosines))
    y, x, ny, nx = (F.col(c) for c in ("y", "x", "ny", "nx"))
    turned = voxels.withColumns({
        "_x_flip": flip_x, "_y_flip": flip_y,
        "_ny": F.when(turns % 2 == 1, nx).otherwise(ny),
        "_nx": F.when(turns % 2 == 1, ny).otherwise(nx),
        "_y": F.when(turns == 1, nx - 1 - x).when(turns == 2, ny - 1 - y).when(turns == 3, x).otherwise(y),
        "_x": F.when(turns == 1, y).when(turns == 2, nx - 1 - x).when(turns == 3, ny - 1 - y).otherwise(x),
    })
    placed = turned.withColumns({
        "y": F.when(F.col("_y_flip"), F.col("_ny") - 1 - F.col("_y")).otherwise(F.col("_y")),
        "x": F.when(F.col("_x_flip"), F.col("_nx") - 1 - F.col("_x")).otherwise(F.col("_x")),
        "ny": F.col("_ny"), "nx": F.col("_nx"),
    })
    return placed.drop("_x_flip", "_y_flip", "_ny", "_nx", "_y", "_x")
