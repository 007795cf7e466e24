"""Series catalogues and cohorts: cleaning, matching series to folders, choosing studies and patients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PHASES = ("pre-contrast", "arterial", "pv")
REQUIRED = "pv"
LEAST_DSC = 0.8


def looks_like_uid(text: Column) -> Column:
    return text.rlike("^[0-9.]+$") & text.contains(".")


def normalised(description: Column) -> Column:
    """Lower case, other than letters and digits to spaces, words in order; repeated words stay; empty for null."""
    words = F.split(F.trim(F.regexp_replace(F.lower(description), "[^a-z0-9]+", " ")), " ")
    return F.coalesce(F.array_join(F.array_sort(words), " "), F.lit(""))


def cleaned_series(series: DataFrame) -> DataFrame:
    """A uid that stands in the description moves to its column, whatever that has; other descriptions stay as they are."""
    misplaced = F.coalesce(looks_like_uid(F.col("description")), F.lit(False))
    return series.withColumns({
        "uid": F.when(misplaced, F.col("description")).otherwise(F.col("uid")),
        "description": F.when(~misplaced, F.col("description")),
    })


def cleaned_catalogue(rows: DataFrame) -> DataFrame:
    """Catalogue rows with trimmed names, trimmed phases in lower case, and uids put in their place."""
    return cleaned_series(rows).withColumns({"name": F.trim("name"), "phase": F.lower(F.trim("phase"))})


def series_lists(rows: DataFrame) -> DataFrame:
    """(name, series): each patient's series of the first study date that are of a wanted phase, in order of row."""
    dated = rows.withColumn("_first", F.min("study_date").over(Window.partitionBy("name"))).filter("study_date = _first").filter(F.col("phase").isin(*PHASES))
    return dated.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("row", "uid", "description", "phase", "n"))).alias("series"))


def last_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last in ``order``; rows without a key are left out."""
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    return rows.groupBy(*keys).agg(F.max_by("entry", order).alias("entry"))


def match_series(folders: DataFrame, series: DataFrame) -> DataFrame:
    """Each folder with its patient's catalogue row: by uid, else by description and number of slices, else by description.

    Both have ``patient``; rows of other patients never match. Catalogue uids are trimmed. Of a patient's rows with equal
    keys the last one counts. Folders without any match, a patient or a description and uid are dropped. Columns: folder,
    row, matched_by.
    """
    entries = cleaned_series(series).withColumns({"words": normalised(F.col("description")), "entry": F.col("row"), "uid": F.trim("uid")})
    named = entries.filter("description IS NOT NULL")
    by_uid = last_by(entries, ["patient", "uid"], "row").withColumnRenamed("entry", "by_uid")
    by_both = last_by(named, ["patient", "words", "n"], "row").withColumnRenamed("entry", "by_both")
    by_words = last_by(named, ["patient", "words"], "row").withColumnRenamed("entry", "by_words")
    sides = folders.withColumns({"words": F.when(F.col("description").isNotNull(), normalised(F.col("description"))), "n": F.col("n_slices")})
    joined = sides.join(by_uid, ["patient", "uid"], "left").join(by_both, ["patient", "words", "n"], "left").join(by_words, ["patient", "words"], "left")
    how = F.when(F.col("by_uid").isNotNull(), "uid").when(F.col("by_both").isNotNull(), "description and slices").when(F.col("by_words").isNotNull(), "description")
    return joined.select("folder", F.coalesce("by_uid", "by_both", "by_words").alias("row"), how.alias("matched_by")).filter("row IS NOT NULL")


def earliest_studies(studies: DataFrame, phases=PHASES) -> DataFrame:
    """The rows of each patient's earliest day, of the wanted phases; who lacks these phases on that day is left out."""
    first = F.min("study_date").over(Window.partitionBy("name"))
    return studies.withColumn("first_date", first).filter((F.col("study_date") == F.col("first_date")) & F.col("phase").isin(*phases)).drop("first_date")


def unambiguous(studies: DataFrame) -> DataFrame:
    """Without phases that a patient has more than once: all of their rows go."""
    times = F.count(F.lit(1)).over(Window.partitionBy("name", "phase"))
    return studies.withColumn("times", times).filter("times = 1").drop("times")


def cohort(studies: DataFrame, required: str = REQUIRED, least: int = 2, discarded=()) -> DataFrame:
    """(name, phases): patients with enough phases, the required one among them, who aren't discarded."""
    grouped = studies.filter(~F.col("name").isin(*discarded)) if discarded else studies
    sets = grouped.groupBy("name").agg(F.array_sort(F.collect_set("phase")).alias("list"))
    kept = sets.filter((F.size("list") >= least) & F.array_contains("list", required))
    return kept.select("name", F.array_join("list", "|").alias("phases"))


def pick_sessions(sessions: DataFrame) -> DataFrame:
    """(patient, session): the session with the earliest MM-DD-YYYY date; patients with any unreadable date are left out."""
    day = F.try_to_timestamp(F.substring("session", 1, 10), F.lit("MM-dd-yyyy"))
    dated = sessions.withColumn("day", day)
    picked = dated.groupBy("patient").agg(F.min(F.struct("day", "session")).alias("first"), F.max(F.col("day").isNull().cast("int")).alias("unreadable"))
    return picked.filter("unreadable = 0").select("patient", "first.session")


def usable_phases(quality: DataFrame, least: float = LEAST_DSC) -> DataFrame:
    """(patient, phases): pv and pre-contrast if their Dice is high enough, arterial and pre-contrast likewise; none is left out.

    Missing and NaN values are not high enough.
    """
    good = lambda c: F.coalesce((F.col(c) >= least) & ~F.isnan(c), F.lit(False))
    some = lambda test, *names: F.when(test, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    both = F.array_union(some(good("dsc_pv_pre"), "pv", "pre-contrast"), some(good("dsc_art_pre"), "arterial", "pre-contrast"))
    return quality.select("patient", F.array_sort(both).alias("list")).filter(F.size("list") > 0).select("patient", F.array_join("list", "|").alias("phases"))
