"""Block designs: descriptive tables, tie-averaged ranks, omnibus and paired statistics over long tables.

Facts stay long: a row for each block and treatment. Missing values are null, never NaN; ``clean`` makes them so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..shared import stored

#: Which metrics are better the higher they are.
HIGHER_IS_BETTER = {"dsc_final": True, "nsd_final": True, "assd_final": False, "hd_final": False, "hd95_final": False, "loss_final": False, "n_feval": False}
ZERO_TOLERANCE = 1e-8


def clean(column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(value), value)


def describe(facts: DataFrame, keys: list[str], metric: str, digits: int = 3, higher_is_better: bool = True) -> DataFrame:
    """Per group the number of values, mean, sample deviation and median, rounded half to even; best groups first within the first key."""
    value = clean(metric)
    grouped = facts.dropna(subset=keys).groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.bround(F.avg(value), digits).alias("mean"),
        F.bround(F.stddev_samp(value), digits).alias("std"),
        F.bround(F.median(value), digits).alias("median"),
    )
    best = F.desc_nulls_last("mean") if higher_is_better else F.asc_nulls_last("mean")
    return grouped.orderBy(keys[0], best)


def describe_columns(facts: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """(baseline, mean, std, median) over all rows for each of some columns."""
    long = facts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("baseline"), clean(c).alias("value")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("baseline").agg(*[F.bround(f("value"), digits).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("median", F.median))])


def count_by(facts: DataFrame, key: str) -> DataFrame:
    return facts.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(key)


def block_check(facts: DataFrame, group: str, block: str, treatment: str, metric: str, treatments: int) -> DataFrame:
    """Per group what a complete block design needs: no repeated pairs, all treatments, no missing values."""
    value = clean(metric)
    pairs = facts.groupBy(group, block, treatment).agg(F.count(F.lit(1)).alias("times"))
    most = pairs.groupBy(group).agg(F.max("times").alias("most_repeats"), F.count_distinct(treatment).alias("treatments"))
    blocks = facts.groupBy(group, block).agg(F.count(value).alias("values"), F.count_distinct(value).alias("distinct"))
    per_group = blocks.groupBy(group).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum((F.col("values") < treatments).cast("long")).alias("incomplete"),
        F.bround(F.avg("distinct"), 4).alias("mean_distinct"),
        F.min("distinct").alias("min_distinct"),
    )
    good = (F.col("most_repeats") == 1) & (F.col("treatments") == treatments) & (F.col("incomplete") == 0)
    return most.join(per_group, group).withColumn("complete", good)


def require_complete(check: DataFrame, group: str) -> DataFrame:
    """The check's rows; a query that reads an incomplete group's row fails."""
    fails = F.raise_error(F.concat(F.lit("incomplete block design: "), F.col(group).cast("string")))
    return check.withColumn("complete", F.when(F.col("complete"), F.lit(True)).otherwise(fails.cast("boolean")))


def complete_blocks(facts: DataFrame, group: str, block: str, metric: str, treatments: int) -> DataFrame:
    """The rows of blocks that have a value for every treatment."""
    whole = facts.groupBy(group, block).agg(F.count(clean(metric)).alias("values")).filter(F.col("values") == treatments)
    return facts.join(whole.select(group, block), [group, block], "left_semi")


def rank_in_blocks(facts: DataFrame, blocks: list[str], metric: str, higher_is_better: bool = True) -> DataFrame:
    """Adds ``rank`` (1 is best; equal values share the mean of their ranks) and ``tied``, the number of equal values."""
    value = F.desc(metric) if higher_is_better else F.asc(metric)
    tied = F.count(F.lit(1)).over(Window.partitionBy(*blocks, metric))
    lowest = F.rank().over(Window.partitionBy(*blocks).orderBy(value))
    return facts.withColumns({"tied": tied, "rank": lowest + (tied - 1) / 2})


def mean_ranks(ranked: DataFrame, group: str, treatment: str) -> DataFrame:
    return ranked.groupBy(group, treatment).agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("blocks")).orderBy(group, "mean_rank")


def friedman(ranked: DataFrame, group: str, block: str, treatment: str) -> DataFrame:
    """Per group: blocks, treatments, tie-corrected chi-square, Kendall's W, and Iman and Davenport's F with its degrees of freedom.

    Perfect separation leaves F infinite. Fewer than two treatments or blocks give nulls.
    """
    sums = ranked.groupBy(group, treatment).agg(F.sum("rank").alias("total"))
    squares = sums.groupBy(group).agg(F.sum(F.col("total") * F.col("total")).alias("squares"), F.count(F.lit(1)).alias("k"))
    # a value's t ties add t^3 - t in all, which is t^2 - 1 for each of them
    ties = ranked.groupBy(group).agg(F.count_distinct(block).alias("n"), F.sum(F.col("tied") * F.col("tied") - 1).alias("ties"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    raw = 12 / (n * k * (k + 1)) * F.col("squares") - 3 * n * (k + 1)
    corrected = F.try_divide(raw, 1 - F.try_divide(F.col("ties").cast("double"), n * (k * k * k - k)))
    rest = n * (k - 1) - F.col("chi2")
    return (
        squares.join(ties, group)
        .withColumn("chi2", corrected)
        .select(
            group,
            "n",
            "k",
            "chi2",
            F.try_divide(F.col("chi2"), n * (k - 1)).alias("w"),
            F.when(rest <= 0, F.lit(float("inf"))).otherwise(F.try_divide((n - 1) * F.col("chi2"), rest)).alias("f"),
            (k - 1).cast("long").alias("df1"),
            ((k - 1) * (n - 1)).cast("long").alias("df2"),
        )
    )


def nemenyi(means: DataFrame, group: str, treatment: str) -> DataFrame:
    """All pairs of treatments with their mean ranks' difference and the studentised statistic q."""
    others = means.select(F.col(group).alias("_group"), F.col(treatment).alias("other"), F.col("mean_rank").alias("_rank"))
    k = F.count(F.lit(1)).over(Window.partitionBy(group))
    with_k = means.withColumn("k", k)
    pairs = with_k.join(others, (F.col(group) == F.col("_group")) & (F.col(treatment) < F.col("other")))
    difference = F.abs(F.col("mean_rank") - F.col("_rank"))
    spread = F.sqrt(F.col("k") * (F.col("k") + 1) / (6 * F.col("blocks")))
    return pairs.select(group, treatment, "other", "k", "blocks", difference.alias("difference"), (difference / spread * F.sqrt(F.lit(2.0))).alias("q"))


def significant(ranked: DataFrame, group: str, block: str, treatment: str, alpha: float = 0.05) -> DataFrame:
    """The groups of more than two treatments whose omnibus test (Iman and Davenport's F) is below alpha, with its p."""
    tested = friedman(ranked, group, block, treatment).withColumn("p_omnibus", tails.f_tail(F.col("f"), F.col("df1"), F.col("df2")))
    return tested.filter((F.col("k") > 2) & (F.col("p_omnibus") < alpha)).select(group, "p_omnibus")


def gated_posthoc(ranked: DataFrame, group: str, block: str, treatment: str, alpha: float = 0.05) -> DataFrame:
    """(group, treatment, other, q, p): all pairs of the groups that pass ``significant``; groups that don't have no rows."""
    passed = ranked.join(significant(ranked, group, block, treatment, alpha), group, "left_semi")
    pairs = nemenyi(mean_ranks(passed, group, treatment), group, treatment)
    return pairs.select(group, treatment, "other", "q", tails.range_tail(F.col("q"), F.col("k")).alias("p"))


def rank_bars(ranked: DataFrame, group: str, block: str, treatment: str, alpha: float = 0.05) -> DataFrame:
    """(group, first, last, n, best, worst): maximal runs of two and more treatments by mean rank none of which differ.

    They are the bars of a critical-difference diagram, of the groups that pass ``significant``; ``best`` and ``worst`` are
    the mean ranks at a run's ends. Of equal mean ranks the treatment's name decides the order.
    """
    passed = ranked.join(significant(ranked, group, block, treatment, alpha), group, "left_semi")
    means = mean_ranks(passed, group, treatment)
    order = Window.partitionBy(group).orderBy("mean_rank", treatment)
    placed = means.select(group, treatment, "mean_rank", F.row_number().over(order).alias("place"))
    alike = nemenyi(means, group, treatment).filter(tails.range_tail(F.col("q"), F.col("k")) >= alpha)
    side = lambda name, as_name: placed.select(group, F.col(treatment).alias(name), F.col("place").alias(as_name))
    reached = alike.select(group, F.col(treatment).alias("_a"), F.col("other").alias("_b")).join(side("_a", "_i"), [group, "_a"]).join(side("_b", "_j"), [group, "_b"])
    ends = reached.groupBy(group, F.least("_i", "_j").alias("place")).agg(F.max(F.greatest("_i", "_j")).alias("end"))
    whole = placed.join(ends, [group, "place"], "left").withColumn("end", F.coalesce("end", "place"))
    bars = whole.withColumn("_before", F.coalesce(F.lag("end").over(Window.partitionBy(group).orderBy("place")), F.lit(0))).filter("end > place AND end > _before")
    lasts = placed.select(group, F.col("place").alias("end"), F.col(treatment).alias("last"), F.col("mean_rank").alias("worst"))
    return bars.join(lasts, [group, "end"]).select(group, F.col(treatment).alias("first"), "last", (F.col("end") - F.col("place") + 1).alias("n"), F.col("mean_rank").alias("best"), "worst")


#: Ranks within so many deviations of the middle, and pairs of ranks so far apart, hold a resampled median but for 1e-15.
MEDIAN_SPREAD, MEDIAN_APART = 8.0, 40


def bootstrap_median(differences: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    """(keys, median, low, high): the percentile interval of the median's bootstrap distribution, without resampling.

    Of n values in order, the chance that the median of n draws is the i-th (or, for even n, the mean of the i-th and the
    j-th) follows from binomial tails and powers; the interval's ends are the least values at which the summed chances
    reach the two levels. Only ranks near the middle are looked at: their number grows with the root of n. Null and NaN
    differences are left out; equal values take ranks of their own.
    """
    d = differences.select(*keys, clean("d").alias("d")).filter("d IS NOT NULL")
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("double")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("d")).cast("double")
    placed = d.withColumns({"n": size, "i": rank}).withColumn("h", F.floor((F.col("n") + 1) / 2).cast("double"))
    near = placed.filter(F.abs(F.col("i") - F.col("h")) <= MEDIAN_SPREAD * F.sqrt("n") / 2 + MEDIAN_APART)
    n, i, h = F.col("n"), F.col("i"), F.col("h")
    ways = tails.log_gamma(n + 1) - tails.log_gamma(h + 1) - tails.log_gamma(n - h + 1)
    power = lambda share, k: F.when(share > 0, F.exp(ways / 2 + k * F.log(share))).otherwise(0.0)  # noqa: E731  each takes half of the factor
    below = lambda at: tails.beta_below(h, n - h + 1, at / n)  # noqa: E731  the h-th of n draws is at most the at-th value
    lower = power(i / n, h) - power((i - 1) / n, h)
    upper = lambda at: power(1 - (at - 1) / n, n - h) - power(1 - at / n, n - h)
    even = F.col("n") % 2 == 0
    both = stored(near.withColumns({"own": below(i) - below(i - 1) - F.when(even, lower * power(1 - i / n, n - h)).otherwise(0.0), "lower": lower, "upper": upper(i)}), "median-ranks")
    first = both.filter(even).select(*keys, F.col("d").alias("_d"), "lower", F.explode(F.sequence(F.lit(1), F.lit(MEDIAN_APART))).alias("_step"), "i").withColumn("i", F.col("i") + F.col("_step")).select(*keys, "i", "_d", F.col("lower").alias("_lower"))
    pairs = first.join(both.select(*keys, "i", "d", "upper"), [*keys, "i"]).select(*keys, ((F.col("_d") + F.col("d")) / 2).alias("value"), (F.col("_lower") * F.col("upper")).alias("chance"))
    chances = both.select(*keys, F.col("d").alias("value"), F.col("own").alias("chance")).unionByName(pairs)
    summed = chances.groupBy(*keys, "value").agg(F.sum("chance").alias("chance")).withColumn("total", F.sum("chance").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda share: F.min(F.when(F.col("total") >= share - 1e-12, F.col("value")))
    ends = summed.groupBy(*keys).agg(at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high"))
    return d.groupBy(*keys).agg(F.median("d").alias("median")).join(ends, keys)


def with_controls(facts: DataFrame, group: str, block: str, treatment: str, metric: str, control: str) -> DataFrame:
    """(group, treatment, block, d): each value less its block's control, which is constant in a block; pairs that lack either (null or NaN) go."""
    controls = facts.groupBy(group, block).agg(F.min(clean(control)).alias("_control"))
    return facts.select(group, block, treatment, metric).join(controls, [group, block]).select(group, treatment, block, (clean(metric) - F.col("_control")).alias("d")).filter("d IS NOT NULL")


def paired_summary(differences: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: pairs, zeros, signs, biased skewness and median of the differences."""
    d = F.col("d")
    return differences.groupBy(*keys).agg(
        F.count(d).alias("n"),
        F.sum((d == 0).cast("long")).alias("zeros"),
        F.sum((d > 0).cast("long")).alias("plus"),
        F.sum((d < 0).cast("long")).alias("minus"),
        F.skewness(d).alias("skew"),
        F.median(d).alias("median"),
    )


def no_improvement(differences: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the percentages that got worse, stayed (within a tolerance) and did not improve."""
    percent = lambda test: F.avg(test.cast("double")) * 100
    d = F.col("d")
    return differences.groupBy(*keys).agg(
        F.count(d).alias("n"), percent(d < 0).alias("pct_worse"), percent(F.abs(d) <= ZERO_TOLERANCE).alias("pct_same"), percent(d <= 0).alias("pct_no_better")
    )


def holm(tests: DataFrame, p: str, order: list[str], alpha: float = 0.05) -> DataFrame:
    """Adds Holm's step-down adjusted p-values over all rows of a table of tests (a few rows), and whether they are below alpha."""
    ordered = Window.orderBy(p, *order)
    m = F.count(F.lit(1)).over(Window.partitionBy())
    raw = (m - F.row_number().over(ordered) + 1) * F.col(p)
    adjusted = F.least(F.lit(1.0), F.max("_raw").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return tests.withColumn("_raw", raw).withColumn("p_adj", adjusted).drop("_raw").withColumn("significant", F.col("p_adj") < alpha)


def relevance(low: str, high: str, delta: float) -> Column:
    """Whether an interval lies wholly from a threshold on, wholly below it, or across it."""
    return F.when(F.col(low) >= delta, "relevant").when(F.col(high) < delta, "below threshold").otherwise("undecided")


def histogram(differences: DataFrame, keys: list[str], bins: int = 15) -> DataFrame:
    """(keys, bin, n): counts in bins of equal width from the least to the largest difference; the last bin has its end."""
    ends = differences.groupBy(*keys).agg(F.min("d").alias("low"), F.max("d").alias("high"))
    share = F.try_divide(F.col("d") - F.col("low"), F.col("high") - F.col("low"))
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(share, F.lit(0.0)) * bins)).cast("int")
    return differences.join(ends, keys).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def wide(facts: DataFrame, keys: list[str], treatment: str, values: list[str], metric: str) -> DataFrame:
    """A row for each block and a column for each treatment; fails when a block has a treatment twice."""
    once = F.when(F.count(metric) > 1, F.raise_error(F.lit("a block has a treatment twice")).cast("double")).otherwise(F.first(metric, ignorenulls=True))
    return facts.groupBy(*keys).pivot(treatment, values).agg(once)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows whose key the batch lacks, and the batch; columns go by name, missing ones are null."""
    keys = new.select(key).distinct()
    return old.join(keys, key, "left_anti").unionByName(new, allowMissingColumns=True)
