"""Queries on experiments, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill.functions import tails
from voxelmill.operators import block_statistics as bs
from voxelmill.sources.views import EXPERIMENTS, experiments

#: Losses times optimizers in the experiments view.
TREATMENTS = 15
DELTA = 0.02


def ranked(spark, d):
    whole = bs.complete_blocks(experiments(spark, d), "phase", "block", "metric", TREATMENTS)
    return bs.rank_in_blocks(whole, ["phase", "block"], "metric")


RANKED = EXPERIMENTS + f""",
whole AS (SELECT phase, block FROM exp GROUP BY ALL HAVING count(metric) = {TREATMENTS}),
ranked AS (SELECT *, rank() OVER (PARTITION BY phase, block ORDER BY metric DESC) + (tied - 1) / 2.0::DOUBLE AS rank
  FROM (SELECT e.*, count(*) OVER (PARTITION BY e.phase, e.block, metric) AS tied FROM exp e JOIN whole USING (phase, block))),
means AS (SELECT phase, config, avg(rank) AS mean_rank, count(*) AS blocks FROM ranked GROUP BY ALL),
diffs AS (SELECT phase, config, block, metric - control AS d FROM exp)"""


def rounded(df, digits: int, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def differences(spark, d):
    return bs.with_controls(experiments(spark, d), "phase", "block", "config", "metric", "control")


def assumption_gate(spark, d):
    return bs.block_check(experiments(spark, d), "phase", "block", "config", "metric", TREATMENTS)


def friedman_stats(spark, d):
    return rounded(bs.friedman(ranked(spark, d), "phase", "block", "config"), 6, "chi2", "w", "f")


def holm_adjust(spark, d):
    share = F.round(F.avg((F.col("d") <= 0).cast("double")) / 10, 6)
    tests = differences(spark, d).groupBy("phase", "config").agg(share.alias("p"))
    return rounded(bs.holm(tests, "p", ["phase", "config"]), 6, "p_adj")


def relevance_label(spark, d):
    ends = differences(spark, d).groupBy("phase", "config").agg(F.round(F.expr("percentile(d, 0.25)"), 4).alias("low"), F.round(F.expr("percentile(d, 0.75)"), 4).alias("high"))
    return ends.withColumn("label", bs.relevance("low", "high", DELTA))


def upsert_by_config(spark, d):
    facts = experiments(spark, d).select("block", "phase", "config", "metric")
    batch = facts.filter("config LIKE '1-%'").withColumn("metric", F.round(F.col("metric") + 1, 6))
    return bs.upsert(facts, batch, "config")


def grid_tasks(spark, d):
    """Fixed and moving phases of complete blocks, crossed with losses and optimizers."""
    facts = experiments(spark, d)
    blocks = facts.groupBy("block").agg(F.collect_set("phase").alias("phases")).filter(F.array_contains("phases", "even"))
    moving = blocks.select("block", F.lit("even").alias("fixed"), F.explode(F.array_except("phases", F.array(F.lit("even")))).alias("moving"))
    grid = facts.select("loss").distinct().crossJoin(facts.select("optimizer").distinct())
    return moving.crossJoin(grid).select("block", "fixed", "moving", F.concat("fixed", F.lit("<-"), "moving").alias("pair"), F.concat_ws("_", "loss", "optimizer").alias("config"))


def wide_blocks(spark, d):
    return bs.wide(experiments(spark, d), ["block", "phase", "loss"], "optimizer", ["F", "O", "P"], "metric")


def friedman_p(spark, d):
    """Tail probabilities of the omnibus statistics, a row for each phase."""
    found = bs.friedman(ranked(spark, d), "phase", "block", "config").filter("chi2 IS NOT NULL")
    return rounded(found.select("phase", tails.chi2_tail(F.col("chi2"), F.col("df1")).alias("p_chi2"), tails.f_tail(F.col("f"), F.col("df1"), F.col("df2")).alias("p_f")), 9, "p_chi2", "p_f")


def nemenyi_p(spark, d):
    """All pairs with the studentised range's tail probability."""
    pairs = bs.nemenyi(bs.mean_ranks(ranked(spark, d), "phase", "config"), "phase", "config")
    return rounded(pairs.select("phase", "config", "other", "q", tails.range_tail(F.col("q"), F.col("k")).alias("p")), 6, "q", "p")


def sign_p(spark, d):
    """One-sided exact sign tests with Holm's adjustment."""
    counts = bs.paired_summary(differences(spark, d), ["phase", "config"])
    tests = counts.select("phase", "config", "n", "zeros", "plus", F.round(tails.sign_tail(F.col("plus"), F.col("plus") + F.col("minus")), 9).alias("p"))
    return rounded(bs.holm(tests, "p", ["phase", "config"]), 8, "p_adj")


def bootstrap_ci(spark, d):
    """Median difference with the 95 % percentile interval of its bootstrap distribution."""
    found = rounded(bs.bootstrap_median(differences(spark, d), ["phase", "config"]), 6, "median", "low", "high")
    return found.withColumn("label", bs.relevance("low", "high", DELTA))


def measures(spark, d):
    """(group, block, config, metric) of complete blocks, ranked: by phase mean prices as they are, and weighed by state, so that states differ."""
    facts = experiments(spark, d)
    weighed = F.round(F.col("metric") * F.when(F.col("optimizer") == "F", 1.0).when(F.col("optimizer") == "O", 1.1).otherwise(1.25), 6)
    long = facts.select("phase", "block", "config", F.explode(F.array(F.struct(F.lit("plain").alias("measure"), "metric"), F.struct(F.lit("weighed").alias("measure"), weighed.alias("metric")))).alias("m")).select("phase", "block", "config", "m.*")
    grouped = long.withColumn("group", F.concat_ws(" ", "phase", "measure"))
    return bs.rank_in_blocks(bs.complete_blocks(grouped, "group", "block", "metric", TREATMENTS), ["group", "block"], "metric")


def gated_posthoc(spark, d):
    """All pairs of configurations of the groups whose omnibus test is significant; the others have no rows."""
    return rounded(bs.gated_posthoc(measures(spark, d), "group", "block", "config"), 6, "q", "p")


def rank_bars(spark, d):
    """The bars of a critical-difference diagram, of the groups whose omnibus test is significant."""
    return rounded(bs.rank_bars(measures(spark, d), "group", "block", "config"), 6, "best", "worst")


QUERIES = {
    "friedman_stats": friedman_stats,
    "descriptive_by_config": lambda s, d: bs.describe(experiments(s, d), ["loss", "optimizer"], "metric"),
    "baseline_summary": lambda s, d: bs.describe_columns(experiments(s, d), ["control", "start"]),
    "rows_per_config": lambda s, d: bs.count_by(experiments(s, d), "config"),
    "assumption_gate": assumption_gate,
    "wide_blocks": wide_blocks,
    "mean_ranks": lambda s, d: rounded(bs.mean_ranks(ranked(s, d), "phase", "config"), 6, "mean_rank"),
    "nemenyi_q": lambda s, d: rounded(bs.nemenyi(bs.mean_ranks(ranked(s, d), "phase", "config"), "phase", "config"), 6, "difference", "q"),
    "paired_differences": lambda s, d: rounded(bs.paired_summary(differences(s, d), ["phase", "config"]), 4, "skew", "median"),
    "sign_counts": lambda s, d: bs.paired_summary(differences(s, d).filter("d <> 0"), ["phase", "config"]).select("phase", "config", "n", "plus", "minus"),
    "no_improvement_rates": lambda s, d: rounded(bs.no_improvement(differences(s, d), ["phase", "config"]), 6, "pct_worse", "pct_same", "pct_no_better").orderBy(F.desc("pct_no_better")),
    "median_cost": lambda s, d: experiments(s, d).groupBy("phase", "config").agg(F.median("cost").alias("median_cost")),
    "holm_adjust": holm_adjust,
    "relevance_label": relevance_label,
    "symmetry_histogram": lambda s, d: bs.histogram(differences(s, d), ["phase", "config"]),
    "grid_tasks": grid_tasks,
    "upsert_by_config": upsert_by_config,
    "friedman_p": friedman_p,
    "nemenyi_p": nemenyi_p,
    "sign_p": sign_p,
    "bootstrap_ci": bootstrap_ci,
    "gated_posthoc": gated_posthoc,
    "rank_bars": rank_bars,
}

#: Where the normal density is summed, and P(standard normal < z) by its series of positive terms.
NODES = "(SELECT i * 0.1::DOUBLE - 9 AS z FROM (SELECT unnest(range(181)) AS i))"


def normal_sql(z: str) -> str:
    x = f"greatest(-9.0, least(9.0, {z}))"
    return f"(0.5 + sign({x}) * exp(-pow({x}, 2) / 2) / sqrt(2 * pi()) * coalesce(list_sum([exp((2 * i + 1) * ln(abs({x})) - (i + 1) * ln(2.0::DOUBLE) - lgamma(i + 1.5) + 0.5 * ln(pi())) FOR i IN range(0, 160) IF {x} <> 0]), 0))"


def range_sql(pairs: str) -> str:
    """(group key, config, other, q, k) with p: the tail of the range of k normals, by summing over nodes."""
    return f"""(SELECT {pairs}.*, greatest(0, least(1, 1 - s)) AS p FROM {pairs} JOIN (
  SELECT q AS qq, k AS kk, sum(kk * 0.1 * exp(-z * z / 2) / sqrt(2 * pi()) * pow(below - {normal_sql("z - qq")}, kk - 1)) AS s
  FROM (SELECT DISTINCT q AS qq, k AS kk, q, k FROM {pairs}), (SELECT z, {normal_sql("z")} AS below FROM {NODES}) GROUP BY ALL) ON q = qq AND k = kk)"""


#: Even degrees of freedom of numerator and denominator, as those of TREATMENTS are: finite sums.
F_TAIL = """(SELECT sum(exp(lgamma(df1 / 2 + df2 / 2) - lgamma(j + 1) - lgamma(df1 / 2 + df2 / 2 - j) + j * ln(df2 / (df2 + df1 * f)) + (df1 / 2 + df2 / 2 - 1 - j) * ln(df1 * f / (df2 + df1 * f))))
  FROM (SELECT unnest(range(df2 // 2, df1 // 2 + df2 // 2)) AS j))"""
MEASURES = EXPERIMENTS + f""",
facts AS (SELECT phase || ' plain' AS grp, block, config, metric FROM exp UNION ALL SELECT phase || ' weighed', block, config, round(metric * CASE optimizer WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 1.1::DOUBLE ELSE 1.25::DOUBLE END, 6) FROM exp),
full_blocks AS (SELECT grp, block FROM facts GROUP BY ALL HAVING count(metric) = {TREATMENTS}),
rk AS (SELECT *, rank() OVER (PARTITION BY grp, block ORDER BY metric DESC) + (tied - 1) / 2.0::DOUBLE AS rank FROM (SELECT f.*, count(*) OVER (PARTITION BY f.grp, f.block, metric) AS tied FROM facts f JOIN full_blocks USING (grp, block))),
mr AS (SELECT grp, config, avg(rank) AS mean_rank, count(*) AS blocks FROM rk GROUP BY ALL),
s AS (SELECT grp, sum(total * total) AS squares, count(*) AS k FROM (SELECT grp, config, sum(rank) AS total FROM rk GROUP BY ALL) GROUP BY grp),
t AS (SELECT grp, count(DISTINCT block) AS n, sum(tied * tied - 1) AS ties FROM rk GROUP BY grp),
c AS (SELECT grp, n, k, (12.0::DOUBLE / (n * k * (k + 1)) * squares - 3.0 * n * (k + 1)) / (1 - CAST(ties AS DOUBLE) / (n * (k * k * k - k))) AS chi2 FROM s JOIN t USING (grp)),
o AS (SELECT grp, n, k, CASE WHEN n * (k - 1) - chi2 > 0 THEN (n - 1) * chi2 / (n * (k - 1) - chi2) END AS f, k - 1 AS df1, (k - 1) * (n - 1) AS df2 FROM c),
gate AS (SELECT grp, n, k FROM (SELECT *, CASE WHEN f IS NULL THEN 0 ELSE {F_TAIL} END AS p FROM o) WHERE p < 0.05 AND k > 2),
pr AS (SELECT grp, a.config, b.config AS other, a.mean_rank AS ra, b.mean_rank AS rb, k, abs(a.mean_rank - b.mean_rank) / sqrt(k * (k + 1) / (6.0::DOUBLE * n)) * sqrt(2.0::DOUBLE) AS q FROM gate JOIN mr a USING (grp) JOIN mr b USING (grp) WHERE a.config <> b.config),
pp AS {range_sql("pr")}"""

ORACLE_SQL = {
    "gated_posthoc": f'WITH {MEASURES} SELECT grp AS "group", config, other, round(q, 6) AS q, round(p, 6) AS p FROM pp WHERE config < other',
    "rank_bars": f"""WITH {MEASURES}, o2 AS (SELECT grp, config, mean_rank, row_number() OVER (PARTITION BY grp ORDER BY mean_rank, config) AS place FROM mr JOIN gate USING (grp)),
e AS (SELECT a.grp, a.place, max(CASE WHEN coalesce(p, 1) >= 0.05 THEN b.place ELSE 0 END) AS last FROM o2 a JOIN o2 b ON a.grp = b.grp AND b.place >= a.place LEFT JOIN pp ON pp.grp = a.grp AND pp.config = a.config AND pp.other = b.config GROUP BY ALL),
bars AS (SELECT * FROM (SELECT *, coalesce(lag(last) OVER (PARTITION BY grp ORDER BY place), 0) AS before FROM e) WHERE last > before AND last > place)
SELECT b.grp AS "group", f.config AS first, l.config AS last, b.last - b.place + 1 AS n, round(f.mean_rank, 6) AS best, round(l.mean_rank, 6) AS worst FROM bars b JOIN o2 f ON f.grp = b.grp AND f.place = b.place JOIN o2 l ON l.grp = b.grp AND l.place = b.last""",
    "friedman_p": f"""WITH {RANKED}, s AS (SELECT phase, sum(total * total) AS squares, count(*) AS k FROM (SELECT phase, config, sum(rank) AS total FROM ranked GROUP BY ALL) GROUP BY phase),
t AS (SELECT phase, count(DISTINCT block) AS n, sum(tied * tied - 1) AS ties FROM ranked GROUP BY phase),
c AS (SELECT phase, n, k, (12.0::DOUBLE / (n * k * (k + 1)) * squares - 3.0 * n * (k + 1)) / (1 - CAST(ties AS DOUBLE) / (n * (k * k * k - k))) AS chi2 FROM s JOIN t USING (phase)),
o AS (SELECT phase, chi2, (n - 1) * chi2 / (n * (k - 1) - chi2) AS f, k - 1 AS df1, (k - 1) * (n - 1) AS df2 FROM c)
SELECT phase, round((SELECT sum(exp(-chi2 / 2 + i * ln(chi2 / 2) - lgamma(i + 1))) FROM (SELECT unnest(range(df1 // 2)) AS i)), 9) AS p_chi2, round({F_TAIL}, 9) AS p_f FROM o""",
    "nemenyi_p": f"""WITH {RANKED}, ks AS (SELECT phase, count(*) AS k FROM means GROUP BY phase),
pr AS (SELECT phase, a.config, b.config AS other, k, abs(a.mean_rank - b.mean_rank) / sqrt(k * (k + 1) / (6.0::DOUBLE * a.blocks)) * sqrt(2.0::DOUBLE) AS q FROM means a JOIN means b USING (phase) JOIN ks USING (phase) WHERE a.config < b.config)
SELECT phase, config, other, round(q, 6) AS q, round(p, 6) AS p FROM {range_sql("pr")}""",
    "bootstrap_ci": f"""WITH {RANKED}, o AS (SELECT phase, config, d, row_number() OVER (PARTITION BY phase, config ORDER BY d) AS i, count(*) OVER (PARTITION BY phase, config) AS n FROM diffs),
h AS (SELECT *, (n + 1) // 2 AS h FROM o),
b AS (SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(t + 1) - lgamma(n - t + 1)) * pow(i / n::DOUBLE, t) * pow(1 - i / n::DOUBLE, n - t)) FROM (SELECT unnest(range(h, n + 1)) AS t)) AS below,
  exp(lgamma(n + 1) - lgamma(h + 1) - lgamma(n - h + 1)) * (pow(i / n::DOUBLE, h) - pow((i - 1) / n::DOUBLE, h)) AS lower FROM h),
own AS (SELECT *, below - coalesce(lag(below) OVER (PARTITION BY phase, config ORDER BY i), 0) - CASE WHEN n % 2 = 0 THEN lower * pow(1 - i / n::DOUBLE, n - h) ELSE 0 END AS p FROM b),
w AS (SELECT phase, config, d AS v, p FROM own UNION ALL
  SELECT x.phase, x.config, (x.d + y.d) / 2, x.lower * (pow(1 - (y.i - 1) / y.n::DOUBLE, y.n - y.h) - pow(1 - y.i / y.n::DOUBLE, y.n - y.h)) FROM b x JOIN b y ON x.phase = y.phase AND x.config = y.config AND x.i < y.i AND x.n % 2 = 0),
cum AS (SELECT phase, config, v, sum(p) OVER (PARTITION BY phase, config ORDER BY v) AS total FROM w),
ends AS (SELECT phase, config, round(min(v) FILTER (total >= 0.025 - 1e-12), 6) AS low, round(min(v) FILTER (total >= 0.975 - 1e-12), 6) AS high FROM cum GROUP BY ALL),
med AS (SELECT phase, config, round(median(d), 6) AS median FROM diffs GROUP BY ALL)
SELECT *, CASE WHEN low >= {DELTA} THEN 'relevant' WHEN high < {DELTA} THEN 'below threshold' ELSE 'undecided' END AS label FROM med JOIN ends USING (phase, config)""",
    "friedman_stats": f"""WITH {RANKED},
s AS (SELECT phase, sum(total * total) AS squares, count(*) AS k FROM (SELECT phase, config, sum(rank) AS total FROM ranked GROUP BY ALL) GROUP BY phase),
t AS (SELECT phase, count(DISTINCT block) AS n, sum(tied * tied - 1) AS ties FROM ranked GROUP BY phase),
c AS (SELECT phase, n, k, (12.0::DOUBLE / (n * k * (k + 1)) * squares - 3.0 * n * (k + 1)) / (1 - CAST(ties AS DOUBLE) / (n * (k * k * k - k))) AS chi2 FROM s JOIN t USING (phase))
SELECT phase, n, k, round(chi2, 6) AS chi2, round(chi2 / (n * (k - 1)), 6) AS w,
  CASE WHEN n * (k - 1) - chi2 <= 0 THEN 'inf'::DOUBLE ELSE round((n - 1) * chi2 / (n * (k - 1) - chi2), 6) END AS f, CAST(k - 1 AS BIGINT) AS df1, CAST((k - 1) * (n - 1) AS BIGINT) AS df2 FROM c""",
    "descriptive_by_config": f"WITH {EXPERIMENTS} SELECT loss, optimizer, count(metric) AS n, round_even(avg(metric), 3) AS mean, round_even(stddev_samp(metric), 3) AS std, round_even(median(metric), 3) AS median FROM exp GROUP BY ALL",
    "baseline_summary": f"""WITH {EXPERIMENTS}, l AS (SELECT 'control' AS baseline, control AS v FROM exp UNION ALL SELECT 'start', start FROM exp)
SELECT baseline, round_even(avg(v), 3) AS mean, round_even(stddev_samp(v), 3) AS std, round_even(median(v), 3) AS median FROM l GROUP BY ALL""",
    "rows_per_config": f"WITH {EXPERIMENTS} SELECT config, count(*) AS n FROM exp GROUP BY ALL",
    "assumption_gate": f"""WITH {EXPERIMENTS}, p AS (SELECT phase, block, config, count(*) AS times FROM exp GROUP BY ALL),
m AS (SELECT phase, max(times) AS most_repeats, count(DISTINCT config) AS treatments FROM p GROUP BY phase),
b AS (SELECT phase, block, count(metric) AS vals, count(DISTINCT metric) AS dist FROM exp GROUP BY ALL),
g AS (SELECT phase, count(*) AS blocks, CAST(sum(CASE WHEN vals < {TREATMENTS} THEN 1 ELSE 0 END) AS BIGINT) AS incomplete, round_even(avg(dist), 4) AS mean_distinct, min(dist) AS min_distinct FROM b GROUP BY phase)
SELECT *, most_repeats = 1 AND treatments = {TREATMENTS} AND incomplete = 0 AS complete FROM m JOIN g USING (phase)""",
    "wide_blocks": f"""WITH {EXPERIMENTS} SELECT block, phase, loss, max(CASE optimizer WHEN 'F' THEN metric END) AS "F", max(CASE optimizer WHEN 'O' THEN metric END) AS "O", max(CASE optimizer WHEN 'P' THEN metric END) AS "P" FROM exp GROUP BY ALL""",
    "mean_ranks": f"WITH {RANKED} SELECT phase, config, round(mean_rank, 6) AS mean_rank, blocks FROM means",
    "nemenyi_q": f"""WITH {RANKED}, k AS (SELECT phase, count(*) AS k FROM means GROUP BY phase)
SELECT phase, a.config, b.config AS other, k, a.blocks, round(abs(a.mean_rank - b.mean_rank), 6) AS difference, round(abs(a.mean_rank - b.mean_rank) / sqrt(k * (k + 1) / (6.0::DOUBLE * a.blocks)) * sqrt(2.0::DOUBLE), 6) AS q
FROM means a JOIN means b USING (phase) JOIN k USING (phase) WHERE a.config < b.config""",
    "paired_differences": f"""WITH {RANKED}, m AS (SELECT phase, config, avg(d) AS mean FROM diffs GROUP BY ALL)
SELECT phase, config, count(d) AS n, count(*) FILTER (d = 0) AS zeros, count(*) FILTER (d > 0) AS plus, count(*) FILTER (d < 0) AS minus,
  round(avg(pow(d - mean, 3)) / pow(avg(pow(d - mean, 2)), 1.5), 4) AS skew, round(median(d), 4) AS median FROM diffs JOIN m USING (phase, config) GROUP BY ALL""",
    "sign_counts": f"WITH {RANKED} SELECT phase, config, count(d) AS n, count(*) FILTER (d > 0) AS plus, count(*) FILTER (d < 0) AS minus FROM diffs WHERE d <> 0 GROUP BY ALL",
    "no_improvement_rates": f"""WITH {RANKED} SELECT phase, config, count(d) AS n, round(avg(CAST(d < 0 AS INTEGER)) * 100, 6) AS pct_worse,
  round(avg(CAST(abs(d) <= {bs.ZERO_TOLERANCE} AS INTEGER)) * 100, 6) AS pct_same, round(avg(CAST(d <= 0 AS INTEGER)) * 100, 6) AS pct_no_better FROM diffs GROUP BY ALL""",
    "median_cost": f"WITH {EXPERIMENTS} SELECT phase, config, CAST(median(cost) AS DOUBLE) AS median_cost FROM exp GROUP BY ALL",
    "holm_adjust": f"""WITH {RANKED}, t AS (SELECT phase, config, round(avg(CAST(d <= 0 AS INTEGER)) / 10, 6) AS p FROM diffs GROUP BY ALL),
r AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, phase, config) + 1) * p AS raw FROM t),
a AS (SELECT phase, config, p, least(1.0, max(raw) OVER (ORDER BY p, phase, config ROWS UNBOUNDED PRECEDING)) AS p_adj FROM r)
SELECT phase, config, p, round(p_adj, 6) AS p_adj, p_adj < 0.05 AS significant FROM a""",
    "sign_p": f"""WITH {RANKED}, c AS (SELECT phase, config, count(d) AS n, count(*) FILTER (d = 0) AS zeros, count(*) FILTER (d > 0) AS plus, count(*) FILTER (d <> 0) AS m FROM diffs GROUP BY ALL),
t AS (SELECT phase, config, n, zeros, plus, round(sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) - m * ln(2.0::DOUBLE))), 9) AS p FROM (SELECT *, unnest(range(plus, m + 1)) AS k FROM c) GROUP BY ALL),
r AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, phase, config) + 1) * p AS raw FROM t),
a AS (SELECT phase, config, n, zeros, plus, p, least(1.0, max(raw) OVER (ORDER BY p, phase, config ROWS UNBOUNDED PRECEDING)) AS p_adj FROM r)
SELECT phase, config, n, zeros, plus, p, round(p_adj, 8) AS p_adj, p_adj < 0.05 AS significant FROM a""",
    "relevance_label": f"""WITH {RANKED}, e AS (SELECT phase, config, round(quantile_cont(d, 0.25), 4) AS low, round(quantile_cont(d, 0.75), 4) AS high FROM diffs GROUP BY ALL)
SELECT *, CASE WHEN low >= {DELTA} THEN 'relevant' WHEN high < {DELTA} THEN 'below threshold' ELSE 'undecided' END AS label FROM e""",
    "symmetry_histogram": f"""WITH {RANKED}, e AS (SELECT phase, config, min(d) AS low, max(d) AS high FROM diffs GROUP BY ALL)
SELECT phase, config, CAST(least(14, floor(coalesce((d - low) / nullif(high - low, 0), 0.0) * 15)) AS INTEGER) AS bin, count(*) AS n FROM diffs JOIN e USING (phase, config) GROUP BY ALL""",
    "grid_tasks": f"""WITH {EXPERIMENTS}, m AS (SELECT DISTINCT block, phase AS moving FROM exp WHERE phase <> 'even' AND block IN (SELECT block FROM exp WHERE phase = 'even'))
SELECT block, 'even' AS fixed, moving, 'even<-' || moving AS pair, l.loss || '_' || o.optimizer AS config FROM m, (SELECT DISTINCT loss FROM exp) l, (SELECT DISTINCT optimizer FROM exp) o""",
    "upsert_by_config": f"""WITH {EXPERIMENTS} SELECT config, block, phase, metric FROM exp WHERE config NOT LIKE '1-%' UNION ALL
SELECT config, block, phase, round(metric + 1, 6) FROM exp WHERE config LIKE '1-%'""",
}
