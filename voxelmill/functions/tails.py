"""Tail probabilities of test statistics as column expressions, by published series, continued fractions and quadrature."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Series and continued fractions take so many steps, and so many times the root of their largest parameter.
STEPS, STEPS_BY_ROOT = 60, 8
#: Nodes of the quadrature over the normal density lie this far apart, up to so many widths.
NODE_STEP, NODE_END = 0.05, 9.0
TINY = 1e-300

# West's rational approximation of the normal distribution (2005), highest power first.
UPPER = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
LOWER = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def polynomial(x: Column, factors: tuple[float, ...]) -> Column:
    out = F.lit(factors[0])
    for factor in factors[1:]:
        out = out * x + factor
    return out


def normal_below(z: Column) -> Column:
    """P(standard normal < z), to about 15 digits."""
    x = F.abs(z)
    bell = F.exp(-x * x / 2)
    far = x + 0.65
    for k in (4, 3, 2, 1):
        far = x + k / far
    above = F.when(x < 7.07106781186547, bell * polynomial(x, UPPER) / polynomial(x, LOWER)).otherwise(bell / far / math.sqrt(2 * math.pi))
    return F.when(z > 0, 1 - above).otherwise(above)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series eight further on, less the factors in between."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    between = x
    for k in range(1, 8):
        between = between * (x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(between)


def steps(largest: Column) -> Column:
    """The numbers of the steps to take, as doubles."""
    return F.transform(F.sequence(F.lit(1), STEPS + F.ceil(STEPS_BY_ROOT * F.sqrt(largest)).cast("int")), lambda m: m.cast("double"))


def bounded(value: Column) -> Column:
    return F.when(F.abs(value) > TINY, value).otherwise(F.lit(TINY))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method."""

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1 = 1 / bounded(1 + even * state["d"])
        c1 = bounded(1 + even / state["c"])
        d2 = 1 / bounded(1 + odd * d1)
        c2 = bounded(1 + odd / c1)
        return F.struct(c2.alias("c"), d2.alias("d"), (state["value"] * c1 * d1 * c2 * d2).alias("value"))

    first = 1 / bounded(1 - (a + b) * x / (a + 1))
    return F.aggregate(steps(F.greatest(a, b)), F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("value")), step, lambda s: s["value"])


def beta_below(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b)."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    direct = front / a * _beta_fraction(a, b, x)
    turned = 1 - front / b * _beta_fraction(b, a, 1 - x)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x <= (a + 1) / (a + b + 2), direct).otherwise(turned)


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f); 0 for an infinite statistic."""
    return F.when(f == float("inf"), 0.0).otherwise(beta_below(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)))


def chi2_tail(x: Column, df: Column) -> Column:
    """P(chi-square > x): one minus its series below the mean, its continued fraction above."""
    a, h = df.cast("double") / 2, x / 2
    front = F.exp(-h + a * F.log(h) - log_gamma(a))
    terms = steps(F.greatest(a, F.lit(1.0)))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] * h / (a + i)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    series = F.aggregate(terms, F.struct((1 / a).alias("term"), (1 / a).alias("total")), add, lambda s: s["total"])

    def step(state: Column, i: Column) -> Column:
        factor, b = -i * (i - a), h + 1 - a + 2 * i
        d, c = 1 / bounded(factor * state["d"] + b), bounded(b + factor / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["value"] * c * d).alias("value"))

    first = 1 / bounded(h + 1 - a)
    fraction = F.aggregate(terms, F.struct(F.lit(1 / TINY).alias("c"), first.alias("d"), first.alias("value")), step, lambda s: s["value"])
    return F.when(x <= 0, 1.0).when(h < a + 1, 1 - front * series).otherwise(front * fraction)


def sign_tail(plus: Column, n: Column) -> Column:
    """P(at least ``plus`` heads in n fair throws)."""
    k, m = plus.cast("double"), n.cast("double")
    return F.when(k <= 0, 1.0).when(k > m, 0.0).otherwise(beta_below(k, m - k + 1, F.lit(0.5)))


def range_tail(q: Column, k: Column) -> Column:
    """P(range of k standard normals > q): the studentised range with infinitely many degrees of freedom."""
    last = round(NODE_END / NODE_STEP)
    nodes = F.transform(F.sequence(F.lit(-last), F.lit(last)), lambda i: i * NODE_STEP)
    inside = F.aggregate(nodes, F.lit(0.0), lambda total, z: total + F.exp(-z * z / 2) * F.pow(normal_below(z) - normal_below(z - q), k - 1))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - k * NODE_STEP / math.sqrt(2 * math.pi) * inside))
