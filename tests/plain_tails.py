"""Tail probabilities in plain Python, by published series and quadrature, to compare those in columns with."""

from __future__ import annotations

import math

import numpy as np


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f); 0 for an infinite statistic."""
    return 0.0 if math.isinf(f) else incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def chi2_tail(x: float, df: float) -> float:
    """P(chi-square > x), by the series below the mean and by the continued fraction above."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1.0 - front * total
    b, c = x + 1 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d = 1.0 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def sign_tail(plus: int, n: int) -> float:
    """P(at least ``plus`` heads in n fair throws), exactly."""
    return sum(math.comb(n, i) for i in range(plus, n + 1)) / 2**n if n else 1.0


def range_tail(q: float, k: int) -> float:
    """P(range of k standard normals > q): the studentised range with infinitely many degrees of freedom."""
    z = np.linspace(-9.0, 9.0, 6001)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    below = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    under = np.interp(z - q, z, below, left=0.0)
    inner = k * density * np.clip(below - under, 0, 1) ** (k - 1)
    return float(min(1.0, max(0.0, 1.0 - np.sum((inner[1:] + inner[:-1]) / 2) * (z[1] - z[0]))))
