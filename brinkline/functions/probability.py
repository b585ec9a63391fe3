"""Tail probabilities of the normal, chi-squared and F distributions."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2)) if math.isfinite(z) else math.nan


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with ``df`` degrees of freedom > x)."""
    if not math.isfinite(x) or df < 1:
        return math.nan
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    # continued fraction by Lentz
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def f_tail(x: float, d1: int, d2: int) -> float:
    """P(F with ``d1`` and ``d2`` degrees of freedom > x)."""
    if not math.isfinite(x) or d1 < 1 or d2 < 1:
        return math.nan
    return 1.0 if x <= 0 else beta_ratio(d2 / (d2 + d1 * x), d2 / 2, d1 / 2)


def beta_ratio(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_ratio(1 - x, b, a)
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a
