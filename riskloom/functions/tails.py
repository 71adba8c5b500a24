"""Upper tails of the chi-square and F distributions."""

from __future__ import annotations

import math

TINY = 1e-300
STEPS = 10_000


def _fraction(step, start: float) -> float:
    """A continued fraction by Lentz's method; step(i) gives its i-th (numerator, denominator)."""
    f = start or TINY
    c, d = f, 0.0
    for i in range(1, STEPS):
        a, b = step(i)
        d = b + a * d or TINY
        c = b + a / c or TINY
        d = 1 / d
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return f


def chi2_tail(x: float, freedom: float) -> float:
    """P(X > x) for X of that many degrees of freedom: the regularised upper incomplete gamma function."""
    a, x = freedom / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        i = 1
        while abs(term) > 1e-17 * abs(total):
            term *= x / (a + i)
            total += term
            i += 1
        return max(0.0, 1 - scale * total)
    return scale / _fraction(lambda i: (-i * (i - a), x + 2 * i + 1 - a), x + 1 - a)


def _beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)

    def step(i: int) -> tuple[float, float]:
        m = i // 2
        if i % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    return front / _fraction(step, 1.0)


def f_tail(f: float, between: float, within: float) -> float:
    """P(F > f) for these degrees of freedom."""
    return _beta(within / (within + between * f), within / 2, between / 2) if f > 0 else 1.0
