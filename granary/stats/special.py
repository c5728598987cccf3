"""Distribution functions for p-values and sample sizes, in plain Python."""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()


def probit(p: float) -> float:
    """The standard normal quantile; infinite at 0 and 1."""
    if p <= 0 or p >= 1:
        return math.copysign(math.inf, p - 0.5)
    return _NORMAL.inv_cdf(p)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def log_gamma(x: float) -> float:
    return math.lgamma(x)


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised; by Lentz's continued fraction on the side where it converges fast."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * out


def incomplete_gamma(a: float, x: float) -> float:
    """Regularised lower: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 500):
        n = -i * (i - a)
        b += 2
        d = 1 / max(n * d + b, tiny) if abs(n * d + b) > tiny else 1 / tiny
        c = b + n / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1.0 - front * out)


def chi2_cdf(x: float, df: float) -> float:
    return incomplete_gamma(df / 2, x / 2)


def student_t_cdf(t: float, df: float) -> float:
    tail = 0.5 * incomplete_beta(df / (df + t * t), df / 2, 0.5)
    return 1 - tail if t > 0 else tail


def f_cdf(x: float, d1: float, d2: float) -> float:
    return incomplete_beta(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2) if x > 0 else 0.0


def t_two_sided_p(t: float, df: float) -> float:
    """Probability beyond |t| on both sides."""
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)
