"""Critical values of the one-sided Grubbs test (Grubbs 1969), in plain Python."""

from __future__ import annotations

import math
from functools import lru_cache


def _upper_tail(t: float, nu: float) -> float:
    """P(T > t) for t > 0: half the regularised incomplete beta function I_x(nu/2, 1/2)."""
    x = nu / (nu + t * t)
    a, b = nu / 2.0, 0.5
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log(t * t / (nu + t * t))
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return 0.5 * math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 0.5 * (1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated by the modified Lentz method."""
    tiny = 1e-300

    def nonzero(v: float) -> float:
        return v if abs(v) > tiny else tiny

    c, d = 1.0, 1.0 / nonzero(1.0 - (a + b) * x / (a + 1.0))
    total = d
    for m in range(1, 20000):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for step in (even, odd):
            d = 1.0 / nonzero(1.0 + step * d)
            c = nonzero(1.0 + step / c)
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def _normal_quantile_upper(p: float) -> float:
    lo, hi = 0.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if 0.5 * math.erfc(mid / math.sqrt(2.0)) > p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def student_t_upper(p: float, nu: float) -> float:
    """The t with P(T > t) = p, for 0 < p < 0.5 and nu degrees of freedom."""
    if nu > 1e6:
        # Cornish-Fisher expansion around the normal quantile (Abramowitz and Stegun 26.7.5).
        z = _normal_quantile_upper(p)
        g1 = (z**3 + z) / 4.0
        g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96.0
        g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384.0
        return z + g1 / nu + g2 / nu**2 + g3 / nu**3
    lo, hi = 0.0, 1.0
    while _upper_tail(hi, nu) > p:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if mid in (lo, hi):
            break
        if _upper_tail(mid, nu) > p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


@lru_cache(maxsize=65536)
def grubbs_critical(n: int, alpha: float = 0.05) -> float:
    """Critical G of the one-sided test on n values; infinite for n <= 2, where no test exists."""
    if n <= 2:
        return math.inf
    t2 = student_t_upper(alpha / n, n - 2) ** 2
    return (n - 1) / math.sqrt(n) * math.sqrt(t2 / (n - 2 + t2))
