"""Tail probabilities of a few scalars, on the driver. Row data never comes here."""

from __future__ import annotations

import math

# Fixed value: the 97.5% point of the normal distribution.
Z_95 = 1.959963984540054


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def log_chi2_tail(x: float, df: int) -> float:
    """Natural log of P(chi-square with `df` degrees of freedom > x), finite for any finite x.

    For even df the tail is exp(-x/2) times a finite sum; for odd df the same recurrence starts
    from the normal tail. Both are added in the log domain, so nothing underflows.
    """
    if df <= 0:
        raise ValueError("degrees of freedom must be positive")
    if x <= 0:
        return 0.0
    half = x / 2.0
    if df % 2 == 0:
        terms = [0.0 if j == 0 else j * math.log(half) - math.lgamma(j + 1) for j in range(df // 2)]
        return min(0.0, -half + _log_sum(terms))
    terms = [_log_erfc(math.sqrt(half))]
    for j in range(1, (df - 1) // 2 + 1):
        terms.append(-half + (j - 0.5) * math.log(half) - math.lgamma(j + 0.5))
    return min(0.0, _log_sum(terms))


def _log_erfc(y: float) -> float:
    if y < 20.0:
        return math.log(math.erfc(y))
    # asymptotic series of erfc, already below rounding error after a few terms for y >= 20
    inverse = 1.0 / (2.0 * y * y)
    series = 1.0 - inverse + 3 * inverse**2 - 15 * inverse**3 + 105 * inverse**4
    return -y * y - math.log(y * math.sqrt(math.pi)) + math.log(series)


def _log_sum(terms: list[float]) -> float:
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))
