"""Closed-form statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Erf approximation 7.1.26 of Abramowitz and Stegun (1964).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

Z_975 = 1.959963984540054


def two_sided_p(z: Column) -> Column:
    """2 * (1 - Phi(|z|)) with a polynomial in place of erf (absolute error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = F.lit(1.0) / (1.0 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return poly * F.exp(-x * x)


# 97.5 % points of Student's t for 1 to 4 degrees of freedom, where the expansion below is too small.
T_975 = (12.706204736432095, 4.302652729911275, 3.182446305284263, 2.7764451051977987)


def t_975(df: Column) -> Column:
    """97.5 % point of Student's t: exact for 1 to 4 degrees of freedom, then by the expansion around the normal quantile."""
    z = Z_975
    terms = (
        (z**3 + z) / 4.0,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96.0,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384.0,
    )
    out = F.lit(z)
    for power, term in enumerate(terms, start=1):
        out = out + F.try_divide(F.lit(term), F.pow(df, F.lit(float(power))))
    for exact, value in enumerate(T_975, start=1):
        out = F.when(df == exact, F.lit(value)).otherwise(out)
    return out


def ratio(a: Column, b: Column) -> Column:
    """Division in doubles that is null where the divisor is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def weighted_mean(x: Column, w: Column) -> Column:
    """Sum(x*w)/Sum(w) over rows with x; a missing weight on such a row makes the result null."""
    has_x = x.isNotNull()
    total = F.try_divide(F.sum(F.when(has_x, x.cast("double") * w)), F.sum(F.when(has_x, w)))
    return F.when(F.coalesce(F.bool_or(has_x & w.isNull()), F.lit(False)), F.lit(None).cast("double")).otherwise(total)


def standard_error(x: Column) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.count(x))
