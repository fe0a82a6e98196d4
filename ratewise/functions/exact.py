"""Exact half-away-from-zero rounding of integer ratios.

Shares and rates in this library are ratios of integer counts or sums.  Doing
``round(100.0 * n / total, 1)`` in floating point makes the last digit depend
on the engine (decimal scale rules, binary ties).  Instead the rounded value is
computed with integer arithmetic only:

    round(a / b, s) = sign(a) * ((2 * 10^s * |a| + b) div (2 * b)) / 10^s

for b > 0.  The integer part runs in decimal(38,0) so that products of counts at
very large scale do not overflow 64 bits; the final division by 10^s is one
correctly rounded IEEE division, identical in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(38,0)"


def _int_div(a: Column, b: Column) -> Column:
    # floor(a / b) for a >= 0, b > 0, exact: the remainder is removed first so
    # the decimal division has an integral result and loses nothing.
    return ((a - a % b) / b).cast("bigint")


def ratio_half_up(num: Column, den: Column, scale: int) -> Column:
    """round(num / den, scale) half away from zero; NULL when den <= 0 or NULL.

    ``num`` and ``den`` must be integral (counts, sums of integer measures,
    or integral products of them).
    """
    a = num.cast(DEC)
    b = den.cast(DEC)
    p = F.lit(2 * 10 ** scale).cast(DEC)
    q = _int_div(p * F.abs(a) + b, F.lit(2).cast(DEC) * b)
    signed = F.when(a < 0, -q).otherwise(q)
    return F.when(b > 0, signed.cast("double") / F.lit(float(10 ** scale)))


def percent_half_up(part: Column, total: Column, scale: int = 1) -> Column:
    """round(100 * part / total, scale)."""
    return ratio_half_up(F.lit(100).cast(DEC) * part.cast(DEC), total, scale)


def round_double_half_up(x: Column, scale: int) -> Column:
    """Half-away-from-zero rounding of a double (used for correlations only)."""
    p = float(10 ** scale)
    return F.signum(x) * F.floor(F.abs(x) * F.lit(p) + F.lit(0.5)) / F.lit(p)


def pearson_of_counts(x: Column, y: Column) -> Column:
    """Pearson r of two integer series as an aggregate; NULL when either is constant.

    Spark's ``corr`` fails under ANSI mode when a variance is zero; SQL
    engines return NULL there.  With integer inputs the centred sums are
    exact in decimal(38,0):

        r = (nΣxy − ΣxΣy) / sqrt((nΣx² − (Σx)²) (nΣy² − (Σy)²))
    """
    n = F.count(x).cast(DEC)
    xd, yd = x.cast(DEC), y.cast(DEC)
    sx, sy = F.sum(xd), F.sum(yd)
    sxy, sxx, syy = F.sum(xd * yd), F.sum(xd * xd), F.sum(yd * yd)
    cxy = n * sxy - sx * sy
    cxx = n * sxx - sx * sx
    cyy = n * syy - sy * sy
    return F.when((cxx > 0) & (cyy > 0),
                  cxy.cast("double") / F.sqrt(cxx.cast("double") * cyy.cast("double")))
