"""Shapiro-Wilk W and p by Royston's approximation (Applied Statistics R94, 1995)."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Royston's polynomials, constant term first.
WEIGHT_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
WEIGHT_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_GAMMA = (-2.273, 0.459)
SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
SMALL_SPREAD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_SPREAD = (-0.4803, -0.082676, 0.0030302)


# Acklam's rational approximation of the normal quantile, highest power first.
TAIL = 0.02425
CENTRE_TOP = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
CENTRE_BOTTOM = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
TAIL_TOP = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_BOTTOM = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0)

_poly = np.polynomial.polynomial.polyval


def _horner(powers, x: Column) -> Column:
    """A polynomial, highest power first, as an expression."""
    return reduce(lambda sum_, c: sum_ * x + c, powers[1:], F.lit(float(powers[0])))


def inverse_normal(p: Column) -> Column:
    """The normal quantile of p between 0 and 1, to about nine digits."""
    q, near = p - 0.5, F.least(p, 1 - p)
    r = q * q
    centre = _horner(CENTRE_TOP, r) * q / _horner(CENTRE_BOTTOM, r)
    t = F.sqrt(-2 * F.log(near))
    tail = _horner(TAIL_TOP, t) / _horner(TAIL_BOTTOM, t)
    return F.when(near >= TAIL, centre).otherwise(F.when(p < 0.5, tail).otherwise(-tail))


def shapiro_w() -> Column:
    """W from n, the sums mm, mx and squares, the two least (x1, x2) and greatest (y2, y1) values and their scores m1, m2.

    The outermost weights are Royston's polynomials, the others the normal scores
    scaled so that all squares add up to one.
    """
    n, mm = F.col("n").cast("double"), F.col("mm")
    u = 1 / F.sqrt(n)
    score = [F.col("m1"), F.col("m2")]
    fixed = [_horner(c[::-1], u) + score[k] / F.sqrt(mm) for k, c in enumerate((WEIGHT_LAST, WEIGHT_NEXT))]
    span = [F.col("y1") - F.col("x1"), F.col("y2") - F.col("x2")]

    def top(ends: int) -> Column:
        spare = mm - 2 * sum(score[k] * score[k] for k in range(ends))
        left = 1 - 2 * sum(fixed[k] * fixed[k] for k in range(ends))
        middle = F.col("mx") - sum(score[k] * span[k] for k in range(ends))
        return middle / F.sqrt(spare / left) + sum(fixed[k] * span[k] for k in range(ends))

    three = span[0] * math.sqrt(0.5)
    b = F.when(n == 3, three).when(n <= 5, top(1)).otherwise(top(2))
    return F.least(F.lit(1.0), b * b / F.col("squares"))


def shapiro_z(w: Column, n: Column) -> Column:
    """The normal deviate that stands for W of twelve or more values."""
    size = F.log(n.cast("double"))
    return (F.log(F.greatest(1 - w, F.lit(1e-300))) - _horner(LARGE_MEAN[::-1], size)) / F.exp(_horner(LARGE_SPREAD[::-1], size))


def p_of_w(w: float, n: int) -> float:
    if w >= 1:
        return 1.0
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return min(1.0, max(0.0, p))
    gap = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = _poly(n, SMALL_GAMMA)
        if gap >= gamma:
            return 0.0
        at, mean, spread = -math.log(gamma - gap), _poly(n, SMALL_MEAN), _poly(n, SMALL_SPREAD)
    else:
        size = math.log(n)
        at, mean, spread = gap, _poly(size, LARGE_MEAN), _poly(size, LARGE_SPREAD)
    return 0.5 * math.erfc((at - mean) / math.exp(spread) / math.sqrt(2.0))


@pandas_udf(DoubleType())
def shapiro_p(w: pd.Series, n: pd.Series) -> pd.Series:
    """p of each W, one row per field."""
    return pd.Series([p_of_w(a, int(b)) for a, b in zip(w, n)], dtype=float)
