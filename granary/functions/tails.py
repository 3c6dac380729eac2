"""Tail probabilities as vectorised helpers, for a handful of test statistics per row."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Fixed value: the smaller group is tested exactly up to this size, where nothing is tied.
EXACT_SIZE = 8


def _lgamma(x):
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def _continued_fraction(a, b, x, steps: int = 300):
    """Lentz's evaluation of the incomplete beta fraction."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            c = 1.0 + top / c
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def incomplete_beta(a, b, x):
    """Regularised incomplete beta function, elementwise."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    swap = inside > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - inside, inside)
    front = _lgamma(p + q) - _lgamma(p) - _lgamma(q)
    front = np.exp(front + p * np.log(z) + q * np.log1p(-z))
    part = front * _continued_fraction(p, q, z) / p
    result = np.where(swap, 1.0 - part, part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, result))


def t_two_sided(t, df):
    """P(|T| >= |t|) for Student's t."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return incomplete_beta(df / 2.0, np.full_like(df, 0.5), df / (df + t * t))


@cache
def _partition_sums(parts: int) -> list[list[int]]:
    """For each remainder by the common period: counts of partitions of 0..k into parts
    1 to `parts`, at enough values k of that remainder to fix a polynomial.

    Within one remainder by lcm(1..parts) the count of partitions of at most k is a
    polynomial in k of degree `parts`.
    """
    period = math.lcm(*range(1, parts + 1))
    ways = [1] + [0] * (period * (parts + 1) - 1)
    for part in [1, *range(1, parts + 1)]:  # the extra 1 sums up to k
        for k in range(part, len(ways)):
            ways[k] += ways[k - part]
    return [ways[r::period] for r in range(period)]


def _partitions_up_to(k: int, parts: int) -> int:
    """Partitions of the numbers 0..k into parts 1 to `parts`, exactly, for any k."""
    if k < 0:
        return 0
    table = _partition_sums(parts)
    x, remainder = divmod(k, len(table))
    value, binomial, differences = 0, 1, table[remainder]
    for i in range(parts + 1):  # Newton's forward differences
        value += differences[0] * binomial
        binomial = binomial * (x - i) // (i + 1)
        differences = [b - a for a, b in zip(differences, differences[1:])]
    return value


def rank_sum_tail_exact(u: int, small: int, large: int) -> float:
    """P(U <= u) without ties, for a small group and another of any size.

    Arrangements with U = k are partitions of k into at most `small` parts of at most
    `large`: the coefficients of the Gaussian binomial. Its numerator has 2^small
    terms, its denominator counts plain partitions, for which a closed form is
    evaluated in whole numbers, so the work does not depend on the size of either.
    """
    total = 0
    shifts = {0: 1}
    for i in range(1, small + 1):
        for s, sign in list(shifts.items()):
            shifts[s + large + i] = shifts.get(s + large + i, 0) - sign
    for shift, sign in shifts.items():
        total += sign * _partitions_up_to(u - shift, small)
    return float(Fraction(total, math.comb(small + large, small)))


def exact_rank_sum(u: float, n_a: int, n_b: int) -> float:
    """Two-sided p of U without ties, the smaller group of at most EXACT_SIZE."""
    small, large = sorted((n_a, n_b))
    if small > EXACT_SIZE:
        raise ValueError(f"the exact test needs a group of at most {EXACT_SIZE} values")
    lower = math.floor(min(u, n_a * n_b - u))
    return min(1.0, 2.0 * rank_sum_tail_exact(lower, small, large))


def is_exact(n_a: int, n_b: int, tie_term: float) -> bool:
    """The rule: exact where nothing is tied and the smaller group is small, else normal."""
    return tie_term == 0 and min(n_a, n_b) <= EXACT_SIZE


def rank_sum_p(u: float, n_a: int, n_b: int, tie_term: float) -> float:
    """Two-sided Mann-Whitney p, exact by `is_exact`, else normal with continuity correction."""
    if is_exact(n_a, n_b, tie_term):
        return exact_rank_sum(u, n_a, n_b)
    n = n_a + n_b
    spread = math.sqrt(n_a * n_b / 12.0 * ((n + 1) - tie_term / (n * (n - 1.0))))
    if spread == 0:
        return 1.0
    z = (max(u, n_a * n_b - u) - n_a * n_b / 2.0 - 0.5) / spread
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


def _where_known(function, *columns: pd.Series) -> pd.Series:
    known = np.logical_and.reduce([c.notna().to_numpy() for c in columns])
    out = np.full(len(columns[0]), np.nan)
    if known.any():
        out[known] = function(*[c.to_numpy(dtype=float)[known] for c in columns])
    return pd.Series(out).where(known, None).astype("Float64")


@pandas_udf(DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return _where_known(t_two_sided, t, df)


@pandas_udf(DoubleType())
def rank_sum_tail(u: pd.Series, n_a: pd.Series, n_b: pd.Series, ties: pd.Series) -> pd.Series:
    rows = zip(u, n_a, n_b, ties)
    return pd.Series([None if pd.isna(r[0]) else rank_sum_p(r[0], int(r[1]), int(r[2]), r[3]) for r in rows])
