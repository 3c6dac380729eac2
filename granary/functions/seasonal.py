"""Strength of an additive seasonal pattern in a daily series."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

# Tested periods in days, cycles needed, and the limit for "seasonal".
PERIODS = {"weekly": 7, "monthly": 30, "yearly": 365}
MIN_CYCLES = 6
STRENGTH_LIMIT = 0.3
#: Days per day with data from which on a series is read by its days with data.
SPARSE_DAYS = 6


def dense(offsets: np.ndarray, amounts: np.ndarray, days: int) -> np.ndarray:
    """The first `days` days of a series given by its days with data, zeros between."""
    x = np.zeros(days)
    kept = np.searchsorted(offsets, days)
    x[offsets[:kept]] = amounts[:kept]
    return x


def dense_rows(offsets: pd.Series, amounts: pd.Series, days: pd.Series) -> Iterator[np.ndarray | None]:
    """`dense` row by row, made as it is asked for; None without a number of days."""
    for at, of, n in zip(offsets, amounts, days):
        yield None if pd.isna(n) else dense(at, of, int(n))


def centred_average(x: np.ndarray, period: int, running: np.ndarray | None = None) -> np.ndarray:
    """Mean over one period around each day, days at both ends left out.

    An even period takes its two outermost days at half weight. `running` are the running
    sums from zero on, if they are known.
    """
    if running is None:
        running = running_sums(x)
    if period % 2:
        return (running[period:] - running[:-period]) / period
    inner = running[period:-1] - running[1:-period]
    return (inner + 0.5 * (x[: len(inner)] + x[period:])) / period


def running_sums(x: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(x)
    if len(at) * SPARSE_DAYS < len(x):
        ends = np.concatenate(([0], at + 1, [len(x) + 1]))
        return np.repeat(np.concatenate(([0.0], np.cumsum(x[at]))), ends[1:] - ends[:-1])
    out = np.zeros(len(x) + 1)
    np.cumsum(x, out=out[1:])
    return out


@lru_cache(maxsize=16)
def _phases(period: int, cycles: int) -> np.ndarray:
    return np.tile(np.arange(period), cycles)


@lru_cache(maxsize=4096)
def _phase_counts(period: int, first: int, days: int) -> np.ndarray:
    return np.bincount((first + np.arange(days)) % period, minlength=period)


def _variance(x: np.ndarray) -> float:
    gaps = x - np.add.reduce(x) / len(x)
    return gaps @ gaps / (len(x) - 1)


def _cycle_variance(cycle: np.ndarray, days: int) -> float:
    """Variance of a cycle repeated over so many days."""
    whole, rest = divmod(days, len(cycle))
    gaps = cycle - (whole * np.add.reduce(cycle) + np.add.reduce(cycle[:rest])) / days
    return (whole * (gaps @ gaps) + gaps[:rest] @ gaps[:rest]) / (days - 1)


def seasonal_strength(x: np.ndarray, period: int, running: np.ndarray | None = None) -> float | None:
    """Share of the seasonal part in the variance left after the trend."""
    n = len(x)
    if n < period * MIN_CYCLES:
        return None
    trend = centred_average(x, period, running)
    edge = period // 2
    rest = x[edge : edge + len(trend)] - trend
    # A power of two cycles, so that series of many lengths share a few tables.
    phase = _phases(period, 1 << (n // period).bit_length())[edge : edge + len(rest)]
    means = np.bincount(phase, rest, period) / _phase_counts(period, edge, len(rest))
    means -= np.add.reduce(means) / period
    seasonal = _cycle_variance(means, n)
    total = seasonal + _variance(rest - means.take(phase))
    return float(seasonal / total) if total > 0 else 0.0


def all_strengths(x: np.ndarray) -> list[float | None]:
    running = running_sums(x)
    return [seasonal_strength(x, p, running) for p in PERIODS.values()]


@pandas_udf(ArrayType(DoubleType()))
def strengths(offsets: pd.Series, amounts: pd.Series, days: pd.Series) -> pd.Series:
    """Strength of each tested period, null where the series is too short."""
    return pd.Series([all_strengths(x) for x in dense_rows(offsets, amounts, days)], dtype=object)


# Keeps the optimizer from copying the call into filters it derives.
strengths = strengths.asNondeterministic()
