"""Exponential smoothing with trend, its weights searched for many series at once.

Series are aligned at their last day, so one pass over the days updates every
series under every choice of weights together. The best point of a fixed grid is
where a search along the axes begins: in each round every series tries a step up
and down in each weight, moves to the best of these if it is better, and halves
its steps if none is. The squared error is so never above the grid's.

Most days of a product that sells seldom are zeros. Over a run of them an additive
state without seasonal terms changes by powers of one matrix, and the squared error
is a quadratic form of the state before, so the search over weights takes such a run
in a few steps, however long it is.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from granary.functions.seasonal import SPARSE_DAYS, dense_rows

# The parameter grid, the shortest series, the size of one block.
LEVEL_GRID = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
TREND_GRID = (0.0, 0.01, 0.05, 0.1, 0.3)
SEASON_GRID = (0.0, 0.05, 0.15, 0.3)
MIN_LENGTH = 10
BLOCK_CELLS = 2_000_000
# The base in which the length of a run of zeros is written, for weights that all series
# share and for their own, and series with such runs per block.
SHARED_BASE, OWN_BASE, SPARSE_SERIES = 256, 32, 2_500
# Weights that give the slope of a line through the first days.
HEAD_SLOPE = (np.arange(MIN_LENGTH) - (MIN_LENGTH - 1) / 2) * 12 / (MIN_LENGTH * (MIN_LENGTH**2 - 1))
# Rounds of the search, its first steps, and how close a weight may come to 0 and 1.
ROUNDS = 4
STEPS = (0.08, 0.04, 0.05)
BOUNDS = ((0.001, 0.999), (0.0, 0.999), (0.0, 0.999))


def _grid(seasonal: bool) -> np.ndarray:
    axes = (LEVEL_GRID, TREND_GRID, SEASON_GRID if seasonal else (0.0,))
    return np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")])


def _start(y: np.ndarray, period: int | None, multiplicative: bool):
    """Level before the first day, trend, and one cycle of seasonal terms."""
    z = np.log(y) if multiplicative else y
    if period:
        first, second = z[:period].mean(), z[period : 2 * period].mean()
        slope = (second - first) / period
        level = first - slope * (period + 1) / 2
        days = np.arange(1, 2 * period + 1)
        season = (z[: 2 * period] - level - slope * days).reshape(2, period).mean(axis=0)
    else:
        head = z[:MIN_LENGTH]
        slope = HEAD_SLOPE @ head
        level = np.add.reduce(head) / MIN_LENGTH - slope * (MIN_LENGTH + 1) / 2
        season = np.zeros(1)
    if multiplicative:
        return np.exp(level), np.exp(slope), np.exp(season)
    return level, slope, season


class _Block:
    """Series of one period, ends together, run through the days under given weights."""

    def __init__(self, rows: list[np.ndarray], period: int | None, multiplicative: bool):
        self.period, self.multiplicative = period, multiplicative
        self.width, self.count = max(len(y) for y in rows), len(rows)
        self.first = np.array([self.width - len(y) for y in rows])
        self.data = np.full((self.width, self.count), 1.0 if multiplicative else 0.0)
        cycle = period or 1
        self.level, self.trend = np.empty((2, self.count, 1))
        self.season = np.empty((cycle, self.count, 1))
        for k, y in enumerate(rows):
            self.data[self.first[k] :, k] = y
            self.level[k], self.trend[k], terms = _start(y, period, multiplicative)
            self.season[(self.first[k] + np.arange(cycle)) % cycle, k, 0] = terms

    def run(self, weights: np.ndarray, absolute: bool = False):
        """Error of every choice, and the state after the last day; weights: (3, series or 1, choices).

        The error is the sum of squares, or of absolute values. A series joins on its
        first day; what is worked out in its row before is overwritten then.
        """
        cells = (self.count, weights.shape[2])
        alpha, beta, gamma = (np.broadcast_to(w, cells) for w in weights)
        by_trend = alpha * beta
        level, trend = np.empty(cells), np.empty(cells)
        level[:], trend[:] = (1.0, 1.0) if self.multiplicative else (0.0, 0.0)
        season = np.broadcast_to(self.season, (len(self.season), *cells)).copy()
        total, error, part = np.zeros(cells), np.empty(cells), np.empty(cells)
        begins = {int(d): np.flatnonzero(self.first == d) for d in np.unique(self.first)}
        for day in range(self.width):
            if (rows := begins.get(day)) is not None:
                level[rows], trend[rows], total[rows] = self.level[rows], self.trend[rows], 0.0
                season[:, rows] = self.season[:, rows]
            y, s = self.data[day][:, None], season[day % len(season)]
            if self.multiplicative:
                expected = np.multiply(level, trend, out=part)
                np.subtract(y, expected * s, out=error)
                new_level = alpha * (y / s - expected) + expected
                trend += beta * (new_level / level - trend)
                if self.period:
                    s += gamma * (y / expected - s)
                level = new_level
            else:
                np.add(level, trend, out=level)
                np.subtract(y, level, out=error)
                error -= s
                level += np.multiply(alpha, error, out=part)
                trend += np.multiply(by_trend, error, out=part)
                if self.period:
                    s += np.multiply(gamma, error, out=part)
            total += np.abs(error, out=part) if absolute else np.multiply(error, error, out=part)
        return np.where(np.isfinite(total), total, np.inf), level, trend, season

    def squares(self, weights: np.ndarray) -> np.ndarray:
        """Sum of squared errors of every choice."""
        return self.run(weights)[0]

    def fit(self, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """Weights (3, series) of least squared error found, and that error."""
        grid = _grid(self.period is not None)
        squared = self.squares(grid[:, None, :])
        choice, at = squared.argmin(axis=1), np.arange(self.count)
        weights, best = grid[:, choice], squared[at, choice]
        axes = range(3 if self.period else 2)
        steps = np.array(STEPS)[:, None] * np.ones(self.count)
        low, high = np.array(BOUNDS).T[:, :, None]
        for _ in range(rounds):
            tried = np.repeat(weights[:, :, None], 2 * len(axes), axis=2)
            for j, axis in enumerate(axes):
                tried[axis, :, 2 * j] += steps[axis]
                tried[axis, :, 2 * j + 1] -= steps[axis]
            tried = np.clip(tried, low[:, :, None], high[:, :, None])
            squared = self.squares(tried)
            choice = squared.argmin(axis=1)
            better = squared[at, choice] < best
            weights = np.where(better, tried[:, at, choice], weights)
            best = np.where(better, squared[at, choice], best)
            steps = np.where(better, steps, steps / 2)
        return weights, best


def _zero_runs(alpha: np.ndarray, beta: np.ndarray, base: int, longest: int) -> list[tuple]:
    """Runs of zeros of 0, 1, ... times 1, base, base^2, ... days, under all weights given.

    A run takes (level, trend) to (a level + b trend, c level + d trend) and adds
    p level^2 + q level trend + r trend^2 to the squared error; for each power of the base
    a, b, c, d, p, q and r by the number of times, then by row of weights.
    """
    one, zero = np.ones(alpha.shape), np.zeros(alpha.shape)
    step = (1 - alpha, 1 - alpha, -alpha * beta, 1 - alpha * beta, one, 2 * one, one)
    tables = []
    while longest or not tables:
        runs = [(one, zero, zero, one, zero, zero, zero)]
        for _ in range(base):
            a, b, c, d, p, q, r = runs[-1]
            sa, sb, sc, sd, sp, sq, sr = step
            runs.append((
                sa * a + sb * c, sa * b + sb * d, sc * a + sd * c, sc * b + sd * d,
                p + sp * a * a + sq * a * c + sr * c * c,
                q + 2 * sp * a * b + sq * (a * d + b * c) + 2 * sr * c * d,
                r + sp * b * b + sq * b * d + sr * d * d,
            ))
        step = runs.pop()
        tables.append(tuple(np.concatenate(t) for t in zip(*runs)))
        longest //= base
    return tables


class _SparseBlock(_Block):
    """Additive series without a period, most of whose days are zeros.

    The search goes from one day with data to the next; series are aligned at their
    last such day, and a last run of zeros follows.
    """

    def __init__(self, rows: list[np.ndarray]):
        super().__init__(rows, None, False)
        days = [np.flatnonzero(y) for y in rows]
        self.steps = max(map(len, days))
        self.joins = np.array([self.steps - len(d) for d in days])
        self.gaps = np.zeros((self.steps + 1, self.count), int)
        self.amounts = np.zeros((self.steps, self.count))
        for k, (y, d) in enumerate(zip(rows, days)):
            ends = np.array([-1, *d, len(y)])
            self.gaps[self.joins[k] :, k] = ends[1:] - ends[:-1] - 1
            self.amounts[self.joins[k] :, k] = y[d]

    def squares(self, weights: np.ndarray) -> np.ndarray:
        alpha, beta = weights[0], weights[1]
        by_trend = alpha * beta
        own = len(alpha) > 1
        base = OWN_BASE if own else SHARED_BASE
        tables = _zero_runs(alpha, beta, base, int(self.gaps.max()))
        level, trend, total = np.zeros((3, self.count, weights.shape[2]))
        begins = {int(j): np.flatnonzero(self.joins == j) for j in np.unique(self.joins)}
        for at in range(self.steps + 1):
            if (rows := begins.get(at)) is not None:
                level[rows], trend[rows], total[rows] = self.level[rows], self.trend[rows], 0.0
            left = self.gaps[at]
            for table in tables:
                left, times = np.divmod(left, base)
                rows = np.flatnonzero(times)
                if not len(rows):
                    continue
                if 2 * len(rows) > self.count:  # no zeros at all change nothing
                    rows = slice(None)
                times = times[rows]
                place = times * self.count + np.arange(self.count)[rows] if own else times
                a, b, c, d, p, q, r = (t.take(place, axis=0) for t in table)
                old, slope = level[rows], trend[rows]
                total[rows] += (p * old + q * slope) * old + r * slope * slope
                level[rows], trend[rows] = a * old + b * slope, c * old + d * slope
            if at < self.steps:
                level += trend
                error = self.amounts[at][:, None] - level
                level += alpha * error
                trend += by_trend * error
                total += error * error
        return np.where(np.isfinite(total), total, np.inf)


def _is_sparse(y: np.ndarray) -> bool:
    return np.count_nonzero(y) * SPARSE_DAYS < len(y)


def _fit_block(block: _Block, horizon: int):
    """In-sample mean absolute error and forecast under the best weights per series."""
    with np.errstate(all="ignore"):
        weights, _ = block.fit()
        absolute, level, trend, season = block.run(weights[:, :, None], absolute=True)
        terms = season[(block.width + np.arange(horizon)) % len(season), :, 0].T
        ahead = np.arange(1, horizon + 1)
        if block.multiplicative:
            forecast = level * trend**ahead * terms
        else:
            forecast = level + trend * ahead + terms
        return absolute[:, 0] / (block.width - block.first), forecast


def smooth(series: list, periods: list, horizon: int) -> list:
    """Forecast per series; None where it is missing or too short.

    Additive and, for all-positive series, multiplicative forms are fitted; the
    lower in-sample error wins.
    """
    out: list = [None] * len(series)
    groups: dict = {}
    for i, (y, p) in enumerate(zip(series, periods)):
        if y is None:
            continue
        p = None if p is None or p != p else int(p)
        y = np.asarray(y, dtype=float)
        if len(y) >= (2 * p if p else MIN_LENGTH):
            groups.setdefault((p, p is None and _is_sparse(y)), []).append((i, y))
    for (p, sparse), members in groups.items():
        step = SPARSE_SERIES if sparse else max(1, BLOCK_CELLS // (_grid(p is not None).shape[1] * (p or 1)))
        members.sort(key=lambda m: np.count_nonzero(m[1]) if sparse else len(m[1]))
        for at in range(0, len(members), step):
            block = members[at : at + step]
            rows = [y for _, y in block]
            error, forecast = _fit_block(_SparseBlock(rows) if sparse else _Block(rows, p, False), horizon)
            positive = [k for k, y in enumerate(rows) if (y > 0).all()]
            if positive:
                other, values = _fit_block(_Block([rows[k] for k in positive], p, True), horizon)
                for k, e, f in zip(positive, other, values):
                    if np.isfinite(f).all() and e < error[k]:
                        forecast[k] = f
            for (i, _), f in zip(block, forecast):
                out[i] = f if np.isfinite(f).all() else None
    return out


#: Series of a batch that are spread out to one number per day at a time.
DENSE_SERIES = 2_500


@pandas_udf(ArrayType(DoubleType()))
def ets(offsets: pd.Series, amounts: pd.Series, days: pd.Series, period: pd.Series, horizon: pd.Series) -> pd.Series:
    """Forecast from the first `days` days; null where there are none, or too few."""
    ahead = int(horizon.max()) if len(horizon) else 0
    return forecast_batch(smooth, offsets, amounts, days, [None if pd.isna(p) else int(p) for p in period], ahead)


def forecast_batch(model, offsets: pd.Series, amounts: pd.Series, days: pd.Series, periods: list, ahead: int) -> pd.Series:
    """What `model` makes of a batch's series, so many at a time."""
    out: list = []
    rows = dense_rows(offsets, amounts, days)
    while part := list(islice(rows, DENSE_SERIES)):
        out += model(part, periods[len(out) : len(out) + len(part)], ahead)
    return pd.Series(out, dtype=object)


# Keeps the optimizer from copying the call into filters it derives.
ets = ets.asNondeterministic()
