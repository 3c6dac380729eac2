"""Seasonal ARIMA forecasts by least squares, for all series of a batch at once.

The residuals of a long autoregression stand in for the unseen shocks (Hannan and
Rissanen 1982), so each order is a linear regression on lags of the series and of
the shocks: up to two of each, and for a seasonal series one of each at the
period. Series are aligned at their last day. Running sums of the products of a
series with itself d days earlier give all normal equations, of all series in one
table; each order is then one stacked solve on a part of them. The lowest AICc
among stationary, invertible fits wins, series by series. Products with a table most
of whose days are zeros are added up over its other days alone.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from granary.functions.seasonal import SPARSE_DAYS, seasonal_strength
from granary.functions.smoothing import forecast_batch

# Orders, the KPSS 5 % point, strength that calls for a seasonal difference.
MAX_ORDER, MAX_SEASONAL_ORDER = 2, 1
KPSS_LIMIT = 0.463
SEASONAL_DIFFERENCE = 0.64
MIN_LENGTH = 15
#: Numbers held for one block of series.
BLOCK_CELLS = 4_000_000
#: Sums at so many lags are taken from running sums.
RUNNING_LAGS = 8
#: Directions with less than this share of the largest eigenvalue carry nothing.
RANK_TOLERANCE = 1e-11


def _aligned(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All series in one table, ends together, zeros in front; and where each begins."""
    width = max(map(len, series))
    table = np.zeros((len(series), width))
    for row, x in zip(table, series):
        row[width - len(x) :] = x
    return table, np.array([width - len(x) for x in series])


def needs_difference(series: list[np.ndarray]) -> np.ndarray:
    """KPSS test for a stable level, with a Bartlett window, for each series."""
    table, first = _aligned(series)
    n = table.shape[1] - first
    live = np.arange(table.shape[1]) >= first[:, None]
    e = np.where(live, table - (table.sum(axis=1) / n)[:, None], 0.0)
    e[np.array([np.ptp(x) == 0 for x in series])] = 0.0
    variance = (e * e).sum(axis=1) / n
    lags = (4 * (n / 100.0) ** 0.25).astype(int)
    for k in range(1, min(int(lags.max()), table.shape[1] - 1) + 1):
        weight = np.where(k <= lags, 2 * (1 - k / (lags + 1)), 0.0)
        variance = variance + weight * np.einsum("ij,ij->i", e[:, k:], e[:, :-k]) / n
    sums = np.cumsum(e, axis=1)
    with np.errstate(all="ignore"):
        return (variance > 0) & (np.einsum("ij,ij->i", sums, sums) / (n * n * variance) > KPSS_LIMIT)


def stationary(coefficients: np.ndarray) -> np.ndarray:
    """Whether 1 - c1 z - c2 z^2 - ... has its roots outside the unit circle, for each row.

    Steps down through the partial autocorrelations, all of which must be below 1.
    """
    a = coefficients.copy()
    sound = np.ones(len(a), bool)
    with np.errstate(all="ignore"):
        for k in range(a.shape[1] - 1, -1, -1):
            last = a[:, k]
            sound &= np.abs(last) < 1
            a = (a[:, :k] + last[:, None] * a[:, k - 1 :: -1][:, :k]) / (1 - last * last)[:, None] if k else a
    return sound


def _solved(cross: np.ndarray, against: np.ndarray) -> np.ndarray:
    inverse = np.linalg.pinv(cross, rcond=RANK_TOLERANCE, hermitian=True)
    return (inverse @ against[:, :, None])[:, :, 0]


def _sums(x: np.ndarray, start: np.ndarray, lags: list[int]) -> list[np.ndarray]:
    """For each lag: the sum over the days from `start` on, each moved back by the lag."""
    width, begin = x.shape[1], int(start.min())
    if len(lags) < RUNNING_LAGS:
        used = (np.arange(begin, width) >= start[:, None]).astype(float)
        return [np.einsum("ij,ij->i", x[:, begin - k : width - k], used) for k in lags]
    rows, running = np.arange(len(x)), np.cumsum(x, axis=1)
    return [
        running[:, width - 1 - k] - np.where(start > k, running[rows, np.maximum(start - k - 1, 0)], 0.0) for k in lags
    ]


def _days_with_data(table: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows and days of all values but zero; None where most days have one."""
    return np.nonzero(table) if np.count_nonzero(table) * SPARSE_DAYS < table.size else None


def lag_products(tables: list[np.ndarray], terms: list[tuple[int, int]], start: np.ndarray) -> np.ndarray:
    """Sums of products of all pairs of terms over the days from `start` on, for each series.

    A term is a table and a lag; no lagged day may lie before a series' first. What
    two terms multiply depends on the difference of their lags alone, so one running
    sum per difference serves all pairs that have it.
    """
    out = np.empty((len(start), len(terms), len(terms)))
    pairs: dict[tuple, list] = {}
    for i, (a, j) in enumerate(terms):
        for k, (b, m) in enumerate(terms[i:], i):
            key = (a, b, m - j) if m >= j else (b, a, j - m)
            pairs.setdefault(key, []).append((i, k, min(j, m)))
    width = tables[0].shape[1]
    filled = [_days_with_data(t) for t in tables]
    for (a, b, d), members in pairs.items():
        if filled[a] or filled[b]:
            row, day = filled[a] or filled[b]
            day = day if filled[a] else day + d
            inside = (day >= d) & (day < width)
            row, day = row[inside], day[inside]
            values = tables[a][row, day] * tables[b][row, day - d]
            counted = np.flatnonzero(values)
            row, day, values = row[counted], day[counted], values[counted]
            for i, k, lag in members:
                used = (day >= start[row] - lag) & (day < width - lag)
                out[:, i, k] = out[:, k, i] = np.bincount(row[used], values[used], len(start))
            continue
        moved = tables[a].copy()
        moved[:, :d] = 0.0
        moved[:, d:] *= tables[b][:, : width - d]
        for (i, k, _), found in zip(members, _sums(moved, start, [lag for *_, lag in members])):
            out[:, i, k] = out[:, k, i] = found
    return out


def _lag_sums(tables: list[np.ndarray], terms: list[tuple[int, int]], start: np.ndarray) -> np.ndarray:
    out = np.empty((len(start), len(terms)))
    for which, table in enumerate(tables):
        at = [i for i, (a, _) in enumerate(terms) if a == which]
        for i, found in zip(at, _sums(table, start, [terms[i][1] for i in at])):
            out[:, i] = found
    return out


def _normal_equations(tables: list[np.ndarray], terms: list[tuple[int, int]], start: np.ndarray, constant: np.ndarray):
    """For the first table on the days from `start` on: (series, 1 + terms, 1 + terms), against, total, size."""
    products = lag_products(tables, [(0, 0), *terms], start)
    sums = _lag_sums(tables, [(0, 0), *terms], start) * constant[:, None]
    size = (tables[0].shape[1] - start).astype(float)
    cross = np.empty((len(start), 1 + len(terms), 1 + len(terms)))
    cross[:, 0, 0] = size * constant
    cross[:, 0, 1:] = cross[:, 1:, 0] = sums[:, 1:]
    cross[:, 1:, 1:] = products[:, 1:, 1:]
    against = np.concatenate([sums[:, :1], products[:, 1:, 0]], axis=1)
    return cross, against, products[:, 0, 0], size


def long_order(n: int) -> int:
    return min(max(10, int(np.log(n) ** 2) // 3), n // 4)


def _block(series: list[np.ndarray], constant: np.ndarray, season: int | None, horizon: int) -> np.ndarray:
    """Forecasts of stationary series, a row each; NaN where no order fits."""
    table, first = _aligned(series)
    count, width = table.shape
    days, n = np.arange(width), width - first
    gaps = np.where(days >= first[:, None], table - (table.sum(axis=1) / n)[:, None], 0.0)
    scale = np.sqrt(np.einsum("ij,ij->i", gaps, gaps) / n)
    table /= scale[:, None]

    # Shocks: what a long autoregression leaves.
    orders = np.array([long_order(len(x)) for x in series])
    around = [season, season + 1] if season else []
    lags = sorted({*range(1, int(orders.max()) + 1), *around})
    used = (np.array(lags) <= orders[:, None]) | np.isin(lags, around)
    start = first + (used * lags).max(axis=1)
    cross, against, *_ = _normal_equations([table], [(0, k) for k in lags], start, np.ones(count))
    kept = np.concatenate([np.ones((count, 1), bool), used], axis=1)
    fit = _solved(cross * (kept[:, :, None] & kept[:, None, :]), against * kept)
    shocks = table - fit[:, :1]
    filled = _days_with_data(table)
    for k, b in zip(lags, fit[:, 1:].T):
        if filled:
            row, day = (x[filled[1] < width - k] for x in filled)
            shocks[row, day + k] -= b[row] * table[row, day]
        else:
            shocks[:, k:] -= b[:, None] * table[:, : width - k]
    shocks[days < start[:, None]] = 0.0

    # Every order is a part of one set of normal equations.
    lags = [*range(1, MAX_ORDER + 1), *([season] if season else [])]
    start = start + lags[-1]
    terms = [(which, k) for which in (0, 1) for k in lags]
    cross, against, total, size = _normal_equations([table, shocks], terms, start, constant)
    best = np.full(count, np.inf)
    chosen = np.zeros((count, 1 + len(terms)))
    s = MAX_SEASONAL_ORDER if season else 0
    for p, q, sp, sq in product(range(MAX_ORDER + 1), range(MAX_ORDER + 1), range(s + 1), range(s + 1)):
        ar = [*range(1, 1 + p), *([1 + MAX_ORDER] * sp)]
        ma = [len(lags) + j for j in [*range(1, 1 + q), *([1 + MAX_ORDER] * sq)]]
        use = [0, *ar, *ma]
        b = np.zeros_like(chosen)
        b[:, use] = _solved(cross[:, use][:, :, use], against[:, use])
        residual = total - (2 * against * b).sum(axis=1) + (b[:, None, :] @ cross @ b[:, :, None])[:, 0, 0]
        k = p + q + sp + sq + 1 + constant
        score = size * np.log(np.maximum(residual / size, 1e-12)) + 2 * k
        score = score + 2 * k * (k + 1) / np.maximum(size - k - 1, 1)
        better = score < best
        for columns, sign in ((range(1, 1 + len(lags)), 1), (range(1 + len(lags), 1 + 2 * len(lags)), -1)):
            at = np.flatnonzero(better)
            poly = np.zeros((len(at), lags[-1]))
            poly[:, np.array(lags) - 1] = sign * b[at][:, columns]
            better[at] = stationary(poly[:, : MAX_ORDER if sp + sq == 0 else None])
        best[better], chosen[better] = score[better], b[better]

    # Ahead: shocks to come are zero.
    back = lags[-1]
    values, noise = (np.concatenate([z[:, width - back :], np.zeros((count, horizon))], axis=1) for z in (table, shocks))
    for day in range(back, back + horizon):
        seen = np.stack([values[:, day - k] for k in lags] + [noise[:, day - k] for k in lags], axis=1)
        values[:, day] = chosen[:, 0] * constant + (chosen[:, 1:] * seen).sum(axis=1)
    return np.where(np.isfinite(best), scale, np.nan)[:, None] * values[:, back:]


def seasonal_terms(n: int, season: int | None) -> int | None:
    """The period, if a series of this length can be fitted with terms at it."""
    if season is None:
        return None
    rest = n - max(long_order(n), season + 1) - season
    return season if rest >= 2 * (2 * MAX_ORDER + 2 * MAX_SEASONAL_ORDER) + 4 else None


def forecast_stationary(
    series: list[np.ndarray], constant: list[bool], seasons: list[int | None], horizon: int
) -> list[np.ndarray | None]:
    """Forecast each series, whose level needs no further difference; None where it is too short."""
    out: list = [None] * len(series)
    groups: dict[int | None, list[int]] = {}
    for i, (w, c) in enumerate(zip(series, constant)):
        n = len(w)
        if n and np.ptp(w) == 0:
            out[i] = np.full(horizon, w.mean() if c else 0.0)  # a constant series is its own model
        elif n >= 12 and (long := long_order(n)) >= 1 and n - long - MAX_ORDER >= 2 * MAX_ORDER + 4:
            groups.setdefault(seasonal_terms(n, seasons[i]), []).append(i)
    for season, members in groups.items():
        members.sort(key=lambda i: len(series[i]))
        while members:
            n = max(1, BLOCK_CELLS // (8 * len(series[members[-1]])))
            block, members = members[-n:], members[:-n]
            found = _block([series[i] for i in block], np.array([float(constant[i]) for i in block]), season, horizon)
            for i, f in zip(block, found):
                out[i] = f if np.isfinite(f).all() else None
    return out


def arima_many(series: list, periods: list, horizon: int) -> list[np.ndarray | None]:
    """Difference each series as needed, forecast the rest, and add the differences back.

    A series is differenced at its period where it is strongly seasonal, and once
    more where its level is not stable. None for a series that is missing, shorter
    than two periods (or MIN_LENGTH), or not to be fitted.
    """
    out: list = [None] * len(series)
    kept, seasonal, work = [], [], []
    for i, (y, p) in enumerate(zip(series, periods)):
        if y is None or len(y) < (2 * p if p else MIN_LENGTH):
            continue
        y = np.asarray(y, float)
        strength = seasonal_strength(y, p) if p else None
        strong = strength is not None and strength > SEASONAL_DIFFERENCE
        kept.append((i, y, p))
        seasonal.append(strong)
        work.append(y[p:] - y[:-p] if strong else y)
    if not kept:
        return out
    regular = np.zeros(len(work), bool)
    order = sorted(range(len(work)), key=lambda i: len(work[i]))
    while order:
        n = max(1, BLOCK_CELLS // (4 * len(work[order[-1]])))
        block, order = order[-n:], order[:-n]
        regular[block] = needs_difference([work[i] for i in block])
    level = [w[-1] for w in work]
    work = [np.diff(w) if r else w for w, r in zip(work, regular)]
    constant = [not (s and r) for s, r in zip(seasonal, regular)]
    found = forecast_stationary(work, constant, [p for _, _, p in kept], horizon)
    for (i, y, p), s, r, last, f in zip(kept, seasonal, regular, level, found):
        if f is None:
            continue
        if r:
            f = last + np.cumsum(f)
        if s:
            past = np.concatenate([y[-p:], f])
            for k in range(p, len(past)):
                past[k] += past[k - p]
            f = past[p:]
        out[i] = f if np.isfinite(f).all() else None
    return out


@pandas_udf(ArrayType(DoubleType()))
def arima(offsets: pd.Series, amounts: pd.Series, days: pd.Series, period: pd.Series, horizon: pd.Series) -> pd.Series:
    """Forecast from the first `days` days; null where there are none, too few, or nothing fits."""
    ahead = int(horizon.max()) if len(horizon) else 0
    return forecast_batch(arima_many, offsets, amounts, days, [None if pd.isna(p) else int(p) for p in period], ahead)


# Keeps the optimizer from copying the call into filters it derives.
arima = arima.asNondeterministic()
