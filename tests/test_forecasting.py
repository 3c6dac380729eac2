import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.functions import autoregression as ar
from granary.functions.seasonal import seasonal_strength
from granary.functions import smoothing
from granary.functions.smoothing import smooth
from granary.operators import elasticity, forecasting as fc, seasonality
from granary.plans.series import product_points
from granary.sources.results import ResultStore
from tests.conftest import rows_by


def weekly(n=90):
    """Sales that are three times as high on Mondays and twice as high on Thursdays."""
    days = pd.date_range("2020-09-07", periods=n)
    return days, [12.0 * {0: 3, 3: 2}.get(d.dayofweek, 1) for d in days]


@pytest.fixture(scope="module")
def mixed(make_sales):
    rng = np.random.default_rng(515)
    days, pattern = weekly()
    noise = rng.normal(33, 3, 90)
    line = 5 + 2.0 * np.arange(90)
    return make_sales(
        date=list(days) * 3 + list(days[:20]),
        product_id=["week"] * 90 + ["noise"] * 90 + ["line"] * 90 + ["short"] * 20,
        quantity_sold=[*pattern, *noise, *line, *([3] * 20)],
        unit_price=[10] * 290,
    )


def test_strength_against_plain_loops():
    rng = np.random.default_rng(3)
    for p in (7, 30):
        x = rng.normal(size=200) + np.sin(np.arange(200) * 2 * np.pi / p)
        h = p // 2
        w = np.ones(p) / p if p % 2 else np.r_[0.5, np.ones(p - 1), 0.5] / p
        rest = np.full(200, np.nan)
        for i in range(h, 200 - h):
            rest[i] = x[i] - w @ x[i - h : i + h + 1]
        means = np.array([np.nanmean(rest[k::p]) for k in range(p)])
        season = (means - means.mean())[np.arange(200) % p]
        want = season.var(ddof=1) / (season.var(ddof=1) + np.nanvar(rest - season, ddof=1))
        assert seasonal_strength(x, p) == pytest.approx(want)
    assert seasonal_strength(np.zeros(50), 7) == 0 and seasonal_strength(np.zeros(41), 7) is None


def test_periods(mixed):
    out = rows_by(seasonality.seasonal_periods(mixed), "product_id")
    assert out["week"]["period"] == 7
    assert out["noise"]["period"] is None and out["short"]["period"] is None
    rows = rows_by(seasonality.product_seasonality(mixed), "product_id", "period_label")
    assert rows[("week", "weekly")]["seasonal_strength"] == pytest.approx(1)
    assert "needs 2190 days" in rows[("week", "yearly")]["error"]
    assert rows[("week", "yearly")]["is_seasonal"] is None


def test_naive(mixed):
    out = rows_by(fc.naive_forecasts(mixed), "product_id")
    days, pattern = weekly(104)
    assert out["week"]["forecast"] == pattern[90:]
    assert len(set(out["noise"]["forecast"])) == 1 and "short" not in out


def test_selection(mixed):
    out = rows_by(fc.forecasts(mixed), "product_id")
    assert out["short"]["error"] and out["short"]["forecast"] is None
    for product in ("week", "noise", "line"):
        scores = out[product]["all_scores"]
        assert out[product]["test_mae"] == min(scores.values())
        assert out[product]["technique_used"] in scores and len(out[product]["forecast"]) == 14
    assert out["week"]["technique_used"] == "naive" and out["week"]["test_mae"] == 0
    assert out["line"]["forecast"] == pytest.approx(5 + 2.0 * np.arange(90, 104), rel=0.02)
    points = rows_by(fc.forecast_points(fc.forecasts(mixed)), "product_id", "day")
    assert len(points) == 42
    assert min(d for p, d in points if p == "week").isoformat() == "2020-12-06"
    errors = rows_by(fc.backtest_naive(mixed), "product_id")
    assert errors["week"]["naive_mae"] == 0


def test_only_changed_products_are_fitted_again(spark, make_sales, tmp_path):
    rng = np.random.default_rng(77)
    days = list(pd.date_range("2021-01-04", periods=40))
    demand = {p: rng.integers(1, 30, 40).tolist() for p in "abcd"}

    def table(changed=(), order=1):
        rows = [(p, d, q) for p, qs in (demand | dict(changed)).items() for d, q in zip(days, qs)][::order]
        return make_sales(product_id=[r[0] for r in rows], date=[r[1] for r in rows], quantity_sold=[r[2] for r in rows])

    store = ResultStore(str(tmp_path))
    kept = lambda: spark.read.parquet(store.path("forecasts", "by-product_id", horizon=14, hold_out=14, models=fc.MODELS))
    first = rows_by(fc.stored_forecasts(table(), store), "product_id")
    assert first == rows_by(fc.forecasts(table()), "product_id") and kept().count() == 4
    # The same rows in another order: nothing is fitted.
    assert rows_by(fc.stored_forecasts(table(order=-1), store), "product_id") == first and kept().count() == 4
    # One product sold more on one day, one is new: two are fitted.
    more = {"b": [9, *demand["b"][1:]], "e": demand["a"]}
    again = rows_by(fc.stored_forecasts(table(more), store), "product_id")
    assert kept().count() == 6 and set(again) == set("abcde")
    assert {p: again[p] for p in "acd"} == {p: first[p] for p in "acd"}
    assert again == rows_by(fc.forecasts(table(more)), "product_id")
    # What was there before is still known, without the product that came later.
    assert rows_by(fc.stored_forecasts(table(), store), "product_id") == first and kept().count() == 6
    # A damaged file costs its products a new fit, no more.
    for part in tmp_path.rglob("part-*.parquet"):
        part.write_bytes(b"PAR1 damaged")
    assert rows_by(fc.stored_forecasts(table(), store), "product_id") == first
    assert fc.stored_forecasts(table(), store, horizon=3).first()["forecast"].__len__() == 3


def test_smoothing_is_exact_on_lines_and_cycles():
    line = 3 + 0.5 * np.arange(40)
    cycle = np.tile([1.0, 5.0, 2.0, 8.0, 3.0, 9.0, 4.0], 8)
    growth = 2 * 1.01 ** np.arange(60)
    out = smooth([line, cycle, growth, None, np.ones(5)], [None, 7, None, None, None], 14)
    assert out[0] == pytest.approx(3 + 0.5 * np.arange(40, 54))
    assert out[1] == pytest.approx(np.tile(cycle[:7], 2))
    assert out[2] == pytest.approx(2 * 1.01 ** np.arange(60, 74))
    assert out[3] is None and out[4] is None


def test_smoothing_does_not_depend_on_the_batch():
    rng = np.random.default_rng(8)
    series = [rng.normal(50, 5, n) for n in (30, 44, 90, 61)]
    together = smooth(series, [None, 7, 7, None], 14)
    for y, p, f in zip(series, [None, 7, 7, None], together):
        assert smooth([y], [p], 14)[0] == pytest.approx(f)


def arima_one(y, period, horizon):
    return ar.arima_many([y], [period], horizon)[0]


def plain_arma(w, constant, season, horizon):
    """One series, one order after another, each by a least squares solver over its rows."""
    n, scale = len(w), w.std()
    w = w / scale
    lags = sorted({*range(1, ar.long_order(n) + 1), *([season, season + 1] if season else [])})
    start = lags[-1]
    x = np.array([[1, *(w[t - k] for k in lags)] for t in range(start, n)])
    noise = np.zeros(n)
    noise[start:] = w[start:] - x @ np.linalg.lstsq(x, w[start:], rcond=None)[0]
    lags = [1, 2] + ([season] if season else [])
    start += lags[-1]
    best = (np.inf,)
    for p in range(3):
        for q in range(3):
            for sp in range(2 if season else 1):
                for sq in range(2 if season else 1):
                    own = [1, 2][:p] + [season] * sp
                    of_noise = [1, 2][:q] + [season] * sq
                    rows = [
                        [1] * constant + [w[t - k] for k in own] + [noise[t - k] for k in of_noise]
                        for t in range(start, n)
                    ]
                    x = np.array(rows).reshape(n - start, -1)
                    b = np.linalg.lstsq(x, w[start:], rcond=None)[0] if x.size else np.zeros(0)
                    phi = dict(zip(own, b[constant:]))
                    theta = dict(zip(of_noise, b[constant + len(own) :]))
                    roots = []
                    for terms, sign in ((phi, -1), (theta, 1)):
                        if terms:
                            roots += [abs(z) for z in np.roots([sign * terms.get(k, 0) for k in range(max(terms), 0, -1)] + [1])]
                    if roots and min(roots) <= 1:
                        continue
                    size, k = n - start, len(b) + 1
                    rss = ((w[start:] - x @ b) ** 2).sum() if len(b) else (w[start:] ** 2).sum()
                    score = size * np.log(max(rss / size, 1e-12)) + 2 * k + 2 * k * (k + 1) / max(size - k - 1, 1)
                    if score < best[0]:
                        best = (score, b[0] if constant else 0, phi, theta)
    _, c, phi, theta = best
    w, noise = list(w), list(noise)
    for _ in range(horizon):
        w.append(c + sum(f * w[-k] for k, f in phi.items()) + sum(f * noise[-k] for k, f in theta.items()))
        noise.append(0.0)
    return np.array(w[n:]) * scale


def test_batched_arma_against_a_solver_per_series():
    rng = np.random.default_rng(12)
    series, seasons = [], []
    for n in (60, 75, 120, 120, 200, 333):
        e = rng.normal(size=n + 50)
        x = np.zeros(n + 50)
        for t in range(10, n + 50):
            x[t] = 0.4 * x[t - 1] + 0.45 * x[t - 7] + e[t] + 0.3 * e[t - 1]
        series += [x[50:] * 20 + 5, e[50:]]
        seasons += [7, None]
    for constant in (True, False):
        together = ar.forecast_stationary(series, [constant] * 12, seasons, 10)
        for w, m, f in zip(series, seasons, together):
            assert f == pytest.approx(plain_arma(w, constant, ar.seasonal_terms(len(w), m), 10), rel=1e-6, abs=1e-6)
    assert ar.seasonal_terms(30, 7) is None and ar.seasonal_terms(60, 7) == 7
    order = rng.permutation(12)
    again = ar.forecast_stationary([series[i] for i in order], [False] * 12, [seasons[i] for i in order], 10)
    for i, f in zip(order, again):
        assert f == pytest.approx(together[i])


def test_seasonal_terms_are_used():
    rng = np.random.default_rng(2)
    x = np.zeros(900)
    for t in range(7, 900):
        x[t] = 0.9 * x[t - 7] + rng.normal()
    train, test = x[200:886], x[886:]
    with_terms, without = (np.abs(ar.forecast_stationary([train], [True], [m], 14)[0] - test).mean() for m in (7, None))
    assert with_terms < 0.8 * without


def test_difference_and_roots():
    rng = np.random.default_rng(4)
    walk = np.cumsum(rng.normal(size=(20, 150)), axis=1)
    series = [*walk, *rng.normal(size=(20, 90)), np.full(30, 2.0)]
    need = ar.needs_difference(series)
    assert need[:20].mean() > 0.8 and need[20:40].mean() < 0.2 and not need[40]
    assert [ar.needs_difference([x])[0] for x in series] == need.tolist()
    c = rng.normal(0, 0.5, (300, 8)) * (rng.random((300, 8)) < 0.4)
    for row, sound in zip(c, ar.stationary(c)):
        roots = np.roots([*(-row[::-1]), 1])
        assert sound == (not len(roots) or np.abs(roots).min() > 1)


def test_smoothing_never_above_the_grid():
    rng = np.random.default_rng(6)
    rows = [rng.gamma(3, 10, n) + np.arange(n) / k + 10 for n, k in ((40, 1), (90, 3), (200, 9), (90, 50))]
    better = 0
    for period in (None, 7):
        for multiplicative in (False, True):
            block = smoothing._Block(rows, period, multiplicative)
            _, found = block.fit()
            on_grid = block.run(smoothing._grid(period is not None)[:, None, :])[0].min(axis=1)
            assert (found <= on_grid).all()
            better += (found < on_grid * 0.999).sum()
    assert better > 8


def test_arima():
    rng = np.random.default_rng(9)
    x = np.zeros(600)
    for t in range(1, 600):
        x[t] = 0.8 * x[t - 1] + rng.normal()
    forecast = arima_one(x + 10, None, 3)
    assert forecast - 10 == pytest.approx(x[-1] * 0.8 ** np.arange(1, 4), abs=0.6)
    assert arima_one(np.full(40, 4.0), None, 5) == pytest.approx(np.full(5, 4.0))
    trend = arima_one(np.arange(100.0), None, 5)
    assert trend == pytest.approx(np.arange(100.0, 105.0))
    _, pattern = weekly(98)
    assert arima_one(np.array(pattern), 7, 14) == pytest.approx(pattern[:14])
    assert arima_one(np.arange(10.0), None, 5) is None


@pytest.fixture(scope="module")
def priced(make_sales):
    """Demand of elasticity -1 around a slowly moving price, and a product of one price."""
    days = pd.date_range("2019-02-01", periods=70)
    price = 9 + 4 * np.sin(np.arange(70) / 5)
    wobble = 1 + 0.04 * np.cos(np.arange(70) * 2.3)
    return make_sales(
        date=list(days) * 2, product_id=["e"] * 70 + ["flat"] * 70,
        quantity_sold=[*(320 / price * wobble), *([6] * 70)],
        unit_price=[*price, *([12] * 70)],
    )


def test_elasticity(priced, make_sales):
    out = rows_by(elasticity.price_elasticity(priced), "product_id")
    assert set(out) == {"e"}
    assert -1.3 < out["e"]["elasticity_coefficient"] < -0.7 and out["e"]["p_value"] < 1e-6
    assert elasticity.elasticity_status(priced).first()["available"]
    bare = make_sales(date=["2024-01-01"], product_id=["a"], quantity_sold=[1])
    assert elasticity.elasticity_status(bare).first()["reason"]
    steady = make_sales(
        date=["2024-01-01"] * 6, product_id=["a"] * 6, quantity_sold=[4] * 6,
        unit_price=[1, 2, 3, 4, 5, 6],
    )
    row = elasticity.price_elasticity(steady).first()
    assert row["r_squared"] == 0 and row["p_value"] == pytest.approx(1)


def test_what_if(priced):
    units = fc.forecast_units(fc.naive_forecasts(priced))
    plan = elasticity.price_what_if(priced, units, [10, 1000])
    out = rows_by(elasticity.rounded_what_if(plan), "price_change_pct")
    assert out[1000]["projected_units"] == 0
    row = out[10]
    assert row["new_price"] == pytest.approx(row["current_price"] * 1.1, abs=0.01)
    assert row["projected_units"] < row["baseline_units"]


def seldom_sold(rng, n, every, head=0):
    """A series with a sale on about one day in `every`; whole numbers."""
    x = np.where(rng.random(n) < 1 / every, rng.integers(1, 50, n), 0).astype(float)
    x[:head] = 0
    return x


def test_runs_of_zeros_are_taken_in_one():
    """The search steps from sale to sale and finds what going day by day finds."""
    rng = np.random.default_rng(31)
    rows = [seldom_sold(rng, n, e, h) for n, e, h in ((2000, 70, 0), (900, 12, 30), (80, 9, 0), (3000, 2000, 1), (40, 8, 0))]
    rows += [np.zeros(50), np.r_[5.0, np.zeros(2600), 7.0], np.r_[np.zeros(20), 4.0], np.r_[4.0, np.zeros(1100)]]
    fast, plain = smoothing._SparseBlock(rows), smoothing._Block(rows, None, False)
    assert fast.steps == max(np.count_nonzero(y) for y in rows) < 200
    grid = smoothing._grid(False)[:, None, :]
    own = rng.uniform(0.01, 0.9, (3, len(rows), 4))
    for weights in (grid, own):
        assert fast.squares(weights) == pytest.approx(plain.run(weights)[0], rel=1e-9, abs=1e-9)
    assert fast.fit()[1] == pytest.approx(plain.fit()[1], rel=1e-9, abs=1e-9)
    assert smooth(rows[5:6], [None], 3)[0].tolist() == [0, 0, 0]


def test_lag_products_of_tables_with_few_days():
    rng = np.random.default_rng(32)
    lengths = [400, 300, 120]
    x, first = ar._aligned([seldom_sold(rng, n, 15) for n in lengths])
    noise = rng.normal(size=x.shape)
    start = first + 20
    terms = [(0, 0), *((0, k) for k in range(1, 16)), (1, 0), (1, 2), (1, 20)]
    got = ar.lag_products([x, noise], terms, start)
    for row, begin in enumerate(start):
        columns = np.stack([(x, noise)[a][row, begin - k : x.shape[1] - k] for a, k in terms])
        assert got[row] == pytest.approx(columns @ columns.T)


def test_series_sold_seldom_are_forecast_alike():
    rng = np.random.default_rng(33)
    series = [seldom_sold(rng, n, 11) for n in (300, 420, 260)]
    for y, f in zip(series, ar.forecast_stationary(series, [True] * 3, [None] * 3, 8)):
        assert f == pytest.approx(plain_arma(y, True, None, 8), rel=1e-6, abs=1e-6)


def test_only_days_with_data_travel(make_sales):
    """Two sales years apart are two points, wherever the days between are needed."""
    sales = make_sales(
        date=["2015-03-01", "2021-07-10", "2021-07-01"] + ["2024-01-01"], product_id=["rare"] * 3 + ["once"],
        quantity_sold=[4, 9, 5, 2],
    )
    points = rows_by(product_points(sales), "product_id")
    assert [tuple(p.values()) for p in points["rare"]["pts"]] == [(0, 4.0), (2314, 5.0), (2323, 9.0)]
    assert points["rare"]["days"] == 2324 and points["once"]["days"] == 1
    out = rows_by(fc.naive_forecasts(sales), "product_id")
    assert set(out) == {"rare"} and out["rare"]["forecast"] == [9 / 7] * 14
    assert rows_by(fc.backtest_naive(sales), "product_id")["rare"]["naive_mae"] == pytest.approx(14 / 14)
    chosen = rows_by(fc.model_selection(sales), "product_id")
    assert len(chosen["rare"]["series"]) == 2324 and chosen["once"]["error"]
    plan = fc.forecast_summary(fc.forecasts(sales))._jdf.queryExecution().executedPlan().toString()
    assert "flatten" not in plan


def test_baseline_from_points(spark):
    """Cycles and means from points are those of the series with its zeros."""
    points = [(0, 3.0), (2, 5.0), (9, 1.0), (12, 8.0), (13, 2.0), (15, 6.0)]
    dense = np.zeros(16)
    for t, q in points:
        dense[t] = q
    rows = [(n, p, points) for n in (1, 3, 10, 14, 16) for p in (None, 7, 5)] + [(None, 7, points)]
    frame = spark.createDataFrame(rows, "days int, period int, pts array<struct<t:int,quantity:double>>")
    for r in frame.withColumn("f", fc.naive(F.col("pts"), F.col("days"), F.col("period"), 9)).collect():
        n, p = r["days"], r["period"]
        if n is None:
            assert r["f"] is None
        elif p and n >= 2 * p:
            assert r["f"] == [dense[n - p + k % p] for k in range(9)]
        else:
            assert r["f"] == [dense[max(n - 7, 0) : n].mean()] * 9
