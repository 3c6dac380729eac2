import itertools
import math

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from granary.functions.shapiro import inverse_normal, p_of_w
from granary.functions import tails
from granary.functions.tails import exact_rank_sum, rank_sum_p, t_two_sided
from granary.operators import statistics as st
from tests.conftest import rows_by


def test_t_tail_against_tables():
    # Two-sided 5 % and 1 % points of Student's t.
    points = [(12.706, 1), (4.303, 2), (2.571, 5), (2.228, 10), (2.042, 30), (1.960, 10**7)]
    t, df = zip(*points)
    assert np.allclose(t_two_sided(t, df), 0.05, atol=2e-4)
    assert np.allclose(t_two_sided([63.657, 3.169, 2.750], [1, 10, 30]), 0.01, atol=1e-4)
    assert t_two_sided([0.0], [7])[0] == pytest.approx(1)


def test_exact_rank_sum_counts_all_arrangements():
    for a, b in [(2, 3), (3, 3), (4, 2), (5, 4)]:
        us = [
            sum(c) - a * (a + 1) / 2 for c in itertools.combinations(range(1, a + b + 1), a)
        ]
        for u in range(a * b + 1):
            upper = max(u, a * b - u)
            want = min(1.0, 2 * sum(v >= upper for v in us) / len(us))
            assert exact_rank_sum(u, a, b) == pytest.approx(want)


def test_normal_rank_sum():
    z = (60 * 60 * 0.62 - 1800 - 0.5) / math.sqrt(60 * 60 * 121 / 12)
    assert rank_sum_p(60 * 60 * 0.62, 60, 60, 0) == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert rank_sum_p(50.0, 10, 10, 20**3 - 20) == 1.0


def test_normal_quantiles(spark):
    from statistics import NormalDist

    ps = [1e-12, 1e-5, 0.01, 0.024, 0.03, 0.3, 0.5, 0.9, 0.9999, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(inverse_normal(F.col("p"))).collect()
    assert [r[0] for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=2e-8)


def normal_table(make_sales, values):
    n = len(values)
    return make_sales(date=["2024-01-01"] * n, product_id=["p"] * n, quantity_sold=list(map(float, values)))


def test_shapiro_published_example(make_sales):
    # The worked example of Shapiro and Wilk (1965).
    heights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    out = st.normality(normal_table(make_sales, heights)).first()
    assert out["w_statistic"] == pytest.approx(0.79, abs=0.005) and out["p_value"] == pytest.approx(0.0067, abs=0.001)
    assert not out["is_normal"] and out["n"] == 11
    even = st.normality(normal_table(make_sales, [4.0] * 5)).first()
    assert (even["w_statistic"], even["p_value"]) == (1.0, 1.0)
    three = st.normality(normal_table(make_sales, [1, 2, 4])).first()
    assert three["w_statistic"] == pytest.approx(27 / 28) and three["p_value"] == pytest.approx(p_of_w(27 / 28, 3))
    assert st.normality(normal_table(make_sales, [1, 2])).count() == 0


def test_normality_looks_at_every_value(make_sales):
    """Heavy ties in chunks and several buckets give what one plain pass gives."""
    from statistics import NormalDist

    rng = np.random.default_rng(4)
    values = np.sort(np.round(rng.normal(50, 4, 6_000)))
    n = len(values)
    m = np.array([NormalDist().inv_cdf((i + 0.625) / (n + 0.25)) for i in range(n)])
    u, total = n**-0.5, m @ m
    last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / total**0.5], u)
    following = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / total**0.5], u)
    a = m * ((1 - 2 * last**2 - 2 * following**2) / (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2)) ** 0.5
    a[[0, 1, -2, -1]] = -last, -following, following, last
    w = (a @ values) ** 2 / ((values - values.mean()) ** 2).sum()
    sales = normal_table(make_sales, rng.permutation(values))
    for options in ({}, {"ranks_per_row": 7, "rows_per_bucket": 5}):
        out = st.normality(sales, **options).first()
        assert out["n"] == n and out["w_statistic"] == pytest.approx(w, abs=1e-9)
    for draw, normal in ((rng.normal(size=1500), True), (rng.exponential(size=1500), False)):
        assert st.normality(normal_table(make_sales, draw)).first()["is_normal"] == normal


@pytest.fixture(scope="module")
def noisy(make_sales):
    rng = np.random.default_rng(7)
    n = 400
    price = rng.integers(5, 40, n).astype(float)
    stock = rng.normal(100, 10, n).round(1)
    stock[::7] = np.nan
    return pd.DataFrame(
        {
            "date": pd.date_range("2024-01-01", periods=n),
            "product_id": rng.integers(0, 5, n).astype(str),
            "category": rng.choice(["a", "b", "c"], n, p=[0.5, 0.3, 0.2]),
            "quantity_sold": (200 - 3 * price + rng.normal(0, 20, n)).round(),
            "unit_price": price,
            "unit_cost": [4.0] * n,
            "current_stock": stock,
        }
    )


@pytest.fixture(scope="module")
def noisy_sales(make_sales, noisy):
    return make_sales(**{c: list(noisy[c]) for c in noisy})


def test_correlations_match_pandas(noisy, noisy_sales):
    for bucketing in ({}, {"rows_per_bucket": 40}):
        out = rows_by(st.spearman(noisy_sales, **bucketing), "field_a", "field_b")
        want = noisy[["quantity_sold", "unit_price", "current_stock"]]
        # ranks are taken within the rows where both fields have a value
        for a, b in itertools.combinations(want.columns, 2):
            both = noisy[[a, b]].dropna()
            assert out[(a, b)]["spearman_r"] == pytest.approx(both[a].rank().corr(both[b].rank()))
        assert len(out) == 3
    pear = rows_by(st.pearson(noisy_sales), "field_a", "field_b")
    assert pear[("quantity_sold", "unit_price")]["pearson_r"] == pytest.approx(
        noisy["quantity_sold"].corr(noisy["unit_price"])
    )
    assert not any("unit_cost" in key for key in pear)
    words = rows_by(st.all_correlations(noisy_sales), "field_a", "field_b")
    assert words[("quantity_sold", "unit_price")]["strength"] == "very strong"
    assert words[("quantity_sold", "unit_price")]["direction"] == "negative"


def test_perfect_correlation(make_sales):
    sales = make_sales(
        date=["2024-01-01"] * 5, product_id=["a"] * 5, quantity_sold=[1, 2, 3, 4, 5],
        unit_price=[5, 4, 3, 2, 1],
    )
    row = st.all_correlations(sales).first()
    assert row["pearson_r"] == pytest.approx(-1) and row["spearman_r"] == pytest.approx(-1)
    assert row["pearson_p_value"] == pytest.approx(0, abs=1e-6)


def test_descriptive(noisy, noisy_sales):
    out = rows_by(st.descriptive_stats(noisy_sales), "field")
    for f in ("quantity_sold", "unit_price", "current_stock"):
        x = noisy[f].dropna()
        assert out[f]["median"] == pytest.approx(x.median())
        assert out[f]["std"] == pytest.approx(x.std())
        z = (x - x.mean()) / x.std(ddof=0)
        assert out[f]["skewness"] == pytest.approx((z**3).mean())
        assert out[f]["kurtosis"] == pytest.approx((z**4).mean() - 3)
    assert out["unit_cost"]["skewness"] is None


def test_rank_test_matches_brute_force(noisy, noisy_sales):
    out = st.compare_largest_groups(noisy_sales, "category", rows_per_bucket=25).first()
    a, b = noisy["category"].value_counts().index[:2]
    x = noisy.loc[noisy["category"] == a, "quantity_sold"].to_numpy()
    y = noisy.loc[noisy["category"] == b, "quantity_sold"].to_numpy()
    u = (x[:, None] > y).sum() + 0.5 * (x[:, None] == y).sum()
    assert (out["group_a"], out["u_statistic"]) == (a, pytest.approx(u))
    assert 0 <= out["p_value"] <= 1


def test_rank_test_edge_cases(make_sales):
    sales = make_sales(
        date=["2024-01-01"] * 9, product_id=["p"] * 9, category=list("xxxxyyyyz"),
        quantity_sold=[1, 2, 3, 4, 15, 16, 17, 18, 3],
    )
    far = st.compare_groups(sales, "category", "x", "y").first()
    assert far["p_value"] == pytest.approx(2 / 70) and far["direction"] == "lower"
    assert st.compare_groups(sales, "category", "x", "z").first()["error"]
    one = make_sales(date=["2024-01-01"], product_id=["p"], category=["x"], quantity_sold=[1])
    assert st.compare_largest_groups(one, "category") is None
    assert st.group_tests(one).count() == 0


def test_exact_tail_against_all_arrangements():
    for n_a, n_b in ((2, 2), (3, 4), (1, 9), (5, 6), (8, 3)):
        us = [sum(c) - n_a * (n_a - 1) // 2 for c in itertools.combinations(range(n_a + n_b), n_a)]
        small, large = sorted((n_a, n_b))
        for u in range(n_a * n_b + 1):
            assert tails.rank_sum_tail_exact(u, small, large) == pytest.approx(np.mean(np.array(us) <= u), abs=1e-14)


def test_exact_tail_at_any_size():
    # One value among n others has a uniform U; of two, P(U <= u) is known in closed form.
    n = 10**9
    assert tails.rank_sum_tail_exact(n // 4, 1, n) == pytest.approx(0.25, rel=1e-8)
    assert tails.rank_sum_tail_exact(2 * n, 2, n) == 1
    assert tails.rank_sum_tail_exact(4 * n - 1, 8, n) + tails.rank_sum_tail_exact(4 * n, 8, n) == pytest.approx(1, abs=1e-14)
    # By a table of counts, one factor of the Gaussian binomial at a time.
    m, n = 7, 3_000
    ways = np.zeros(m * n + 1)
    ways[0] = 1
    for k in range(1, m + 1):
        grown = ways.copy()
        grown[n + k :] -= ways[: max(0, len(ways) - n - k)]
        for start in range(k):
            grown[start::k] = np.cumsum(grown[start::k])
        ways = grown
    for u in (0, 400, 6_000, 10_500):
        assert tails.rank_sum_tail_exact(u, m, n) == pytest.approx(ways[: u + 1].sum() / ways.sum(), rel=1e-6)


def test_one_rule_for_the_rank_test():
    # Just above a size at which the method used to change, exact and normal differ visibly in the tail.
    u, n_a, n_b = 40_000.0, 8, 250_001
    exact, normal = tails.rank_sum_p(u, n_a, n_b, 0.0), tails.rank_sum_p(u, n_a, n_b, 6.0)
    assert tails.is_exact(n_a, n_b, 0.0) and not tails.is_exact(n_a, n_b, 6.0) and not tails.is_exact(9, 9, 0.0)
    assert exact == tails.exact_rank_sum(u, n_a, n_b) < normal / 2
    with pytest.raises(ValueError):
        tails.exact_rank_sum(30.0, 9, 9)


def test_histogram_and_bundle(noisy_sales):
    out = st.histogram(noisy_sales).toPandas()
    area = ((out["bin_end"] - out["bin_start"]) * out["density"]).groupby(out["field"]).sum()
    assert area["quantity_sold"] == pytest.approx(1)
    assert (out.groupby("field").size() == 40).all() and (out["rows"] == 0).any()
    assert out.loc[out["field"] == "unit_cost", "rows"].tolist() == [400] + [0] * 39
    assert {"correlations", "normality", "group_tests"} <= set(st.analytics(noisy_sales))
