import numpy as np
import pandas as pd
import pytest

from granary.operators import eda, kpis
from granary.schema import field_availability
from tests.conftest import rows_by


@pytest.fixture(scope="module")
def small(make_sales):
    """A is read at three stocks, B at one only."""
    return make_sales(
        date=["2022-05-02", "2022-05-06", "2022-05-11", "2022-05-03", "2022-05-08", "2022-05-09"],
        product_id=["A", "A", "A", "B", "B", "B"],
        quantity_sold=[14, 6, 20, 1, 2, 6],
        unit_price=[3, 3, 3, 40, 40, 40],
        current_stock=[70, 64, 44, 18, 18, 18],
    )


def test_turnover(small):
    out = rows_by(kpis.turnover(small), "product_id")
    assert out["A"]["inventory_data_type"] == "historical_average"
    assert out["B"]["inventory_data_type"] == "single_snapshot_approximation"
    assert out["B"]["turnover_ratio"] == pytest.approx(9 / 18)


def test_cover_uses_latest_stock_and_whole_span(small):
    out = rows_by(kpis.days_of_inventory(small), "product_id")
    assert out["A"]["latest_stock"] == 44
    assert out["A"]["avg_daily_demand"] == pytest.approx(40 / 9)


def test_latest_stock_skips_nulls_and_breaks_ties_by_order(make_sales):
    sales = make_sales(
        date=["2024-01-01", "2024-01-02", "2024-01-02", "2024-01-05"],
        product_id=["A"] * 4, quantity_sold=[1] * 4, current_stock=[9, 8, 7, None],
    )
    assert kpis.days_of_inventory(sales).first()["latest_stock"] == 7


def test_product_without_stock_keeps_a_null_cover(make_sales):
    sales = make_sales(
        date=["2024-01-01", "2024-01-03"], product_id=["A", "B"], quantity_sold=[1, 2],
        current_stock=[5, None],
    )
    assert rows_by(kpis.days_of_inventory(sales), "product_id")["B"]["days_of_inventory"] is None


def test_abc_by_revenue_and_by_quantity(small, make_sales):
    out = rows_by(kpis.abc_analysis(small), "product_id")
    assert out["B"]["basis"] == "revenue" and out["B"]["value"] == 360
    assert [out[p]["tier"] for p in "BA"] == ["A", "C"]
    plain = make_sales(date=["2024-01-01"] * 2, product_id=["x", "y"], quantity_sold=[9, 1])
    found = rows_by(kpis.abc_analysis(plain), "product_id")
    assert found["x"]["basis"] == "quantity_sold" and found["y"]["tier"] == "C"


def test_abc_buckets_agree(make_sales):
    rng = np.random.default_rng(5)
    n = 1500
    sales = make_sales(
        date=["2024-01-01"] * n, product_id=[f"p{i}" for i in range(n)],
        quantity_sold=rng.integers(1, 4, n), unit_price=[1.0] * n,
    )
    one = rows_by(kpis.abc_analysis(sales), "product_id")
    many = rows_by(kpis.abc_analysis(sales, rows_per_bucket=60), "product_id")
    assert one == many and len(one) == n


def test_xyz_and_buffers_match_pandas(make_sales):
    rng = np.random.default_rng(6)
    days = pd.date_range("2024-01-01", periods=60)
    frame = pd.DataFrame(
        {
            "date": list(days) * 2, "product_id": ["s"] * 60 + ["e"] * 60,
            "quantity_sold": [*rng.normal(50, 2, 60), *rng.exponential(20, 60)],
        }
    )
    sales = make_sales(**{c: list(frame[c]) for c in frame})
    stats = frame.groupby("product_id")["quantity_sold"].agg(["mean", "std"])
    tiers = rows_by(kpis.xyz_analysis(sales), "product_id")
    assert tiers["s"]["xyz_tier"] == "X" and tiers["e"]["xyz_tier"] in "YZ"
    assert kpis.safety_stock(sales).count() == 0
    out = rows_by(kpis.reorder_point(sales, 1.65, 4), "product_id")
    for p in "se":
        assert out[p]["safety_stock"] == pytest.approx(1.65 * stats["std"][p] * 2)
        assert out[p]["reorder_point"] == pytest.approx(4 * stats["mean"][p] + out[p]["safety_stock"])
    levels = rows_by(kpis.safety_stock_scenarios(sales, 4), "product_id", "service_level")
    assert levels[("s", "99%")]["safety_stock"] > levels[("s", "90%")]["safety_stock"]


def test_single_day_has_zero_deviation(make_sales):
    sales = make_sales(date=["2024-01-01"], product_id=["a"], quantity_sold=[3], lead_time_days=[9])
    assert kpis.safety_stock(sales).first()["safety_stock"] == 0
    assert kpis.xyz_analysis(sales).first()["xyz_tier"] == "X"


def test_dead_slow_and_returns(make_sales):
    days = list(pd.date_range("2024-01-01", periods=60))
    sales = make_sales(
        date=days + days[:5], product_id=["live"] * 60 + ["dead"] * 5,
        quantity_sold=[10] * 59 + [-4] + [1] * 5,
    )
    out = rows_by(kpis.dead_slow_stock(sales), "product_id")
    assert out["dead"]["is_dead_stock"] and out["dead"]["days_since_last_sale"] == 55
    assert out["dead"]["is_slow_mover"] and not out["live"]["is_dead_stock"]
    assert (out["live"]["returns"], out["live"]["net_quantity_sold"]) == (4, 586)


def test_without_stock_kpis_are_empty(make_sales):
    sales = make_sales(date=["2024-01-01"], product_id=["a"], quantity_sold=[1])
    assert kpis.turnover(sales).count() == kpis.days_of_inventory(sales).count() == 0
    assert rows_by(field_availability(sales.df), "field")["unit_price"]["available"] is False


def test_empty_table(make_sales):
    sales = make_sales(date=[], product_id=[], quantity_sold=[])
    for operator in (kpis.abc_analysis, kpis.xyz_analysis, kpis.dead_slow_stock, eda.top_products,
                     eda.trending_products, eda.product_labels):
        assert operator(sales).count() == 0
    assert eda.eda_stats(sales).first()["total_units_sold"] == 0


def test_summary_has_every_product(small):
    out = rows_by(kpis.kpi_summary(small, default_lead=3), "product_id")
    assert set(out) == {"A", "B"} and out["A"]["reorder_point"] > 0


def test_labels(make_sales):
    sales = make_sales(
        date=["2024-01-01"] * 5, product_id=["1", "2", "3", "4", "4"],
        product_name=["Bolt", "Bolt", "Nut", None, "Late"], quantity_sold=[1] * 5,
    )
    labels = {k: v["label"] for k, v in rows_by(eda.product_labels(sales), "product_id").items()}
    assert labels == {"1": "Bolt (1)", "2": "Bolt (2)", "3": "Nut", "4": "4"}
    stats = rows_by(eda.product_stats(sales), "product_id")
    assert stats["4"]["display_name"] == "Late" and stats["3"]["total_revenue"] is None


def test_trends(make_sales):
    """Four months; the middle ones must not matter, and zeros make infinite or no growth."""
    months = [f"2022-{m:02d}-{d:02d}" for m, first in ((3, 1), (4, 20), (5, 2), (6, 15)) for d in range(first, first + 8, 2)]
    levels = {"grows": (4, 90, 1, 6), "shrinks": (8, 0, 0, 2), "starts": (0, 5, 5, 3), "silent": (0, 7, 7, 0), "returned": (0, 1, 1, -2)}
    sales = make_sales(
        date=months * len(levels), product_id=[p for p in levels for _ in months],
        quantity_sold=[levels[p][i // 4] for p in levels for i in range(16)],
    )
    out = [(r["label"], r["from_zero"]) for r in eda.trending_products(sales).collect()]
    assert out == [("starts", True), ("grows", False), ("shrinks", False), ("returned", True)]
    growth = {r["label"]: r["growth_percent"] for r in eda.trending_products(sales).collect()}
    assert growth["starts"] == float("inf") and growth["returned"] == float("-inf") and growth["grows"] > 0 > growth["shrinks"]
    apart = make_sales(date=months[:4] + months[-4:], product_id=["a"] * 4 + ["b"] * 4, quantity_sold=[1] * 8)
    assert eda.trending_products(apart).count() == 0


def test_product_profit_and_unknown_product(make_sales):
    sales = make_sales(
        date=["2021-07-04", "2021-07-05", "2021-09-30"], product_id=["p"] * 3,
        quantity_sold=[3, 5, 2], unit_price=[7, 6, 9], unit_cost=[4, 4, 5.5],
    )
    assert eda.product_eda(sales, "p").first()["total_profit"] == 3 * 3 + 5 * 2 + 2 * 3.5
    with pytest.raises(ValueError):
        eda.product_eda(sales, "q")


@pytest.mark.parametrize("rows_per_bucket", [250_000, 40, 7])
def test_product_distribution_in_order_and_through_buckets(make_sales, rows_per_bucket):
    """Products with few rows and with many, with nulls and repeats, agree with numpy either way."""
    rng = np.random.default_rng(41)
    ids = np.repeat(["few", "one", "many", "same"], [12, 1, 90, 30])
    n = len(ids)
    fields = {
        "quantity_sold": rng.integers(-3, 9, n).astype(float),
        "unit_price": np.where(rng.random(n) < 0.3, np.nan, np.round(rng.lognormal(2, 1, n), 2)),
        "current_stock": np.where(ids == "one", np.nan, np.where(ids == "same", -0.0, rng.integers(0, 500, n))),
    }
    sales = make_sales(product_id=ids, date=["2024-01-01"] * n, **fields)
    out = rows_by(eda.product_distribution(sales, rows_per_bucket=rows_per_bucket), "product_id", "field")
    assert len(out) == 4 * len(fields) - 1 - np.isnan(fields["unit_price"][ids == "one"]).sum()
    for (product, field), row in out.items():
        x = fields[field][ids == product]
        x = x[~np.isnan(x)] + 0.0
        q1, median, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = x[(x >= low) & (x <= high)]
        want = [q1, median, q3, len(x), low, high, x.min(), x.max(), inside.min(), inside.max(), len(x) - len(inside)]
        assert list(row.values())[2:] == pytest.approx(want)
        assert str(row["minimum"]) != "-0.0"


def test_product_distribution_moves_rows_once(make_sales, spark, monkeypatch):
    """Nothing is written for products with few rows but the list of the others, which is empty."""
    from granary.plans import box

    written, write = [], box.materialize
    monkeypatch.setattr(box, "materialize", lambda d: written.append(write(d)) or written[-1])
    sales = make_sales(product_id=["a", "b"] * 20, date=["2024-01-01"] * 40, quantity_sold=range(40))
    assert eda.product_distribution(sales).count() == 2
    assert [w.count() for w in written] == [0]
