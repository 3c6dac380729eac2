"""Running totals, quantiles and hot-key lookups against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.operators import kpis, recommendations, stockout
from granary.plans import ranking, rollups
from granary.plans.box import box_numbers
from granary.plans.lookup import join_lookup
from granary.plans.radix import field_quantiles, value_buckets, with_bits
from granary.plans.ranking import exact_quantiles, with_running_totals
from granary.plans.series import product_series, total_series
from tests.conftest import rows_by


@pytest.mark.parametrize("rows_per_bucket", [20, 70, 10_000])
def test_running_totals_match_cumsum(spark, rows_per_bucket):
    rng = np.random.default_rng(1)
    data = [(int(k), int(v)) for k in range(3) for v in rng.permutation(400)]
    df = spark.createDataFrame(data, "k int, v int").withColumn("m", F.col("v") % 7)
    out = with_running_totals(
        df, [F.col("v")], {"m": "bigint"}, ["k"], rows_per_bucket=rows_per_bucket
    ).collect()
    assert len(out) == len(data)
    expected = np.concatenate(([0], np.cumsum(np.arange(400) % 7)))
    for row in out:
        assert row["m_before"] == expected[row["v"]]
        assert row["m_total"] == expected[-1]


def test_running_totals_split_a_hot_tie(spark):
    # Half of all rows share one value: the second sort key must still split them.
    data = [(5.0 if i % 2 else float(i), f"p{i:05d}") for i in range(2000)]
    df = spark.createDataFrame(data, "value double, id string")
    out = with_running_totals(
        df, [-F.col("value"), F.col("id")], {"value": "double"}, rows_per_bucket=100
    ).collect()
    ordered = sorted(data, key=lambda r: (-r[0], r[1]))
    before = dict(zip([r[1] for r in ordered], np.concatenate(([0], np.cumsum([r[0] for r in ordered])))))
    assert all(abs(row["value_before"] - before[row["id"]]) < 1e-6 for row in out)


def test_buckets_of_a_hot_key_are_small_and_null_is_a_key(spark, monkeypatch):
    # A third of all rows in one key, long ids that differ at their ends only, one value for all.
    rows = [("hot" if i % 3 == 0 else (None if i % 3 == 1 and i < 90 else f"k{i:05d}"), 1.0, f"item-of-a-long-name-{i:07d}", 2)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double, id string, m long")
    written, write = [], ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda d: written.append(write(d)) or written[-1])
    out = with_running_totals(df, [F.col("v"), F.col("id")], {"m": "bigint"}, ["k"], rows_per_bucket=100)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    groups = {}
    for r in out.collect():
        groups.setdefault(r["k"], []).append(r)
    assert sum(map(len, groups.values())) == len(rows) and len(groups["hot"]) == 1000 and len(groups[None]) == 30
    for found in groups.values():
        found.sort(key=lambda r: r["id"])
        assert [r["m_before"] for r in found] == [2 * i for i in range(len(found))]
        assert {r["m_total"] for r in found} == {2 * len(found)}
    sizes = [r["count"] for r in written[-1].groupBy("_bucket").count().collect()]
    assert max(sizes) < 300 and len(sizes) > 20


@pytest.mark.parametrize("rows_per_bucket", [15, 10_000])
def test_quantiles_are_exact_for_a_hot_group(spark, rows_per_bucket):
    rng = np.random.default_rng(2)
    groups = {"hot": rng.normal(size=900), "one": np.array([3.5]), "few": np.array([1.0, 1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    found = rows_by(
        exact_quantiles(
            df, "v", {"a": 0.0, "b": 0.2, "c": 0.75, "d": 1.0}, ["k"], rows_per_bucket=rows_per_bucket
        ),
        "k",
    )
    for k, vs in groups.items():
        want = np.quantile(vs, [0, 0.2, 0.75, 1])
        assert np.allclose([found[k][c] for c in "abcd"], want)
        assert found[k]["n"] == len(vs)


SPECIAL = [
    0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, np.nextafter(2.0**-1022, 0), 1.0, np.nextafter(1.0, 0), np.nextafter(1.0, 2),
    2.0**1023, np.finfo(float).max, -np.finfo(float).max, float("inf"), float("-inf"), 1e300, -1e-300, 3.0, 2.0**52 + 1,
]


def test_bits_are_in_the_order_of_doubles(spark):
    rng = np.random.default_rng(5)
    values = [float(v) for v in SPECIAL]
    values += [float(m * 2.0**e) for m, e in zip(rng.uniform(-2, 2, 3000), rng.integers(-1074, 1023, 3000))]
    values += [float(2.0**e) for e in range(-1074, 1024)] + [float(np.nextafter(2.0**e, 0)) for e in range(-1070, 1024)]
    df = with_bits(spark.createDataFrame([(v,) for v in values], "v double"), "v")
    rows = sorted((r["v"], r["bits"]) for r in df.collect())
    want = np.array([v for v, _ in rows]).view(np.int64)
    want = np.where(want < 0, -(want & 0x7FFF_FFFF_FFFF_FFFF), want)
    assert [b for _, b in rows] == want.tolist()
    last = with_bits(spark.createDataFrame([(float("nan"),)], "v double"), "v").first()["bits"]
    assert last > max(want)


def test_radix_quantiles(spark):
    rng = np.random.default_rng(7)
    groups = {
        "close": 1e9 + rng.normal(0, 1e-6, 500), "wide": rng.normal(size=777) * 10.0 ** rng.integers(-300, 300, 777),
        "ties": rng.integers(-3, 4, 1000).astype(float), "one": np.array([3.5]), "zeros": np.array([0.0, -0.0, 0.0]),
        "odd": np.array([v for v in SPECIAL if np.isfinite(v)]), "two": np.array([-2.5, 7.0]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "field string, value double")
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.75, "e": 1.0}
    found = rows_by(field_quantiles(df, shares), "field")
    assert set(found) == set(groups)
    for k, vs in groups.items():
        x = np.sort(vs)
        for name, p in shares.items():
            at = (len(x) - 1) * p
            low, high = x[int(at)], x[min(int(at) + 1, len(x) - 1)]
            assert found[k][name] == low + (high - low) * (at - int(at))
        assert found[k]["n"] == len(vs)
    assert field_quantiles(df.where("false"), shares).collect() == []
    endless = spark.createDataFrame([("x", float("inf")), ("x", 1.0), ("x", float("inf"))], "field string, value double")
    assert field_quantiles(endless, {"m": 0.5}).first()["m"] == float("inf")


def test_nothing_is_sorted_or_written_for_fields(spark, make_sales, monkeypatch):
    from granary.operators import eda, statistics, validation
    from granary import session

    sales = make_sales(date=["2024-01-01"] * 9, product_id=list("abcabcabc"), quantity_sold=[1, 2, 3, 4, 5, 6, 7, 8, 900])
    before = len(session._written)
    frames = [eda.distribution_summary(sales), statistics.descriptive_stats(sales), validation.outlier_bounds(sales.df)]
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "Window" not in plan
    box = frames[0].first()
    assert (box["median"], box["outliers"], box["upper_whisker"]) == (5, 1, 8)
    assert len(session._written) == before


def test_box_numbers(spark):
    rows = [("x", v) for v in [1.0, 2.0, 3.0, 4.0, 100.0]]
    out = box_numbers(spark.createDataFrame(rows, "field string, value double"), ["field"]).first()
    assert (out["q1"], out["median"], out["q3"]) == (2, 3, 4)
    assert (out["upper_whisker"], out["outliers"], out["maximum"]) == (4, 1, 100)


def test_join_lookup_keeps_every_row_of_hot_and_cold_keys(spark):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id"
    )
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    lookup = counts.withColumn("total", F.lit(6000)).withColumn("name", F.col("k").cast("string"))
    out = join_lookup(rows, lookup, ["k"], "w", "total")
    assert out.count() == 6000
    assert out.where(F.col("name") != F.col("k").cast("string")).count() == 0


def test_series_fill_gaps_with_zero(make_sales):
    sales = make_sales(
        date=["2024-01-01", "2024-01-01", "2024-01-04", "2024-01-02"],
        product_id=["a", "a", "a", "b"],
        quantity_sold=[1, 2, 5, 7],
    )
    out = rows_by(product_series(sales), "product_id")
    assert out["a"]["series"] == [3, 0, 0, 5]
    assert out["b"]["series"] == [7]
    assert total_series(sales).first()["series"] == [3, 7, 0, 5]


def test_latest_value_without_a_sort(spark, make_sales):
    """By date, then input order; rows without a date come before all others, readings of null never count."""
    dates = ["1969-12-31 23:59:59.999999", "2024-05-01 08:00:00.000000", "2024-05-01 08:00:00.000000", None, "2024-05-02 00:00:00.000000", None, "1700-01-01 00:00:00.000000"]
    rows = [("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("a", 3, 9.0), ("a", 4, None), ("b", 5, 4.0), ("b", 3, 5.0), ("c", 3, 8.0), ("c", 6, 7.0), ("d", 4, None)]
    frame = {"date": [dates[k] for _, k, _ in rows], "product_id": [p for p, _, _ in rows], "quantity_sold": [1.0] * len(rows), "current_stock": [v for _, _, v in rows]}
    sales = make_sales(**frame)
    totals = rollups.product_totals(sales)
    assert {r.product_id: r.latest_stock for r in totals.collect()} == {"a": 3.0, "b": 5.0, "c": 7.0, "d": None}
    for table in (totals, stockout.daily_activity(sales)):
        assert "SortAggregate" not in table._jdf.queryExecution().executedPlan().toString()


def test_aggregates_are_written_once_for_a_handle(spark, make_sales, monkeypatch):
    sales = make_sales(
        date=["2024-01-01", "2024-01-02", "2024-01-05"], product_id=["a", "b", "a"], quantity_sold=[1.0, 2.0, 3.0],
        current_stock=[5.0, 6.0, 7.0],
    )
    written, write = [], rollups.materialize
    monkeypatch.setattr(rollups, "materialize", lambda d: written.append(d) or write(d))
    fitted = spark.createDataFrame([("a", [1.0, 2.0])], "product_id string, forecast array<double>")
    risk = recommendations.rule_based_risk(sales, fitted)
    recommendations.recommendations(sales, risk, default_lead=7)
    kpis.kpi_summary(sales)
    assert len(written) == 2 and risk.count() == 2
    monkeypatch.setattr(rollups, "releases", lambda: -1)
    assert kpis.kpi_summary(sales).count() == 2 and len(written) == 4


def test_value_buckets_hold_every_row(spark, monkeypatch):
    r = np.random.default_rng(31)
    frame = pd.DataFrame({
        "near": 1e6 + r.integers(0, 400, 5000) / 8, "hot": np.where(r.random(5000) < 0.8, 3.0, r.normal(size=5000)),
        "noisy": np.sqrt(30.0) * (1 + r.integers(-3, 4, 5000) * 2.0**-52), "odd": [-np.inf, np.inf, np.nan, -0.0, 0.0] * 1000,
    })
    rows = [tuple(map(float, row)) for row in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in frame)).withColumn("none", F.lit(None).cast("double"))
    for most in (1 << 20, 64):
        monkeypatch.setattr("granary.plans.radix.BUCKETS", most)
        found = value_buckets(df, df.columns, 0.01)
        assert found["none"] == [] and len(found["noisy"]) == 1
        assert found["odd"][:3] == [(1000, -np.inf, -np.inf), (2000, 0.0, 0.0), (1000, np.inf, np.inf)] and found["odd"][3][0] == 1000
        for c in ("near", "hot", "noisy"):
            values = np.sort(frame[c].to_numpy())
            at = 0
            for rows, least, most_ in found[c]:
                assert (values[at], values[at + rows - 1]) == (least, most_)
                assert rows <= 50 or least == most_ or c == "noisy"
                at += rows
            assert at == len(values)
