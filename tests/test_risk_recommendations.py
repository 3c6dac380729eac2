import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Observation
from pyspark.sql import functions as F

from granary.functions import forest
from granary.operators import forecasting as fc
from granary.operators import recommendations as rec
from granary.operators import report, risk, stockout
from granary.schema import OPTIONAL_FIELDS, Sales
from granary.sources.results import ResultStore
from tests.conftest import rows_by


def cycles(products=4, days=430, gaps=False):
    """Stock that follows saw teeth of each product's own length down to nothing, with noise on the sales."""
    rng = np.random.default_rng(2077)
    rows = []
    for p in range(products):
        length, top = 17 + 5 * p, 60.0 + 15 * p
        for i, d in enumerate(pd.date_range("2021-03-15", periods=days)):
            left = round(top * (1 - (i % length) / (length - 1)), 1)
            seen = None if gaps and rng.random() < 0.45 else left
            if not gaps or rng.random() < 0.75:
                rows.append((d, f"p{p}", float(rng.binomial(12, 0.3 + p / 20)), seen, 8.0 + 3 * (i % 4)))
    return pd.DataFrame(rows, columns=["date", "product_id", "quantity_sold", "current_stock", "unit_price"])


@pytest.fixture(scope="module")
def history(make_sales):
    frame = cycles()
    return make_sales(**{c: list(frame[c]) for c in frame}, category=["c"] * len(frame))


def test_readings_and_events(make_sales):
    sales = make_sales(
        date=["2024-01-01", "2024-01-03", "2024-01-05", "2024-01-06", "2024-01-06"],
        product_id=["a"] * 5, quantity_sold=[1] * 5, current_stock=[50, 5, 0, 10, 40],
    )
    held = {d.day: r["stock"] for d, r in rows_by(stockout.daily_stock(sales), "day").items()}
    assert held == {1: 50, 2: 50, 3: 5, 4: 5, 5: 0, 6: 40}
    assert [r["stockout_date"].day for r in stockout.stockout_events(sales).collect()] == [5]
    gate = stockout.ml_gate(sales).first()
    assert not gate["available"] and "1 stockouts" in gate["reason"]
    assert not risk.inventory_ml(sales).available


def test_gate_reasons(make_sales, history):
    none = make_sales(date=["2024-01-01"], product_id=["a"], quantity_sold=[1])
    assert stockout.ml_gate(none).first()["reason"] == stockout.NO_STOCK
    flat = make_sales(
        date=["2024-01-01", "2024-01-02"], product_id=["a", "a"], quantity_sold=[1, 1], current_stock=[5, 5]
    )
    assert stockout.ml_gate(flat).first()["reason"] == stockout.NO_HISTORY
    assert stockout.ml_gate(history).first()["available"]


def brute_features(frame):
    """Features on dense daily series, one snapshot at a time."""
    out = {}
    for p, g in frame.groupby("product_id"):
        demand = g.groupby("date")["quantity_sold"].sum().asfreq("D", fill_value=0.0)
        seen = g.dropna(subset=["current_stock"]).groupby("date")["current_stock"].last()
        stock = seen.reindex(pd.date_range(seen.index.min(), seen.index.max())).ffill()
        events = stock.index[(stock.shift(1) > 0) & (stock <= 0)]
        for s in pd.date_range(
            stock.index.min() + pd.Timedelta(days=30), stock.index.max() - pd.Timedelta(days=14), freq="7D"
        ):
            window = demand[(demand.index > s - pd.Timedelta(days=30)) & (demand.index <= s)]
            if len(window) < 15:
                continue
            mean = window.mean()
            out[(p, s.date())] = (
                min(stock[s] / mean, 365) if mean > 0 else 365,
                window.std() / mean if mean > 0 else 0,
                np.polyfit(np.arange(len(window)), window.to_numpy(), 1)[0],
                window.sum(),
                int(((events > s) & (events <= s + pd.Timedelta(days=14))).any()),
            )
    return out


def test_features_match_dense_series(make_sales):
    frame = cycles(products=3, days=200, gaps=True)
    sales = make_sales(**{c: list(frame[c]) for c in frame})
    found = rows_by(stockout.feature_table(sales), "product_id", "snapshot_date")
    want = brute_features(frame)
    assert set(found) == set(want)
    for key, values in want.items():
        got = [found[key][f] for f in stockout.FEATURES] + [found[key]["stockout_occurred"]]
        assert np.allclose(got, values, atol=1e-8), key


def test_classifier(spark, history, tmp_path_factory):
    store = ResultStore(str(tmp_path_factory.mktemp("store")))
    trained = risk.inventory_ml(history, store)
    assert trained.available
    metrics = trained.metrics.first()
    total = trained.features.count()
    assert metrics["n_train"] + metrics["n_test"] == total
    assert metrics["n_train"] == pytest.approx(0.8 * total, abs=2)
    assert 0 <= metrics["accuracy"] <= 1
    table = rows_by(risk.risk_table(trained), "product_id")
    assert set(table) == {f"p{i}" for i in range(4)}
    explained = rows_by(risk.risk_explanations(trained), "product_id")
    for p, row in explained.items():
        parts = [row[f"{f}_contribution"] for f in stockout.FEATURES]
        assert row["base_value"] + sum(parts) == pytest.approx(table[p]["risk_score"])
        assert row["top_factor"] == stockout.FEATURES[int(np.argmax(np.abs(parts)))]
    again = risk.inventory_ml(history, store)
    assert rows_by(risk.risk_table(again), "product_id") == table


def test_forest_scores_after_the_session_observed_a_table(spark, history, tmp_path_factory):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    trained = risk.inventory_ml(history, ResultStore(str(tmp_path_factory.mktemp("observed"))))
    assert trained.metrics.first()["n_test"] > 0
    assert risk.risk_table(trained).count() == risk.risk_explanations(trained).count() == 4


def test_split_is_exact_and_the_fit_bounded(history):
    table = stockout.feature_table(history).cache()
    for cells in (1, 7, 1 << 16):
        marked = risk.split(table, cells)
        found = marked.groupBy("stockout_occurred").agg(F.count_if("is_train").alias("t"), F.count(F.lit(1)).alias("n")).collect()
        assert len(found) == 2 and all(r["t"] == int(r["n"] * 0.8) for r in found)
        assert marked.count() == table.count() and "_cell" not in marked.columns
    trained = marked.where("is_train").count()
    assert risk.fitting_rows(marked).count() == trained
    assert 0.5 * trained < risk.fitting_rows(marked, int(0.7 * trained)).count() < 0.9 * trained


def labelled(spark, rows, **columns):
    """Training rows of a made table: features that tell nothing where no expression is given, every 40th row a stockout."""
    given = {f: "0.0" for f in stockout.FEATURES} | {"stockout_occurred": "int(id % 40 = 0)", "is_train": "true"} | columns
    key = ["concat('p', id % 1000) AS product_id", "date_add(date'1990-01-01', int(id div 1000)) AS snapshot_date"]
    made = spark.range(rows).selectExpr(*key, *[f"{e} AS {c}" for c, e in given.items()])
    return made.withColumns({f: F.col(f).cast("double") for f in stockout.FEATURES})


def test_every_training_row_is_fitted_on(spark):
    marked = labelled(spark, 150_000, is_train="id % 5 > 0")
    assert risk.fitting_rows(marked).count() == 120_000
    assert risk.fitting_rows(marked).where("not is_train").isEmpty()


def test_rare_values_get_limits(spark, tmp_path):
    # In each feature three of 120,000 rows stand apart, with all the outcomes: a sample of the rows would hardly see them all.
    apart = {f: f"id % 40000 = {77 + i}" for i, f in enumerate(stockout.FEATURES)}
    marked = labelled(
        spark, 120_000, **{f: f"CASE WHEN {rare} THEN 7.0 ELSE id % 5 END" for f, rare in apart.items()},
        stockout_occurred=f"int({' OR '.join(apart.values())})",
    )
    path = f"{tmp_path}/forest"
    risk.train_forest(marked).save(path)
    assert all(5.5 in limits for limits in risk.limits_of(spark, path).values())
    for tree in risk.forest_table(spark, path):
        assert tree["cover"][0] == pytest.approx(120_000, abs=6 * 120_000**0.5)


def test_the_model_counts_every_snapshot_of_a_large_table(spark, tmp_path):
    # 30 products with a sale and a reading every 400 days over a hundred years: some 156,000 snapshots.
    made = spark.range(30 * 92).selectExpr(
        "concat('p', id div 92) AS product_id", "CAST(date_add(date'1920-01-01', int(id % 92 * 400)) AS timestamp_ntz) AS date",
        "double(1 + id % 5) AS quantity_sold", "double(id * 7 % 11) AS current_stock",
    )
    trained = risk.inventory_ml(Sales(made, dict.fromkeys(OPTIONAL_FIELDS, False) | {"current_stock": True}), ResultStore(str(tmp_path)))
    metrics, total = trained.metrics.first(), trained.features.count()
    assert total > 150_000 and metrics["n_train"] + metrics["n_test"] == total
    assert metrics["n_fitted"] == metrics["n_train"] == pytest.approx(0.8 * total, abs=2)
    for tree in risk.forest_table(spark, trained.model_path):
        assert tree["cover"][0] == pytest.approx(metrics["n_train"], abs=6 * total**0.5)


def test_bins_hold_about_as_many_of_all_rows(spark):
    # Nine in ten values are one, which has a bin with hardly any other; the others share the rest.
    marked = labelled(spark, 100_000, days_of_inventory="CASE WHEN id % 10 > 0 THEN 50.0 ELSE id / 1000 END", demand_volatility="double(id % 32)")
    bins = risk.bins_of(marked)
    assert bins["trailing_total_demand"] == [] and bins["demand_volatility"] == [i + 0.5 for i in range(31)]
    values = marked.toPandas()["days_of_inventory"].to_numpy()
    held = np.bincount(np.searchsorted(bins["days_of_inventory"], values))
    assert 28 <= len(held) <= 32 and 90_001 <= max(held) < 90_001 + 10_000 / 31 / 2
    assert sorted(held)[-2] < 1.5 * 10_000 / 31


def test_limits_between_odd_values():
    rows, low, high = [1, 1, 1, 1], [-math.inf, 1.0, math.inf, math.nan], [-math.inf, np.nextafter(1.0, 2), math.inf, math.nan]
    assert forest.bin_limits(rows, low, high, 32) == [-math.inf, np.nextafter(1.0, 2), math.inf]
    assert forest.bin_limits([5], [1.0], [2.0], 32) == []
    spread = forest.bin_limits([1] * 100, range(100), range(100), 4)
    assert spread == [24.5, 49.5, 74.5]


def test_a_tree_is_the_one_mllib_grows(spark):
    r = np.random.default_rng(5)
    x = np.column_stack([r.integers(0, n, 4000) for n in (4, 9, 20, 30)])
    y = (r.random(4000) < 0.1 + 0.6 * ((x[:, 1] > 4) ^ (x[:, 3] < 10))).astype(int)
    cells, copies = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)
    tree = forest.grow(cells[:, :4], cells[:, 4], copies.astype(float), 5, 4, r)
    df = spark.createDataFrame([(Vectors.dense(*map(float, a)), float(b)) for a, b in zip(x, y)], ["features", "label"])
    theirs = DecisionTreeClassifier(maxDepth=5).fit(df)
    nodes = [theirs._java_obj.rootNode()]
    for n in range(len(tree["left"])):
        node = nodes[n]
        assert list(node.impurityStats().stats()) == list(tree["stats"][n])
        if tree["left"][n] < 0:
            assert node.subtreeDepth() == 0
            continue
        assert (node.split().featureIndex(), node.split().threshold()) == (tree["feature"][n], tree["cut"][n] + 0.5)
        assert node.gain() == pytest.approx(tree["gain"][n])
        nodes += [None] * (max(tree["left"][n], tree["right"][n]) + 1 - len(nodes))
        nodes[tree["left"][n]], nodes[tree["right"][n]] = node.leftChild(), node.rightChild()
    assert theirs.numNodes == len(tree["left"])


def test_a_forest_does_not_depend_on_where_its_rows_lie(spark, tmp_path):
    marked = labelled(spark, 5_000, days_of_inventory="double(id % 97)", stockout_occurred="int(id % 97 < 60 and id % 7 > 1)")
    for name, rows in (("a", marked), ("b", marked.repartition(3, "days_of_inventory"))):
        risk.train_forest(rows).save(f"{tmp_path}/{name}")
    a, b = (risk.forest_table(spark, f"{tmp_path}/{name}") for name in "ab")
    assert max(len(tree["left"]) for tree in a) > 3
    assert all((x[k] == y[k]).all() for x, y in zip(a, b, strict=True) for k in x)


def grown(r, features, depth):
    """A random tree as arrays, with features that come again on a path."""
    tree = {k: [] for k in ("left", "right", "feature", "limit", "value", "cover")}

    def grow(level, cover):
        at = len(tree["left"])
        for k, v in (("left", -1), ("right", -1), ("feature", -1), ("limit", 0.0), ("value", r.random()), ("cover", float(cover))):
            tree[k].append(v)
        if level < depth and cover > 3 and r.random() < 0.9:
            n = int(r.integers(1, cover))
            tree["feature"][at], tree["limit"][at] = int(r.integers(features)), r.normal()
            tree["left"][at], tree["right"][at] = grow(level + 1, n), grow(level + 1, cover - n)
        return at

    grow(0, 1000)
    return {k: np.array(v) for k, v in tree.items()}


def mean_of(tree, row, known, node=0):
    """A tree's mean over the unknown features, by the definition."""
    if tree["left"][node] < 0:
        return tree["value"][node]
    below = [tree["left"][node], tree["right"][node]]
    if tree["feature"][node] in known:
        return mean_of(tree, row, known, below[0 if row[tree["feature"][node]] <= tree["limit"][node] else 1])
    share = tree["cover"][below] / tree["cover"][below].sum()
    return sum(s * mean_of(tree, row, known, b) for s, b in zip(share, below))


def test_shapley_against_all_coalitions():
    r = np.random.default_rng(11)
    for features, depth in ((1, 3), (4, 5), (6, 7)):
        trees = [grown(r, features, depth) for _ in range(3)]
        x = r.normal(size=(5, features))
        x[0, 0] = np.nan
        base, parts = risk.shapley(trees, x)
        for row, found in zip(x, parts):
            worth = lambda known: np.mean([mean_of(t, row, known) for t in trees])
            assert base[0] == pytest.approx(worth(set()))
            for i in range(features):
                others = [f for f in range(features) if f != i]
                want = sum(
                    math.factorial(k) * math.factorial(features - k - 1) / math.factorial(features) * (worth({*c, i}) - worth({*c}))
                    for k in range(features) for c in itertools.combinations(others, k)
                )
                assert found[i] == pytest.approx(want, abs=1e-12)


def test_shapley_of_many_features_adds_up():
    r = np.random.default_rng(12)
    trees = [grown(r, 12, 12) for _ in range(3)]
    x = r.normal(size=(50, 12))
    base, parts = risk.shapley(trees, x)
    for row, found in zip(x, parts):
        assert base[0] + found.sum() == pytest.approx(np.mean([mean_of(t, row, set(range(12))) for t in trees]))


def test_shapley_of_a_single_split():
    tree = {
        "left": np.array([1, -1, -1]), "right": np.array([2, -1, -1]),
        "feature": np.array([2, -1, -1]), "limit": np.array([5.0, 0, 0]),
        "value": np.array([0.5, 0.2, 0.8]), "cover": np.array([10.0, 5, 5]),
    }
    base, parts = risk.shapley([tree], np.array([[0, 0, 1.0, 0], [0, 0, 9.0, 0]]))
    assert base == pytest.approx([0.5, 0.5])
    assert parts == pytest.approx(np.array([[0, 0, -0.3, 0], [0, 0, 0.3, 0]]))


def facts(spark, **changes):
    row = {
        "product_id": "a", "display_name": "A", "risk_label": "high", "has_cover": True,
        "latest_stock": 5.0, "days_of_inventory": 3.0, "reorder_point": 20.0, "xyz_tier": "Y",
        "is_dead_stock": False, "is_slow_mover": False, "days_since_last_sale": 1,
        "gross_quantity_sold": 9.0, "classification": None, "elasticity_coefficient": None, "r_squared": None,
    } | changes
    schema = (
        "product_id string, display_name string, risk_label string, has_cover boolean, latest_stock double, "
        "days_of_inventory double, reorder_point double, xyz_tier string, is_dead_stock boolean, "
        "is_slow_mover boolean, days_since_last_sale int, gross_quantity_sold double, classification string, "
        "elasticity_coefficient double, r_squared double"
    )
    df = spark.createDataFrame([tuple(row.values())], schema)
    advice = F.filter(F.array(*rec._rules(True)), lambda a: a.isNotNull())
    return [(r["action"], r["priority"]) for r in df.select(F.inline(advice)).collect()]


@pytest.mark.parametrize(
    "changes, expected",
    [
        ({}, [("increase_inventory", "high")]),
        ({"risk_label": "medium"}, [("increase_inventory", "medium")]),
        ({"risk_label": "low"}, []),
        ({"latest_stock": 50.0}, []),
        ({"latest_stock": None, "days_of_inventory": None}, []),
        ({"reorder_point": None}, []),
        ({"risk_label": "low", "days_of_inventory": 120.0}, [("reduce_inventory", "medium")]),
        ({"risk_label": "low", "days_of_inventory": 120.0, "xyz_tier": "Z"}, []),
        ({"latest_stock": 50.0, "xyz_tier": "Z"}, [("increase_safety_stock", "medium")]),
        ({"risk_label": "low", "is_slow_mover": True}, [("discount", "low")]),
        ({"risk_label": "low", "classification": "elastic"}, [("consider_price_decrease", "low")]),
        ({"risk_label": "low", "classification": "inelastic"}, [("consider_price_increase", "low")]),
        ({"risk_label": "low", "classification": "suspect_extreme"}, []),
        ({"risk_label": None, "has_cover": None, "days_of_inventory": 500.0}, []),
    ],
)
def test_rules(spark, changes, expected):
    assert facts(spark, **changes) == expected


def test_rule_based_risk(make_sales):
    days = list(pd.date_range("2024-01-01", periods=40))
    sales = make_sales(
        date=days * 2, product_id=["low"] * 40 + ["safe"] * 40,
        quantity_sold=[40.0 if i % 8 == 0 else 0.5 for i in range(40)] + [10.0] * 40,
        current_stock=[10.0] * 40 + [5000.0] * 40,
    )
    out = rows_by(rec.rule_based_risk(sales, fc.naive_forecasts(sales)), "product_id")
    assert out["low"]["risk_label"] == "high" and out["safe"]["risk_label"] == "low"
    assert out["low"]["method"] == "rule_based"


def test_end_to_end(history, tmp_path_factory):
    store = ResultStore(str(tmp_path_factory.mktemp("store")))
    risks = rec.risk_assessment(history, fc.naive_forecasts(history), store)
    advice = rec.ranked(rec.recommendations(history, risks, default_lead=7))
    rows = advice.collect()
    order = [rec.PRIORITIES.index(r["priority"]) for r in rows]
    assert rows and order == sorted(order)
    assert all(isinstance(r["source_signals"], dict) and r["reasoning"] for r in rows)
    facts_row = report.executive_facts(history, risks, advice).first()
    assert facts_row["total_recommendations"] == len(rows) and facts_row["total_products"] == 4
    assert facts_row["top_recommendations"].startswith("1. ")
    lines = rows_by(report.product_report(history, risks, advice), "product_id")
    first = {}
    for r in rows:
        first.setdefault(r["product_id"], r["action"])
    assert {p: v["action"] for p, v in lines.items()} == {p: first.get(p, "none") for p in lines}


def test_report_without_advice(make_sales):
    sales = make_sales(date=["2024-01-01"], product_id=["a"], quantity_sold=[1])
    risks = rec.rule_based_risk(sales, fc.naive_forecasts(sales))
    advice = rec.recommendations(sales, risks).where(F.lit(False))
    row = report.executive_facts(sales, risks, advice).first()
    assert row["top_recommendations"] == report.NOTHING_URGENT
    assert report.product_report(sales, risks, advice).first()["risk_label"] == "unknown"


def test_cells_score_as_their_rows(spark, history, tmp_path_factory):
    store = ResultStore(str(tmp_path_factory.mktemp("cells")))
    trained = risk.inventory_ml(history, store)
    marked = risk.split(trained.features)
    limits = risk.limits_of(spark, trained.model_path)
    assert set(limits) == set(stockout.FEATURES) and all(len(at) <= 31 for at in limits.values())
    tested = marked.where(~F.col("is_train"))
    by_cell = risk.cell_rows(tested.union(tested), limits)
    assert by_cell.agg(F.sum("copies")).first()[0] == 2 * tested.count() and by_cell.count() <= tested.count()
    assert risk.evaluate(trained.model, marked).first() == trained.metrics.first()


def test_features_of_thin_products_and_long_gaps(make_sales):
    # One with a single reading, one without any, one with a gap longer than the look-back, one sold after its last reading.
    days = pd.date_range("1969-11-01", periods=3)
    frame = pd.concat([
        pd.DataFrame({"date": days, "product_id": "single", "quantity_sold": 1.0, "current_stock": [None, 4.0, None]}),
        pd.DataFrame({"date": days, "product_id": "none", "quantity_sold": 2.0, "current_stock": None}),
        pd.DataFrame({"date": [*days, pd.Timestamp("1970-03-01")], "product_id": "gap", "quantity_sold": 3.5, "current_stock": [9.0, 0.0, 5.0, 0.0]}),
        pd.DataFrame({"date": pd.date_range("1970-01-01", periods=120), "product_id": "dense", "quantity_sold": [0.1 * i for i in range(120)],
                      "current_stock": [float(i % 11) if i < 90 else None for i in range(120)]}),
    ])
    found = rows_by(stockout.feature_table(make_sales(**{c: list(frame[c]) for c in frame})), "product_id", "snapshot_date")
    want = brute_features(frame[frame["product_id"].isin(["gap", "dense"])])
    assert set(found) == set(want) and len({p for p, _ in found}) == 2
    for key, values in want.items():
        got = [found[key][f] for f in stockout.FEATURES] + [found[key]["stockout_occurred"]]
        assert np.allclose(got, values, atol=1e-8), key


def test_explanations_are_spread_over_the_tasks(spark, history, tmp_path_factory):
    trained = risk.inventory_ml(history, ResultStore(str(tmp_path_factory.mktemp("spread"))))
    plan = risk.risk_explanations(trained)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan


def test_features_scan_their_rows_once(history):
    plan = stockout.feature_table(history)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Union" not in plan
    last = risk.latest_features(stockout.feature_table(history))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in last.split("MapInArrow")[0]
