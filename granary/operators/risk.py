"""Stockout-risk classifier: training, scores and exact explanations."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.forest import bin_limits, bootstrap, grow, impurity
from granary.operators.stockout import FEATURES, daily_activity, feature_table, ml_gate
from granary.plans.radix import value_buckets
from granary.schema import Sales
from granary.session import checkpoint_folder, heavy_tasks, materialize
from granary.sources.results import ResultStore, fingerprint

# The forest, the split, and the label limits.
TREES = 100
DEPTH = 5
SEED = 42
TRAIN_SHARE = 0.8
# Bins of a feature, features a node looks at, and the largest part of a bin that is one bucket when bins are laid.
BINS = 32
PER_NODE = ceil(sqrt(len(FEATURES)))
BUCKET = 1 / 4
# Hash cells of the split.
CELLS = 1 << 16
HIGH_RISK = 0.66
MEDIUM_RISK = 0.33
LOW_ACCURACY = 0.65
NO_EXAMPLES = "no product has enough history for a training example"
ONE_CLASS = "both outcomes are needed at least twice to train and test"


@dataclass
class RiskModel:
    """A trained classifier with its feature table, or the reason there is none."""

    reason: str | None = None
    model: RandomForestClassificationModel | None = None
    model_path: str | None = None
    features: DataFrame | None = None
    metrics: DataFrame | None = None

    @property
    def available(self) -> bool:
        return self.reason is None


def _placed(features: DataFrame, cells: int) -> DataFrame:
    draw = F.xxhash64("product_id", "snapshot_date", F.lit(SEED))
    return features.withColumns({"_draw": draw, "_cell": F.pmod(draw, F.lit(cells))})


def cell_counts(features: DataFrame, cells: int = CELLS) -> DataFrame:
    """Rows per class and hash cell, written once: (stockout_occurred, _cell, n)."""
    return materialize(_placed(features, cells).groupBy("stockout_occurred", "_cell").agg(F.count(F.lit(1)).alias("n")))


def split(features: DataFrame, cells: int = CELLS, counts: DataFrame | None = None) -> DataFrame:
    """Mark four fifths of each class as `is_train`, exactly, by the hash of the row's key.

    Rows are counted per class and hash cell (`counts`, if they are there already);
    the counts say in which cell the limit falls, and only that cell's rows are
    ranked, once. What is marked is then read in one pass.
    """
    label = "stockout_occurred"
    placed = _placed(features, cells)
    counts = cell_counts(features, cells) if counts is None else counts
    before = Window.partitionBy(label).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    limits = (
        counts.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(Window.partitionBy(label))})
        .withColumn("wanted", F.floor(F.col("total") * TRAIN_SHARE))
        .where((F.col("before") <= F.col("wanted")) & (F.col("wanted") < F.col("before") + F.col("n")))
        .select(F.col(label).alias("_label"), F.col("_cell").alias("_limit"), (F.col("wanted") - F.col("before")).alias("_rest"))
    )
    # One row per class, here and below.
    same = F.col(label).eqNullSafe(F.col("_label"))
    key = F.struct("_draw", "product_id", "snapshot_date")
    edge = placed.join(F.broadcast(limits), same & (F.col("_cell") == F.col("_limit"))).select("_label", "_rest", key.alias("_key"))
    order = Window.partitionBy("_label").orderBy("_key")
    last = edge.withColumn("_place", F.row_number().over(order)).where("_place = _rest").select(F.col("_label").alias("_class"), F.col("_key").alias("_last"))
    limits = materialize(limits.join(last, F.col("_label").eqNullSafe(F.col("_class")), "left").select("_label", "_limit", "_last"))
    inside = (F.col("_cell") < F.col("_limit")) | ((F.col("_cell") == F.col("_limit")) & F.coalesce(key <= F.col("_last"), F.lit(False)))
    return placed.join(F.broadcast(limits), same).select(*features.columns, inside.alias("is_train"))


def _assembled(features: DataFrame) -> DataFrame:
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features)
    return vectors.withColumn("label", F.col("stockout_occurred").cast("double"))


def fitting_rows(marked: DataFrame, most: int | None = None) -> DataFrame:
    """The training rows; with `most`, which nothing here gives, about so many of them, drawn by a hash of the key."""
    trained = marked.where("is_train")
    if most is None:
        return trained
    rows = marked.agg(F.count_if("is_train")).scalar()
    draw = F.pmod(F.xxhash64("product_id", "snapshot_date", F.lit(SEED + 1)), F.lit(1 << 30))
    return trained.where(draw * rows < F.lit(float(most) * (1 << 30)))


def bins_of(rows: DataFrame) -> dict[str, list[float]]:
    """Per feature at most BINS - 1 ascending limits, so that bins hold about equally many of all rows."""
    buckets = value_buckets(rows, FEATURES, BUCKET / BINS)
    return {f: bin_limits(*zip(*found), BINS) if found else [] for f, found in buckets.items()}


def train_forest(marked: DataFrame) -> RandomForestClassificationModel:
    """The forest on all training rows, a tree per task.

    One pass finds the bins and one counts the rows of each cell between them; the
    number of cells depends on the bins alone, and the trees need nothing else. Each
    tree draws its bootstrap of the rows by the cell, so the forest depends on what
    the rows are and not on where they lie.
    """
    spark = marked.sparkSession
    rows = fitting_rows(marked)
    bins = bins_of(rows)
    at = [f"_at_{i}" for i in range(len(FEATURES))]
    cells = cell_rows(rows, bins).select("stockout_occurred", "copies", *at).toPandas()
    cells = cells.sort_values([*at, "stockout_occurred"])
    codes, label, copies = cells[at].to_numpy(np.uint8), cells["stockout_occurred"].to_numpy(), cells["copies"].to_numpy()
    cells = spark.sparkContext.broadcast((codes, label, copies))

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, label, copies = cells.value
        for batch in batches:
            for i in batch["id"]:
                r = np.random.default_rng([SEED, i])
                tree = pd.DataFrame(grow(codes, label, bootstrap(copies, r), DEPTH, PER_NODE, r))
                yield tree.assign(tree=i, node=range(len(tree)), stats=tree["stats"].map(list))[columns]

    columns = ["tree", "node", "left", "right", "feature", "cut", "gain", "stats"]
    schema = "tree long, node int, left int, right int, feature int, cut int, gain double, stats array<double>"
    grown = spark.range(0, TREES, 1, heavy_tasks(spark)).mapInPandas(trees, schema)
    nodes = grown.toPandas().sort_values(["tree", "node"])
    cells.unpersist()
    return _as_model(spark, [tree for _, tree in nodes.groupby("tree")], bins)


def _as_model(spark, trees: list[pd.DataFrame], bins: Mapping[str, list[float]]) -> RandomForestClassificationModel:
    """The trees as MLlib's model, so that it scores and stores them."""
    gateway, ml = spark.sparkContext._gateway, spark.sparkContext._jvm.org.apache.spark.ml
    gini = spark.sparkContext._jvm.org.apache.spark.mllib.tree.impurity.GiniCalculator
    limits = [bins[f] for f in FEATURES]

    def array(kind, values: list):
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    def built(tree: pd.DataFrame):
        nodes = [None] * len(tree)
        for r in reversed(list(tree.itertuples())):  # children come after their parents
            stats = gini(array(gateway.jvm.double, [float(n) for n in r.stats]), int(sum(r.stats)))
            says, mixed = float(np.argmax(r.stats)), float(impurity(np.asarray(r.stats)))
            if r.left < 0:
                nodes[r.node] = ml.tree.LeafNode(says, mixed, stats)
            else:
                split = ml.tree.ContinuousSplit(int(r.feature), limits[r.feature][r.cut])
                nodes[r.node] = ml.tree.InternalNode(says, mixed, float(r.gain), nodes[r.left], nodes[r.right], split, stats)
        return nodes[0]

    settings = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=BINS)
    settings._transfer_params_to_java()
    made, size, classes = settings._java_obj, len(FEATURES), 2
    kind = ml.classification.DecisionTreeClassificationModel
    models = array(kind, [kind(f"{made.uid()}_{i}", built(tree), size, classes) for i, tree in enumerate(trees)])
    model = ml.classification.RandomForestClassificationModel(made.uid(), models, size, classes)
    return RandomForestClassificationModel(made.copyValues(model, made.extractParamMap()))


def limits_of(spark, model_path: str) -> dict[str, list[float]]:
    """Per feature the values at which a tree of the stored forest splits, ascending.

    The fit chooses among at most BINS - 1 values a feature, however large the table.
    """
    found = {f: set() for f in FEATURES}
    for tree in forest_table(spark, model_path):
        for left, feature, limit in zip(tree["left"], tree["feature"], tree["limit"]):
            if left >= 0:
                found[FEATURES[feature]].add(float(limit))
    return {f: sorted(limits) for f, limits in found.items()}


def _place(feature: str, limits: list[float]) -> Column:
    """How many of the ascending limits lie below, by halving."""
    if not limits:
        return F.lit(0)
    half = len(limits) // 2
    low, high = _place(feature, limits[:half]), _place(feature, limits[half + 1 :])
    return F.when(F.col(feature) > F.lit(limits[half]), high + F.lit(half + 1)).otherwise(low)


def cell_rows(rows: DataFrame, limits: dict[str, list[float]]) -> DataFrame:
    """Rows per label and cell between the limits, `copies`, with one vector that lies in the cell.

    All rows of a cell take the same way through every tree. The number of cells
    depends on the forest alone.
    """
    places = [_place(f, at) for f, at in limits.items()]
    placed = rows.select("stockout_occurred", *FEATURES, *[p.alias(f"_at_{i}") for i, p in enumerate(places)])
    return placed.groupBy("stockout_occurred", *[f"_at_{i}" for i in range(len(places))]).agg(
        F.count(F.lit(1)).alias("copies"), *[F.min(f).alias(f) for f in FEATURES]
    )


def evaluate(
    model: RandomForestClassificationModel, marked: DataFrame, held: int | None = None,
    limits: dict[str, list[float]] | None = None,
) -> DataFrame:
    """Accuracy, precision and recall (0 when undefined) on the held-out rows; how many rows were fitted on.

    With the forest's `limits`, rows of one cell between them are scored once, and
    count as often as there are. `held` is the number of training rows, where it is known.
    """
    tested = marked.where(~F.col("is_train"))
    tested = tested.withColumn("copies", F.lit(1)) if limits is None else cell_rows(tested, limits)
    scored = model.transform(_assembled(tested))
    said, was = F.col("prediction") == 1, F.col("label") == 1
    rows = F.sum("copies")

    def number(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("copies"))), F.lit(0))

    hits = number(said & was)
    counted = scored.agg(
        (number(said == was) / rows).alias("accuracy"),
        F.coalesce(F.try_divide(hits, number(said)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(hits, number(was)), F.lit(0.0)).alias("recall"),
        F.coalesce(rows, F.lit(0)).alias("n_test"),
    )
    trained = marked.agg(F.count_if("is_train").alias("n_train")).scalar() if held is None else F.lit(held).cast("bigint")
    return counted.select(
        "accuracy", "precision", "recall", trained.alias("n_train"), trained.alias("n_fitted"), "n_test",
        (F.col("accuracy") < LOW_ACCURACY).alias("low_accuracy"),
    )


def inventory_ml(sales: Sales, store: ResultStore | None = None) -> RiskModel:
    """Gate, features, training and metrics; stored under the table's fingerprint and the parameters.

    The forest is fitted on all training rows, four fifths of each class.
    """
    activity = materialize(daily_activity(sales)) if sales.has("current_stock") else None
    gate = ml_gate(sales, activity).first()
    if not gate["available"]:
        return RiskModel(reason=gate["reason"])
    spark = sales.df.sparkSession
    store = store or ResultStore(f"{checkpoint_folder(spark)}/granary-results")
    key = fingerprint(sales.df)
    features = store.table("risk-features", key, sales.df, lambda: feature_table(sales, activity))
    counts = cell_counts(features)
    classes = counts.groupBy("stockout_occurred").agg(F.sum("n").alias("rows")).collect()
    if not classes:
        return RiskModel(reason=NO_EXAMPLES)
    if len(classes) < 2 or min(row["rows"] for row in classes) < 2:
        return RiskModel(reason=ONE_CLASS)
    held = sum(int(row["rows"] * TRAIN_SHARE) for row in classes)
    made_by = {"trees": TREES, "depth": DEPTH, "bins": BINS, "seed": SEED, "share": TRAIN_SHARE}
    marked = split(features, counts=counts)
    model = store.forest("risk-forest", key, lambda: train_forest(marked), **made_by)
    path = store.path("risk-forest", key, **made_by)
    metrics = store.table(
        "risk-metrics", key, sales.df, lambda: evaluate(model, marked, held, limits_of(spark, path)), **made_by
    )
    return RiskModel(None, model, path, features, metrics)


def latest_features(features: DataFrame) -> DataFrame:
    """Each product's last snapshot; buffers of fixed width, so no row is sorted."""
    last = [F.max_by(f, "snapshot_date").alias(f) for f in FEATURES]
    return features.groupBy("product_id").agg(F.max("snapshot_date").alias("snapshot_date"), *last)


def risk_label(score: Column) -> Column:
    return (
        F.when(score >= HIGH_RISK, "high").when(score >= MEDIUM_RISK, "medium").otherwise("low")
    )


def risk_table(trained: RiskModel) -> DataFrame:
    """Probability of running out, from each product's last snapshot."""
    rows = latest_features(trained.features).withColumn("stockout_occurred", F.lit(0))
    score = vector_to_array("probability")[1]
    return trained.model.transform(_assembled(rows)).select(
        "product_id",
        risk_label(score).alias("risk_label"),
        score.alias("risk_score"),
        F.lit("ml_classifier").alias("method"),
    )


def forest_table(spark, model_path: str) -> list[dict[str, np.ndarray]]:
    """The trees as arrays; at most TREES trees of 2^(DEPTH+1) nodes."""
    nodes = spark.read.parquet(f"{model_path}/data").select("treeID", "nodeData.*").toPandas()
    trees = []
    for _, tree in nodes.sort_values("id").groupby("treeID"):
        stats = np.vstack(tree["impurityStats"].to_numpy())
        trees.append(
            {
                "left": tree["leftChild"].to_numpy(),
                "right": tree["rightChild"].to_numpy(),
                "feature": np.array([s["featureIndex"] for s in tree["split"]]),
                "limit": np.array(
                    [(s["leftCategoriesOrThreshold"] or [0.0])[0]
                     if s["leftCategoriesOrThreshold"] is not None
                     and len(s["leftCategoriesOrThreshold"]) else 0.0 for s in tree["split"]]
                ),
                "value": stats[:, 1] / stats.sum(axis=1),
                "cover": tree["rawCount"].to_numpy(dtype=float),
            }
        )
    return trees


def _paths(tree: dict) -> Iterator[tuple[float, dict[int, tuple[float, float, float]]]]:
    """Value of each leaf, and by feature on its path: lower end (outside), upper end, share of training rows."""
    open_nodes = [(0, {})]
    while open_nodes:
        node, path = open_nodes.pop()
        left, right = tree["left"][node], tree["right"][node]
        if left < 0:
            yield tree["value"][node], path
            continue
        feature, limit = tree["feature"][node], tree["limit"][node]
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        w = tree["cover"][left] / (tree["cover"][left] + tree["cover"][right])
        open_nodes.append((left, {**path, feature: (low, min(high, limit), share * w)}))
        open_nodes.append((right, {**path, feature: (max(low, limit), high, share * (1 - w))}))


def shapley(trees: list[dict], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base value and one contribution per feature, exact, in polynomial time.

    A leaf counts as far as the row's known features lead to it and training rows do
    for the unknown ones. With every feature known at chance t this is a product over
    the path, and the mean over t from 0 to 1 of what a feature changes in it is its
    Shapley value. That is a polynomial of lower degree than the path is long, so
    a Gauss-Legendre sum over half as many t is exact.
    """
    x = np.where(np.isnan(x), np.inf, x)  # as the trees do: unknown goes right
    base, parts = 0.0, np.zeros(x.shape)
    for tree in trees:
        for value, path in _paths(tree):
            base += value * np.prod([share for _, _, share in path.values()])
            if not path:
                continue
            features = list(path)
            low, high, share = np.array(list(path.values())).T
            here = x[:, features]
            inside = (~(here <= low) & (here <= high)).astype(float)
            for t, weight in zip(*np.polynomial.legendre.leggauss((len(features) + 1) // 2)):
                t = (t + 1) / 2
                factor = (1 - t) * share + t * inside
                ones = np.ones((len(x), 1))
                ahead = np.cumprod(np.hstack([ones, factor[:, :-1]]), axis=1)
                behind = np.cumprod(np.hstack([ones, factor[:, :0:-1]]), axis=1)[:, ::-1]
                parts[:, features] += value * weight / 2 * (inside - share) * ahead * behind
    return np.full(len(x), base / len(trees)), parts / len(trees)


def risk_explanations(trained: RiskModel) -> DataFrame:
    """Base value plus one additive contribution per feature, for every product.

    Base and contributions add up to the product's probability.
    """
    rows = latest_features(trained.features).select("product_id", *FEATURES)
    # Dealt evenly: a repartition by the product would fall together with the grouping's
    # own, which adaptive execution packs by bytes into few tasks.
    rows = rows.repartition(heavy_tasks(rows.sparkSession))
    trees = forest_table(rows.sparkSession, trained.model_path)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base, parts = shapley(trees, batch[FEATURES].to_numpy(dtype=float))
            out = pd.DataFrame(parts, columns=[f"{f}_contribution" for f in FEATURES])
            out.insert(0, "base_value", base)
            out.insert(0, "product_id", batch["product_id"].to_numpy())
            yield out

    columns = [f"{f}_contribution" for f in FEATURES]
    schema = "product_id string, base_value double, " + ", ".join(f"{c} double" for c in columns)
    explained = rows.mapInPandas(explain, schema)
    strongest = F.array_sort(
        F.array(
            *[
                F.struct(
                    (-F.abs(c)).alias("minus_size"), F.lit(i).alias("i"),
                    F.lit(f).alias("feature"), F.col(c).alias("part"),
                )
                for i, (f, c) in enumerate(zip(FEATURES, columns))
            ]
        )
    )
    top = F.get(strongest, F.lit(0))
    direction = F.when(F.col("_top.part") > 0, "raised").otherwise("lowered")
    return explained.withColumn("_top", top).select(
        "product_id",
        "base_value",
        *columns,
        F.col("_top.feature").alias("top_factor"),
        F.format_string("risk is %s most by %s (%+.3f)", direction, "_top.feature", "_top.part").alias(
            "summary"
        ),
    )
