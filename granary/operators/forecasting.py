"""Fourteen-day demand forecasts per product, by the model that back-tests best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.autoregression import arima
from granary.functions.smoothing import ets
from granary.operators.seasonality import first_seasonal, with_strengths
from granary.plans.series import filled, points_of, product_points, product_series
from granary.schema import Sales
from granary.session import checkpoint_folder
from granary.sources.results import ResultStore, group_fingerprints

# Days to forecast, days held out, days in the moving average.
HORIZON = 14
HOLD_OUT = 14
AVERAGE_DAYS = 7
MODELS = ["naive", "ets", "arima"]
TOO_SHORT = f"at least {2 * HOLD_OUT} days of data are needed to compare models"


def daily_series(sales: Sales) -> DataFrame:
    """The gap-filled series as rows (product_id, day, quantity)."""
    return product_series(sales).select(
        "product_id", "first_day", F.posexplode("series").alias("offset", "quantity")
    ).select("product_id", F.date_add("first_day", F.col("offset")).alias("day"), "quantity")


def with_period(points: DataFrame) -> DataFrame:
    return with_strengths(points).withColumn("period", first_seasonal(F.col("strengths"))).drop("strengths")


def _on(points: Column, day: Column) -> Column:
    """The quantity of one day, zero without data."""
    found = F.get(F.filter(points, lambda p: p["t"] == day), F.lit(0))
    return F.coalesce(found["quantity"], F.lit(0.0))


def naive(points: Column, days: Column, period: Column, horizon: int = HORIZON) -> Column:
    """The last cycle repeated, or the mean of the last week where nothing is seasonal.

    Looks at the first `days` days only; null where there are none.
    """
    ahead = F.sequence(F.lit(0), F.lit(horizon - 1))
    back = F.greatest(F.coalesce(period, F.lit(0)), F.lit(AVERAGE_DAYS))
    late = F.filter(points, lambda p: (p["t"] < days) & (p["t"] >= days - back))
    cycle = F.transform(ahead, lambda k: _on(late, days - period + k % period))
    week = F.filter(points, lambda p: (p["t"] < days) & (p["t"] >= days - AVERAGE_DAYS))
    total = F.aggregate(week, F.lit(0.0), lambda a, p: a + p["quantity"])
    mean = total / F.least(days, F.lit(AVERAGE_DAYS))
    return F.when(period.isNotNull() & (days >= 2 * period), cycle).when(
        days.isNotNull(), F.array_repeat(mean, horizon)
    )


def mean_absolute_error(actual: Column, predicted: Column) -> Column:
    """Mean distance over the days both have; null without a prediction."""
    gaps = F.zip_with(actual, predicted, lambda a, b: F.abs(a - b))
    return F.aggregate(gaps, F.lit(0.0), lambda a, v: a + v) / F.size(gaps)


def _split(points: DataFrame) -> DataFrame:
    """Days to train on and quantities to test against; null where the series is too short to compare models."""
    enough = F.col("days") >= 2 * HOLD_OUT
    train = F.col("days") - HOLD_OUT
    late = F.filter("pts", lambda p: p["t"] >= train)
    test = F.transform(F.sequence(F.lit(0), F.lit(HOLD_OUT - 1)), lambda k: _on(late, train + k))
    return points.withColumns({"train": F.when(enough, train), "test": F.when(enough, test)})


def backtest_naive(sales: Sales) -> DataFrame:
    """Error of the baseline on the held-out days."""
    split = _split(with_period(product_points(sales)))
    predicted = naive(F.col("pts"), F.col("train"), F.col("period"))
    return split.where(F.col("days") >= 2 * HOLD_OUT).select(
        "product_id", mean_absolute_error(F.col("test"), predicted).alias("naive_mae")
    )


def naive_forecasts(sales: Sales, horizon: int = HORIZON) -> DataFrame:
    """The baseline alone: (product_id, last_day, forecast), without Python models."""
    points = with_period(product_points(sales))
    forecast = naive(F.col("pts"), F.col("days"), F.col("period"), horizon)
    return points.where(F.col("days") >= 2 * HOLD_OUT).select("product_id", "last_day", forecast.alias("forecast"))


def model_selection(sales: Sales) -> DataFrame:
    """Held-out error of every model per product, and the winner.

    Ties go to the simpler model. Too short a series gets an error instead.
    """
    chosen = _chosen(sales)
    series = {"pts": filled(F.col("pts"))}
    return chosen.withColumns(series).withColumnRenamed("pts", "series").drop("days")


def _chosen(sales: Sales) -> DataFrame:
    split = _split(with_period(product_points(sales)))
    points, horizon = points_of(F.col("pts")), F.lit(HOLD_OUT)
    predicted = split.withColumns(
        {
            "naive": naive(F.col("pts"), F.col("train"), F.col("period")),
            "ets": ets(*points, F.col("train"), F.col("period"), horizon),
            "arima": arima(*points, F.col("train"), F.col("period"), horizon),
        }
    )
    scored = predicted.withColumns(
        {f"{m}_mae": mean_absolute_error(F.col("test"), F.col(m)) for m in MODELS}
    )
    entries = F.array(
        *[
            F.struct(F.col(f"{m}_mae").alias("mae"), F.lit(i).alias("rank"), F.lit(m).alias("model"))
            for i, m in enumerate(MODELS)
        ]
    )
    ranked = F.array_sort(F.filter(entries, lambda e: e["mae"].isNotNull()))
    return (
        scored.withColumn("ranked", ranked)
        .withColumn("best", F.get("ranked", F.lit(0)))
        .select(
            "product_id",
            "last_day",
            "pts",
            "days",
            "period",
            F.col("best.model").alias("technique_used"),
            F.col("best.mae").alias("test_mae"),
            F.map_from_entries(
                F.transform("ranked", lambda e: F.struct(e["model"], e["mae"]))
            ).alias("all_scores"),
            F.when(F.col("best").isNull(), TOO_SHORT).alias("error"),
        )
    )


def forecasts(sales: Sales, horizon: int = HORIZON) -> DataFrame:
    """One row per product: the winner refitted on the whole series.

    A model sees only the products it won, so no series is fitted twice.
    """
    chosen = _chosen(sales)
    points, ahead = points_of(F.col("pts")), F.lit(horizon)

    def own(model):
        return F.when(F.col("technique_used") == model, F.col("days"))

    fitted = chosen.withColumns(
        {
            "naive": naive(F.col("pts"), own("naive"), F.col("period"), horizon),
            "ets": ets(*points, own("ets"), F.col("period"), ahead),
            "arima": arima(*points, own("arima"), F.col("period"), ahead),
        }
    )
    forecast = F.when(F.col("technique_used") == "naive", F.col("naive"))
    forecast = forecast.when(F.col("technique_used") == "ets", F.col("ets"))
    forecast = forecast.when(F.col("technique_used") == "arima", F.col("arima"))
    return fitted.select(
        "product_id", "last_day", "technique_used", "test_mae", "all_scores",
        forecast.alias("forecast"), "error",
    )


def stored_forecasts(sales: Sales, store: ResultStore | None = None, horizon: int = HORIZON) -> DataFrame:
    """`forecasts`, of which only products whose rows changed since the last call are fitted.

    What a product's forecast depends on is its dates and quantities; their print is
    stored with it. Without a `store`, results lie beside the session's tables.
    """
    store = store or ResultStore(f"{checkpoint_folder(sales.df.sparkSession)}/granary-results")
    keyed = sales.keyed()
    prints = group_fingerprints(keyed, "product_id", ["date", "quantity_sold"])

    def build(changed: DataFrame) -> DataFrame:
        return forecasts(Sales(keyed.join(changed, "product_id", "left_semi")), horizon)

    made_by = {"horizon": horizon, "hold_out": HOLD_OUT, "models": MODELS}
    return store.rows("forecasts", prints, "product_id", build, **made_by)


def forecast_summary(fitted: DataFrame) -> DataFrame:
    return fitted.select("product_id", "technique_used", "test_mae", "all_scores", "error")


def forecast_points(fitted: DataFrame) -> DataFrame:
    """(product_id, day, quantity) for each forecast day."""
    return fitted.select(
        "product_id", "last_day", F.posexplode("forecast").alias("offset", "quantity")
    ).select("product_id", F.date_add("last_day", F.col("offset") + 1).alias("day"), "quantity")


def forecast_units(fitted: DataFrame) -> DataFrame:
    """(product_id, baseline_units): the total over the horizon."""
    total = F.aggregate("forecast", F.lit(0.0), lambda a, v: a + v)
    return fitted.where(F.col("forecast").isNotNull()).select(
        "product_id", total.alias("baseline_units")
    )
