"""Weekly, monthly and yearly patterns, for the table and per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.seasonal import MIN_CYCLES, PERIODS, STRENGTH_LIMIT, strengths
from granary.plans.series import points_of, product_points, total_points
from granary.schema import Sales


def with_strengths(points: DataFrame) -> DataFrame:
    """Adds the strength of each tested period; the days without data are filled in the task."""
    return points.withColumn("strengths", strengths(*points_of(F.col("pts")), F.col("days")))


def _period_rows(points: DataFrame, *keys: str) -> DataFrame:
    periods = F.array(
        *[
            F.struct(
                F.lit(label).alias("period_label"),
                F.lit(days).alias("period_days"),
                F.get("strengths", F.lit(i)).alias("seasonal_strength"),
            )
            for i, (label, days) in enumerate(PERIODS.items())
        ]
    )
    rows = with_strengths(points).select(*keys, "days", F.inline(periods))
    needed = F.col("period_days") * MIN_CYCLES
    short = F.col("days") < needed
    seasonal = F.col("seasonal_strength") > STRENGTH_LIMIT
    words = F.when(seasonal, F.concat(F.lit("a "), "period_label", F.lit(" pattern to plan around")))
    return rows.select(
        *keys,
        "period_label",
        "period_days",
        "seasonal_strength",
        F.when(~short, seasonal).alias("is_seasonal"),
        F.when(short, F.format_string("needs %d days of data, has %d", needed, "days")).alias("error"),
        F.when(
            ~short, words.otherwise(F.concat(F.lit("no strong "), "period_label", F.lit(" pattern")))
        ).alias("interpretation"),
    )


def seasonality(sales: Sales) -> DataFrame:
    """Strength of each period over the whole table; an error where too short."""
    return _period_rows(total_points(sales))


def product_seasonality(sales: Sales) -> DataFrame:
    """Strength of each period within every product."""
    return _period_rows(product_points(sales), "product_id")


def first_seasonal(measured: Column) -> Column:
    """The shortest seasonal period in days, null when none is."""
    chosen = [
        F.when(F.get(measured, F.lit(i)) > STRENGTH_LIMIT, days)
        for i, days in enumerate(PERIODS.values())
    ]
    return F.coalesce(*chosen)


def seasonal_periods(sales: Sales) -> DataFrame:
    """(product_id, period) to forecast with."""
    return with_strengths(product_points(sales)).select(
        "product_id", first_seasonal(F.col("strengths")).alias("period")
    )
