"""Daily series as one row per product: its days with data, or gap-filled arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.parsing import zero_if_null
from granary.plans.rollups import daily_demand
from granary.schema import Sales
from granary.session import heavy_tasks


def _collected(days: DataFrame, *keys: str) -> DataFrame:
    """Collect (day, quantity) rows per key: first and last day, and `pts` between.

    `pts` is an array of (t, quantity), t counted in days from the first, and `days` the
    length of the series with the days between. A key holds at most one row per
    calendar day, so an array is bounded by the length of the calendar, however many
    sales the product has.
    """
    found = days.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.unix_date("day").alias("t"), "quantity"))).alias("found")
    )
    first, last = F.element_at("found", 1)["t"], F.element_at("found", -1)["t"]
    return found.select(
        *keys,
        F.date_from_unix_date(first).alias("first_day"),
        F.date_from_unix_date(last).alias("last_day"),
        F.transform(
            "found", lambda p: F.struct((p["t"] - first).alias("t"), p["quantity"].alias("quantity"))
        ).alias("pts"),
        (last - first + 1).alias("days"),
    )


def filled(points: Column) -> Column:
    """The quantities of (t, quantity) points with zeros on the days between."""

    def with_gap(point, i):
        gap = F.coalesce(F.get(points, i + 1)["t"] - point["t"] - 1, F.lit(0))
        return F.concat(F.array(point["quantity"]), F.array_repeat(F.lit(0.0), gap))

    return F.flatten(F.transform(points, with_gap))


def points_of(points: Column) -> tuple[Column, Column]:
    """Days and quantities of the points, each as an array: what tasks in Python are sent."""
    return points["t"], points["quantity"]


def product_points(sales: Sales) -> DataFrame:
    """(product_id, first_day, last_day, pts, days) for every product."""
    tasks = heavy_tasks(sales.df.sparkSession)
    return _collected(daily_demand(sales).repartition(tasks, "product_id"), "product_id")


def product_series(sales: Sales) -> DataFrame:
    """(product_id, first_day, last_day, series, days) for every product."""
    return product_points(sales).withColumn("pts", filled(F.col("pts"))).withColumnRenamed("pts", "series")


def total_points(sales: Sales) -> DataFrame:
    """The same as `product_points` for the whole table: one row, one number per day."""
    days = (
        sales.df.where(F.col("date").isNotNull())
        .groupBy(F.to_date("date").alias("day"))
        .agg(zero_if_null(F.sum("quantity_sold")).alias("quantity"))
    )
    return _collected(days)


def total_series(sales: Sales) -> DataFrame:
    """The whole table's series: one row, one number per day."""
    return total_points(sales).withColumn("pts", filled(F.col("pts"))).withColumnRenamed("pts", "series")
