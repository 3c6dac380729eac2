"""Per-product aggregates that several operators share.

Catalyst prunes the aggregates an operator does not read, so each operator
selects from these and pays only for its own columns. Partial aggregation runs
before every shuffle: a hot product arrives as one row per input partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from granary.functions.parsing import zero_if_null
from granary.schema import Sales
from granary.session import materialize, releases


def daily_demand(sales: Sales) -> DataFrame:
    """Units per product and calendar day, active days only."""
    return (
        sales.keyed()
        .where(F.col("date").isNotNull())
        .groupBy("product_id", F.to_date("date").alias("day"))
        .agg(zero_if_null(F.sum("quantity_sold")).alias("quantity"))
    )


def demand_stats(sales: Sales) -> DataFrame:
    """Mean and deviation over active days, and mean lead time, per product."""
    days = (
        sales.keyed()
        .where(F.col("date").isNotNull())
        .groupBy("product_id", F.to_date("date").alias("day"))
        .agg(
            zero_if_null(F.sum("quantity_sold")).alias("quantity"),
            F.sum("lead_time_days").alias("lead_sum"),
            F.count("lead_time_days").alias("lead_count"),
        )
    )
    return days.groupBy("product_id").agg(
        F.avg("quantity").alias("mean_daily_demand"),
        zero_if_null(F.stddev_samp("quantity")).alias("std_daily_demand"),
        F.try_divide(F.sum("lead_sum"), F.sum("lead_count")).alias("lead_time_days"),
    )


def stored_aggregates(sales: Sales) -> tuple[DataFrame, DataFrame]:
    """Totals and daily statistics per product, written once for a `Sales` handle.

    Operators on the same handle share the two scans. After `session.release` they are
    made anew.
    """
    if sales.aggregates is None or sales.aggregates[0] != releases():
        sales.aggregates = (releases(), materialize(product_totals(sales)), materialize(demand_stats(sales)))
    return sales.aggregates[1:]


def latest(sales: Sales, value: str) -> Column:
    """Last non-null value by date, then input order; rows without a date come first.

    Where the order is a whole number, date and order are packed into one decimal, a
    buffer of fixed width, so that Spark aggregates by hash and sorts no rows:
    microseconds (to the year 100,000) times 2 * 10^19, more than orders differ by.
    Other orders are compared as they are.
    """
    if isinstance(sales.df.schema["_ord"].dataType, IntegralType):
        micros = F.coalesce(F.unix_micros(F.col("date").cast("timestamp")), F.lit(-4 * 10**18))
        order = micros.cast("decimal(19,0)") * F.lit("2" + "0" * 19).cast("decimal(20,0)") + F.col("_ord").cast("decimal(19,0)")
    else:
        order = F.struct("date", "_ord")
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), order))


def product_totals(sales: Sales) -> DataFrame:
    """One-pass totals per product."""
    quantity = F.col("quantity_sold")
    return sales.keyed().groupBy("product_id").agg(
        zero_if_null(F.sum(quantity)).alias("quantity"),
        zero_if_null(F.sum(F.when(quantity > 0, quantity))).alias("gross"),
        zero_if_null(-F.sum(F.when(quantity < 0, quantity))).alias("returned"),
        zero_if_null(F.sum(quantity * F.col("unit_price"))).alias("revenue"),
        zero_if_null(
            F.sum((F.col("unit_price") - F.col("unit_cost")) * quantity)
        ).alias("profit"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.avg("current_stock").alias("avg_stock"),
        F.min("current_stock").alias("min_stock"),
        F.max("current_stock").alias("max_stock"),
        latest(sales, "current_stock").alias("latest_stock"),
    )
