"""Exploratory tables: demand, revenue, top and trending products, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.parsing import micros, whole_days, zero_if_null
from granary.plans.box import fences, field_box, field_box_numbers, long_form
from granary.plans.lookup import join_lookup
from granary.plans.radix import field_quantiles
from granary.plans.rollups import daily_demand, product_totals
from granary.schema import OPTIONAL_FIELDS, Sales, unavailable



def revenue() -> Column:
    return F.col("quantity_sold") * F.col("unit_price")


def label_column(sales: Sales) -> str:
    return "product_name" if sales.has("product_name") else "product_id"


def demand_over_time(sales: Sales) -> DataFrame:
    """Units per calendar day."""
    return (
        sales.df.where(F.col("date").isNotNull())
        .groupBy(F.to_date("date").alias("day"))
        .agg(zero_if_null(F.sum("quantity_sold")).alias("quantity_sold"))
    )


def revenue_by_category(sales: Sales) -> DataFrame:
    """Revenue per category; empty unless categories and prices exist."""
    if not (sales.has("category") and sales.has("unit_price")):
        return unavailable(sales.df.sparkSession, "category string, revenue double")
    return (
        sales.df.where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(zero_if_null(F.sum(revenue())).alias("revenue"))
    )


def top_products(sales: Sales, top_n: int = 10) -> DataFrame:
    """The products (by label) that sold the most units."""
    label = label_column(sales)
    return (
        sales.df.where(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("label"))
        .agg(zero_if_null(F.sum("quantity_sold")).alias("quantity_sold"))
        .orderBy(F.desc("quantity_sold"), "label")
        .limit(top_n)
    )


def trending_products(sales: Sales, top_n: int = 10) -> DataFrame:
    """Growth of mean units per row from the first to the last third of the dates.

    A product needs rows in both thirds. From a mean of zero growth is infinite, up
    or down, and flagged as `from_zero`; only a mean that stays zero has none.
    """
    label = label_column(sales)
    span = sales.date_range()
    length = micros(span["first"], span["last"])
    early = micros(span["first"], F.col("date")) * 3 <= length
    recent = micros(F.col("date"), span["last"]) * 3 <= length
    means = (
        sales.df.where(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("label"))
        .agg(
            F.avg(F.when(early, F.col("quantity_sold"))).alias("early_mean"),
            F.avg(F.when(recent, F.col("quantity_sold"))).alias("recent_mean"),
        )
    )
    change = F.col("recent_mean") - F.col("early_mean")
    from_zero = F.col("early_mean") == 0
    infinite = F.when(change > 0, F.lit(float("inf"))).when(change < 0, F.lit(float("-inf")))
    growth = F.when(from_zero, infinite).otherwise(F.try_divide(change, F.col("early_mean")) * 100)
    return (
        means.select("label", growth.alias("growth_percent"), from_zero.alias("from_zero"))
        .where(F.col("growth_percent").isNotNull())
        .orderBy(F.desc("growth_percent"), "label")
        .limit(top_n)
    )


def distribution_summary(sales: Sales) -> DataFrame:
    """Box-plot numbers of every available numeric field."""
    return field_box(long_form(sales.df, sales.numeric_fields()))


def product_distribution(sales: Sales, **bucketing) -> DataFrame:
    """Box-plot numbers of every available numeric field, within each product."""
    return field_box_numbers(sales.keyed(), sales.numeric_fields(), ["product_id"], **bucketing)


def outlier_points(sales: Sales) -> DataFrame:
    """The rows outside a field's fences."""
    fields = sales.numeric_fields()
    quartiles = field_quantiles(long_form(sales.df, fields), {"q1": 0.25, "q3": 0.75})
    # One row per numeric field, four at most.
    limits = F.broadcast(fences(quartiles).select("field", "lower_fence", "upper_fence"))
    points = long_form(sales.df, fields, ["product_id", "date"])
    return (
        points.join(limits, "field")
        .where(~F.col("value").between(F.col("lower_fence"), F.col("upper_fence")))
        .select("field", "product_id", "date", "value")
    )


def eda_stats(sales: Sales) -> DataFrame:
    """One row: units, products, span in days and, when priced, revenue."""
    total = zero_if_null(F.sum(revenue())) if sales.has("unit_price") else F.lit(None).cast("double")
    return sales.df.agg(
        zero_if_null(F.sum("quantity_sold")).alias("total_units_sold"),
        F.count_distinct("product_id").alias("distinct_products"),
        whole_days(F.min("date"), F.max("date")).alias("date_range_days"),
        total.alias("total_revenue"),
    )


def eda_overview(sales: Sales) -> DataFrame:
    """Which parts of the exploratory report the data supports, with the stats."""
    have = {f: sales.has(f) for f in OPTIONAL_FIELDS}
    parts = {
        "demand_over_time": True,
        "revenue_by_category": have["category"] and have["unit_price"],
        "top_products": True,
    } | {f"distribution_{f}": True for f in sales.numeric_fields()}
    present = [f for f in OPTIONAL_FIELDS if have[f]]
    absent = [f for f in OPTIONAL_FIELDS if not have[f]]
    return eda_stats(sales).select(
        "*",
        F.lit(", ".join(present)).alias("available_fields"),
        F.lit(", ".join(absent)).alias("unavailable_fields"),
        F.lit(", ".join(p for p, there in parts.items() if there)).alias("parts"),
    )


def product_labels(sales: Sales) -> DataFrame:
    """A display label per product: its first row's name, else its id.

    A label that several products share gets the id appended. Labels are counted
    by aggregation, so a name shared by very many products never meets in one task.
    """
    keyed = sales.keyed()
    if not sales.has("product_name"):
        return keyed.select("product_id", F.col("product_id").alias("label")).distinct()
    first = keyed.groupBy("product_id").agg(
        F.coalesce(F.min_by("product_name", "_ord"), F.first("product_id")).alias("plain")
    )
    counts = first.groupBy("plain").agg(F.count(F.lit(1)).alias("copies"))
    total = first.agg(F.count(F.lit(1))).scalar()
    lookup = counts.select(
        "plain", (F.col("copies") > 1).alias("shared"), "copies", total.alias("total")
    )
    return join_lookup(first, lookup, ["plain"], "copies", "total").select(
        "product_id",
        F.when(F.col("shared"), F.format_string("%s (%s)", "plain", "product_id"))
        .otherwise(F.col("plain"))
        .alias("label"),
    )


def product_stats(sales: Sales) -> DataFrame:
    """Units, span, revenue and profit of every product."""
    totals = product_totals(sales)
    name = sales.keyed().groupBy("product_id").agg(
        F.min_by(
            "product_name", F.when(F.col("product_name").isNotNull(), F.col("_ord"))
        ).alias("name")
    )
    missing = F.lit(None).cast("double")
    priced = sales.has("unit_price")
    return totals.join(name, "product_id").select(
        "product_id",
        F.coalesce("name", "product_id").alias("display_name"),
        F.col("quantity").alias("total_units_sold"),
        whole_days(F.col("first_date"), F.col("last_date")).alias("date_range_days"),
        (F.col("revenue") if priced else missing).alias("total_revenue"),
        (F.col("profit") if priced and sales.has("unit_cost") else missing).alias("total_profit"),
    )


def product_daily_demand(sales: Sales) -> DataFrame:
    """Units per product and calendar day."""
    return daily_demand(sales)


def product_eda(sales: Sales, product_id: str) -> DataFrame:
    """The stats row of one product; an id without rows is an error."""
    rows = sales.df.where(F.col("product_id") == product_id)
    if rows.isEmpty():
        raise ValueError(f"no rows for product {product_id!r}")
    return product_stats(Sales(rows, dict(sales.known)))
