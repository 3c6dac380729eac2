"""Inventory KPIs, one row per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.parsing import micros, whole_days
from granary.plans.radix import field_quantiles
from granary.plans.ranking import with_running_totals
from granary.plans.rollups import demand_stats, product_totals, stored_aggregates
from granary.schema import Sales, unavailable
from granary.session import materialize

# Tier and stock thresholds.
ABC_CUTOFFS = (0.80, 0.95)
XYZ_CUTOFFS = (0.5, 1.0)
RECENT_FRACTION = 0.25
SLOW_PERCENTILE = 0.20
DEFAULT_Z = 1.65
SERVICE_LEVEL_Z = {"90%": 1.28, "95%": 1.65, "97.5%": 1.96, "99%": 2.33}


def date_span(totals: DataFrame) -> Column:
    """Struct(first, last) date over all products, from their totals."""
    ends = F.struct(F.min("first_date").alias("first"), F.max("last_date").alias("last"))
    return totals.agg(ends.alias("span")).scalar()


def turnover_of(totals: DataFrame) -> DataFrame:
    return totals.where(F.col("avg_stock") > 0).select(
        "product_id",
        F.col("quantity").alias("total_quantity_sold"),
        F.col("avg_stock").alias("avg_inventory"),
        (F.col("quantity") / F.col("avg_stock")).alias("turnover_ratio"),
        F.when(F.col("min_stock") < F.col("max_stock"), "historical_average")
        .otherwise("single_snapshot_approximation")
        .alias("inventory_data_type"),
    )


def turnover(sales: Sales) -> DataFrame:
    """Units sold over mean stock; empty without stock data."""
    if not sales.has("current_stock"):
        return unavailable(
            sales.df.sparkSession,
            "product_id string, total_quantity_sold double, avg_inventory double, "
            "turnover_ratio double, inventory_data_type string",
        )
    return turnover_of(product_totals(sales))


def days_of_inventory(sales: Sales) -> DataFrame:
    """Latest stock over units per calendar day of the whole table's span."""
    if not sales.has("current_stock"):
        return unavailable(
            sales.df.sparkSession,
            "product_id string, latest_stock double, avg_daily_demand double, "
            "days_of_inventory double",
        )
    return cover_of(product_totals(sales))


def cover_of(totals: DataFrame) -> DataFrame:
    span = date_span(totals)
    days = F.greatest(whole_days(span["first"], span["last"]), F.lit(1))
    return (
        totals.withColumn("avg_daily_demand", F.col("quantity") / days)
        .where(F.col("avg_daily_demand") > 0)
        .select(
            "product_id",
            "latest_stock",
            "avg_daily_demand",
            (F.col("latest_stock") / F.col("avg_daily_demand")).alias("days_of_inventory"),
        )
    )


def abc_tier(share: Column) -> Column:
    a, b = ABC_CUTOFFS
    return F.when(share <= a, "A").when(share <= b, "B").otherwise("C")


def abc_of(totals: DataFrame, basis: str, **bucketing) -> DataFrame:
    value = "revenue" if basis == "revenue" else "quantity"
    ranked = with_running_totals(
        totals.select("product_id", F.col(value).alias("value")),
        [-F.col("value"), F.col("product_id")],
        {"value": "double"},
        **bucketing,
    )
    share = F.try_divide(F.col("value_before") + F.col("value"), F.col("value_total"))
    return ranked.withColumn("cumulative_pct", share).select(
        "product_id",
        "value",
        "cumulative_pct",
        abc_tier(F.col("cumulative_pct")).alias("tier"),
        F.lit(basis).alias("basis"),
    )


def abc_analysis(sales: Sales, **bucketing) -> DataFrame:
    """Pareto tiers by revenue, or by quantity when nothing is priced."""
    basis = "revenue" if sales.has("unit_price") else "quantity_sold"
    return abc_of(product_totals(sales), basis, **bucketing)


def xyz_tier(cv: Column) -> Column:
    x, y = XYZ_CUTOFFS
    return F.when(cv < x, "X").when(cv < y, "Y").when(cv.isNotNull(), "Z")


def xyz_of(stats: DataFrame) -> DataFrame:
    cv = F.col("coefficient_of_variation")
    return (
        stats.where(F.col("mean_daily_demand") > 0)
        .withColumn(
            "coefficient_of_variation", F.col("std_daily_demand") / F.col("mean_daily_demand")
        )
        .select(
            "product_id",
            "mean_daily_demand",
            "std_daily_demand",
            "coefficient_of_variation",
            xyz_tier(cv).alias("xyz_tier"),
        )
    )


def xyz_analysis(sales: Sales) -> DataFrame:
    """Predictability tiers from the variation of active-day demand."""
    return xyz_of(demand_stats(sales))


def buffers_of(stats: DataFrame, z: float, default_lead: float | None) -> DataFrame:
    lead = F.coalesce("lead_time_days", F.lit(default_lead).cast("double"))
    return (
        stats.withColumn("lead_time_days_used", lead)
        .where(F.col("lead_time_days_used").isNotNull())
        .withColumn(
            "safety_stock",
            F.lit(float(z)) * F.col("std_daily_demand") * F.sqrt("lead_time_days_used"),
        )
        .withColumn(
            "reorder_point",
            F.col("mean_daily_demand") * F.col("lead_time_days_used") + F.col("safety_stock"),
        )
    )


def safety_stock(
    sales: Sales, z: float = DEFAULT_Z, default_lead: float | None = None
) -> DataFrame:
    """Buffer for the lead time; products without any lead time are left out."""
    return buffers_of(demand_stats(sales), z, default_lead).select(
        "product_id", "std_daily_demand", "lead_time_days_used", "safety_stock"
    )


def reorder_point(
    sales: Sales, z: float = DEFAULT_Z, default_lead: float | None = None
) -> DataFrame:
    """Lead-time demand plus safety stock, from the same aggregate."""
    return buffers_of(demand_stats(sales), z, default_lead).select(
        "product_id",
        F.col("mean_daily_demand").alias("avg_daily_demand"),
        "lead_time_days_used",
        "safety_stock",
        "reorder_point",
    )


def safety_stock_scenarios(sales: Sales, default_lead: float | None = None) -> DataFrame:
    """Safety stock at each offered service level."""
    levels = F.array(
        *[
            F.struct(F.lit(name).alias("service_level"), F.lit(z).alias("z"))
            for name, z in SERVICE_LEVEL_Z.items()
        ]
    )
    base = safety_stock(sales, 1.0, default_lead)
    return base.select("product_id", "safety_stock", F.inline(levels)).select(
        "product_id", "service_level", (F.col("safety_stock") * F.col("z")).alias("safety_stock")
    )


def idle_of(totals: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Dead and slow stock from totals per product, which should be stored: they are read several times."""
    span = date_span(totals)
    idle = micros(F.col("last_date"), span["last"])
    length = micros(span["first"], span["last"])
    gross = totals.select(F.lit("gross").alias("field"), F.col("gross").alias("value"))
    slow = field_quantiles(gross, {"threshold": SLOW_PERCENTILE})
    return totals.select(
        "product_id",
        *keep,
        F.col("gross").alias("gross_quantity_sold"),
        F.col("returned").alias("returns"),
        F.col("quantity").alias("net_quantity_sold"),
        F.col("last_date").alias("last_sale_date"),
        whole_days(F.col("last_date"), span["last"]).alias("days_since_last_sale"),
        (idle > length * RECENT_FRACTION).alias("is_dead_stock"),
        (F.col("gross") <= slow.select("threshold").scalar()).alias("is_slow_mover"),
    )


def dead_slow_stock(sales: Sales) -> DataFrame:
    """Gross, returned and net units, with dead-stock and slow-mover flags."""
    totals = product_totals(sales).select("product_id", "quantity", "gross", "returned", "first_date", "last_date")
    return idle_of(materialize(totals))


def kpi_summary(
    sales: Sales, z: float = DEFAULT_Z, default_lead: float | None = None
) -> DataFrame:
    """Every per-product KPI in one wide row.

    The two aggregates are written once, so the sales are scanned twice in all,
    and joined once: all but the ranking by value is worked out in their row. A
    KPI that its own operator would leave out is null here.
    """
    totals, stats = stored_aggregates(sales)
    basis = "revenue" if sales.has("unit_price") else "quantity_sold"
    ranked = abc_of(totals, basis, stored=True).select("product_id", F.col("tier").alias("abc_tier"))
    rows = idle_of(totals, keep=("avg_stock", "latest_stock")).join(stats, "product_id", "left").join(ranked, "product_id", "left")
    span = date_span(totals)
    days = F.greatest(whole_days(span["first"], span["last"]), F.lit(1))
    stocked, mean = F.col("avg_stock") > 0, F.col("mean_daily_demand")
    daily = F.col("net_quantity_sold") / days
    cv = F.when(mean > 0, F.col("std_daily_demand") / mean)
    lead = F.coalesce("lead_time_days", F.lit(default_lead).cast("double"))
    safety = F.lit(float(z)) * F.col("std_daily_demand") * F.sqrt(lead)
    return rows.select(
        "product_id", "gross_quantity_sold", "returns", "net_quantity_sold", "last_sale_date",
        "days_since_last_sale", "is_dead_stock", "is_slow_mover",
        F.when(stocked, F.col("avg_stock")).alias("avg_inventory"),
        F.when(stocked, F.col("net_quantity_sold") / F.col("avg_stock")).alias("turnover_ratio"),
        F.when(daily > 0, F.col("latest_stock")).alias("latest_stock"),
        F.when(daily > 0, F.col("latest_stock") / daily).alias("days_of_inventory"),
        "abc_tier",
        cv.alias("coefficient_of_variation"),
        xyz_tier(cv).alias("xyz_tier"),
        safety.alias("safety_stock"),
        (mean * lead + safety).alias("reorder_point"),
    )


def lowest_cover(sales: Sales, top_n: int = 10) -> DataFrame:
    """The products that run out first."""
    return (
        days_of_inventory(sales)
        .where(F.col("days_of_inventory").isNotNull())
        .orderBy("days_of_inventory", "product_id")
        .limit(top_n)
    )


def flagged_stock(sales: Sales) -> DataFrame:
    """Products that are dead stock or slow movers."""
    return dead_slow_stock(sales).where(F.col("is_dead_stock") | F.col("is_slow_mover"))


def tier_counts(sales: Sales) -> DataFrame:
    """How many products fall in each ABC and XYZ tier."""
    abc = abc_analysis(sales).select(F.lit("abc").alias("analysis"), "tier")
    xyz = xyz_analysis(sales).select(F.lit("xyz").alias("analysis"), F.col("xyz_tier").alias("tier"))
    return abc.unionByName(xyz).groupBy("analysis", "tier").agg(F.count(F.lit(1)).alias("products"))
