"""Rule-based risk and prioritised recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.parsing import whole_days
from granary.operators.eda import product_labels
from granary.operators.elasticity import price_elasticity
from granary.operators.kpis import (
    DEFAULT_Z,
    cover_of,
    date_span,
    idle_of,
    xyz_of,
    xyz_tier,
)
from granary.operators.risk import inventory_ml, risk_table
from granary.plans.rollups import stored_aggregates
from granary.schema import Sales
from granary.sources.results import ResultStore

# Cover limits in days, risk score limits, order of priorities.
SHORT_COVER = 7
MEDIUM_COVER = 14
OVERSTOCK_COVER = 90
HIGH_SCORE = 4
MEDIUM_SCORE = 2
PRIORITIES = ["high", "medium", "low"]
RISK_SCHEMA = ["product_id", "risk_label", "risk_score", "method"]


def rule_based_risk(sales: Sales, fitted: DataFrame) -> DataFrame:
    """Cover, predictability and trend added up to a risk label.

    `fitted` has (product_id, forecast). Products need both a cover and a tier; a
    missing forecast adds nothing.
    """
    totals, stats = stored_aggregates(sales)
    cover = cover_of(totals).where(F.lit(sales.has("current_stock"))).select("product_id", "days_of_inventory")
    tiers = xyz_of(stats).select("product_id", "xyz_tier")
    rising = fitted.select(
        "product_id",
        (F.element_at("forecast", -1) > F.element_at("forecast", 1)).alias("rising"),
    )
    days = F.col("days_of_inventory")
    from_cover = F.when(days <= SHORT_COVER, 2).when(days <= MEDIUM_COVER, 1).otherwise(0)
    from_tier = F.when(F.col("xyz_tier") == "Z", 2).when(F.col("xyz_tier") == "Y", 1).otherwise(0)
    from_trend = F.when(F.col("rising"), 1).otherwise(0)
    score = F.col("risk_score")
    label = F.when(score >= HIGH_SCORE, "high").when(score >= MEDIUM_SCORE, "medium").otherwise("low")
    return (
        cover.join(tiers, "product_id")
        .join(rising, "product_id", "left")
        .withColumn("risk_score", (from_cover + from_tier + from_trend).cast("double"))
        .select(
            "product_id",
            label.alias("risk_label"),
            "risk_score",
            F.lit("rule_based").alias("method"),
            "days_of_inventory",
            "xyz_tier",
        )
    )


def risk_assessment(
    sales: Sales, fitted: DataFrame, store: ResultStore | None = None
) -> DataFrame:
    """The classifier's risk where it can be trained, else the rules'."""
    trained = inventory_ml(sales, store)
    if trained.available:
        return risk_table(trained)
    return rule_based_risk(sales, fitted).select(*RISK_SCHEMA)


def product_facts(
    sales: Sales, risk: DataFrame, z: float = DEFAULT_Z, default_lead: float | None = None
) -> DataFrame:
    """One wide row per product with everything the rules look at.

    Totals and daily statistics are written once and joined once; what follows
    from them is worked out in their row.
    """
    totals, stats = stored_aggregates(sales)
    span = date_span(totals)
    daily = F.col("net_quantity_sold") / F.greatest(whole_days(span["first"], span["last"]), F.lit(1))
    covered = (daily > 0) & F.lit(sales.has("current_stock"))
    mean, std = F.col("mean_daily_demand"), F.col("std_daily_demand")
    lead = F.coalesce("lead_time_days", F.lit(default_lead).cast("double"))
    rows = idle_of(totals, keep=("latest_stock",)).join(stats, "product_id", "left").select(
        "product_id", "gross_quantity_sold", "days_since_last_sale", "is_dead_stock", "is_slow_mover",
        F.when(covered, F.col("latest_stock")).alias("latest_stock"),
        F.when(covered, F.col("latest_stock") / daily).alias("days_of_inventory"),
        F.when(covered, True).alias("has_cover"),
        (mean * lead + F.lit(float(z)) * std * F.sqrt(lead)).alias("reorder_point"),
        F.coalesce(xyz_tier(F.when(mean > 0, std / mean)), F.lit("Y")).alias("xyz_tier"),
    )
    prices = price_elasticity(sales).select(
        "product_id", "elasticity_coefficient", "r_squared", "classification"
    )
    wide = product_labels(sales).withColumnRenamed("label", "display_name")
    for part in (risk.select("product_id", "risk_label", "risk_score"), rows, prices):
        wide = wide.join(part, "product_id", "left")
    return wide


def _advice(
    number: int, action, priority, reasoning: Column, signals: list[str], when: Column
) -> Column:
    pairs = [x for s in signals for x in (F.lit(s), F.col(s).cast("string"))]
    return F.when(
        when,
        F.struct(
            F.lit(number).alias("rule"),
            (action if isinstance(action, Column) else F.lit(action)).alias("action"),
            reasoning.alias("reasoning"),
            (priority if isinstance(priority, Column) else F.lit(priority)).alias("priority"),
            F.create_map(*pairs).alias("source_signals"),
        ),
    )


def _rules(stock_known: bool) -> list[Column]:
    elevated = F.col("risk_label").isin("high", "medium")
    covered = F.col("risk_label").isNotNull() & F.coalesce("has_cover", F.lit(False))
    elastic = F.col("classification") == "elastic"
    return [
        _advice(
            1, "increase_inventory",
            F.when(F.col("risk_label") == "high", "high").otherwise("medium"),
            F.format_string(
                "stock of %.0f is at or below the reorder point of %.0f and the risk is %s",
                "latest_stock", "reorder_point", "risk_label",
            ),
            ["days_of_inventory", "reorder_point"],
            covered & elevated & (F.col("latest_stock") <= F.col("reorder_point")),
        ),
        _advice(
            2, "reduce_inventory", "medium",
            F.format_string(
                "%.0f days of inventory is much for predictable demand", "days_of_inventory"
            ),
            ["days_of_inventory", "xyz_tier"],
            covered & (F.col("days_of_inventory") >= OVERSTOCK_COVER) & (F.col("xyz_tier") != "Z"),
        ),
        _advice(
            3, "increase_safety_stock", "medium",
            F.lit("demand is erratic and the risk is elevated: the buffer may be too thin"),
            ["xyz_tier", "risk_label"],
            F.lit(stock_known) & elevated & (F.col("xyz_tier") == "Z"),
        ),
        _advice(
            4, "discount", "low",
            F.when(F.col("is_dead_stock"), "dead stock: no recent sales").otherwise(
                "slow mover: among the bottom fifth by units sold"
            ),
            ["days_since_last_sale", "gross_quantity_sold"],
            F.col("is_dead_stock") | F.col("is_slow_mover"),
        ),
        _advice(
            5,
            F.when(elastic, "consider_price_decrease").otherwise("consider_price_increase"),
            "low",
            F.format_string(
                "demand is %s (%.2f): %s the price should raise revenue, going by past prices",
                "classification", "elasticity_coefficient",
                F.when(elastic, "lowering").otherwise("raising"),
            ),
            ["elasticity_coefficient", "r_squared"],
            F.col("classification").isin("elastic", "inelastic"),
        ),
    ]


def recommendations(
    sales: Sales, risk: DataFrame, z: float = DEFAULT_Z, default_lead: float | None = None
) -> DataFrame:
    """Every rule on every product, in no order; `ranked` sorts for presentation.

    Reorder advice needs lead times, in the data or as `default_lead`. A missing
    stock or cover never triggers a rule.
    """
    advice = F.filter(
        F.array(*_rules(sales.has("current_stock"))), lambda a: a.isNotNull()
    )
    return product_facts(sales, risk, z, default_lead).select("product_id", "display_name", F.inline(advice))


def ranked(advice: DataFrame) -> DataFrame:
    """Recommendations by priority, product and rule."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    return advice.orderBy(rank, "product_id", "rule")


def by_priority(advice: DataFrame, priority: str) -> DataFrame:
    return advice.where(F.col("priority") == priority)


def by_risk(risk: DataFrame) -> DataFrame:
    """Risk rows, the highest first."""
    return risk.orderBy(F.desc("risk_score"), "product_id")
