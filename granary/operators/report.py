"""The facts that written reports are filled with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.eda import product_labels
from granary.operators.kpis import days_of_inventory
from granary.operators.recommendations import PRIORITIES
from granary.schema import Sales

NO_ADVICE = "no action recommended"
NOTHING_URGENT = "no recommendations"


def _rank():
    return F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))


def executive_facts(sales: Sales, risk: DataFrame, advice: DataFrame, top_n: int = 3) -> DataFrame:
    """One row: products, high risks, discount advice, all advice, and the top lines."""
    products = sales.keyed().agg(F.count_distinct("product_id").alias("total_products"))
    high = risk.agg(F.count_if(F.col("risk_label") == "high")).scalar()
    counts = advice.agg(
        F.struct(
            F.count_if(F.col("action") == "discount").alias("discounts"),
            F.count(F.lit(1)).alias("all"),
        )
    ).scalar()
    top = advice.select(
        _rank().alias("rank"), "product_id", "rule", "display_name", "action", "priority"
    ).orderBy("rank", "product_id", "rule").limit(top_n)
    lines = top.agg(
        F.sort_array(
            F.collect_list(F.struct("rank", "product_id", "rule", "display_name", "action", "priority"))
        ).alias("lines")
    ).select(
        F.concat_ws(
            "\n",
            F.transform(
                "lines",
                lambda x, i: F.format_string(
                    "%d. %s: %s (%s priority)", i + 1, x["display_name"], x["action"], x["priority"]
                ),
            ),
        ).alias("text")
    ).scalar()
    return products.select(
        "total_products",
        high.alias("high_risk_count"),
        counts.alias("c"),
        F.when(F.length(lines) > 0, lines).otherwise(NOTHING_URGENT).alias("top_recommendations"),
    ).select(
        "total_products",
        "high_risk_count",
        F.col("c.discounts").alias("dead_stock_count"),
        F.col("c.all").alias("total_recommendations"),
        "top_recommendations",
    )


def product_report(sales: Sales, risk: DataFrame, advice: DataFrame) -> DataFrame:
    """Per product: risk, cover and its first recommendation, with words for what is missing."""
    first = advice.groupBy("product_id").agg(
        F.min(F.struct(_rank().alias("rank"), "rule", "action", "reasoning", "priority")).alias("a")
    )
    cover = days_of_inventory(sales).select("product_id", "days_of_inventory")
    return (
        product_labels(sales)
        .join(risk.select("product_id", "risk_label", "risk_score"), "product_id", "left")
        .join(cover, "product_id", "left")
        .join(first, "product_id", "left")
        .select(
            "product_id",
            F.col("label").alias("display_name"),
            F.coalesce("risk_label", F.lit("unknown")).alias("risk_label"),
            "risk_score",
            "days_of_inventory",
            F.coalesce("a.action", F.lit("none")).alias("action"),
            F.coalesce("a.reasoning", F.lit(NO_ADVICE)).alias("reasoning"),
        )
    )
