"""Price elasticity per product, and what a price change would do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.tails import t_tail
from granary.plans.rollups import latest
from granary.schema import Sales, unavailable

# What a regression needs, and the class limits.
MIN_ROWS = 5
MIN_PRICE_VARIATION = 0.05
EXTREME = 5.0
UNAVAILABLE_REASON = (
    "no elasticity: unit_price is missing, or no product's price varies enough"
)
SCHEMA = (
    "product_id string, elasticity_coefficient double, r_squared double, p_value double, "
    "classification string, n_observations bigint"
)


def classify(slope: Column) -> Column:
    return (
        F.when(F.abs(slope) > EXTREME, "suspect_extreme")
        .when(slope > 0, "unexpected_positive")
        .when(F.abs(slope) < 1, "inelastic")
        .otherwise("elastic")
    )


def price_elasticity(sales: Sales) -> DataFrame:
    """Slope of log units on log price, for products with enough price variation."""
    if not sales.has("unit_price"):
        return unavailable(sales.df.sparkSession, SCHEMA)
    x, y = F.ln("unit_price"), F.ln("quantity_sold")
    fits = (
        sales.keyed()
        .where((F.col("quantity_sold") > 0) & (F.col("unit_price") > 0))
        .groupBy("product_id")
        .agg(
            F.count(F.lit(1)).alias("n_observations"),
            F.regr_slope(y, x).alias("slope"),
            F.regr_r2(y, x).alias("fit"),
            (F.min("quantity_sold") == F.max("quantity_sold")).alias("flat"),
            (F.max("unit_price") / F.min("unit_price") - 1).alias("variation"),
        )
        .where((F.col("n_observations") >= MIN_ROWS) & (F.col("variation") >= MIN_PRICE_VARIATION))
    )
    fits = fits.withColumn("r_squared", F.when(F.col("flat"), 0.0).otherwise(F.col("fit")))
    rest = 1 - F.col("r_squared")
    freedom = F.col("n_observations") - 2
    t = F.when(rest > 0, F.sqrt(F.col("r_squared") * freedom / F.when(rest > 0, rest)))
    return fits.select(
        "product_id",
        F.col("slope").alias("elasticity_coefficient"),
        "r_squared",
        F.when(rest <= 0, 0.0).otherwise(t_tail(t, freedom.cast("double"))).alias("p_value"),
        classify(F.col("slope")).alias("classification"),
        "n_observations",
    )


def elasticity_status(sales: Sales) -> DataFrame:
    """One row: whether any elasticity could be estimated, else the reason."""
    return price_elasticity(sales).agg((F.count(F.lit(1)) > 0).alias("available")).select(
        "available", F.when(~F.col("available"), UNAVAILABLE_REASON).alias("reason")
    )


def price_what_if(
    sales: Sales, forecast_units: DataFrame, changes: list[float]
) -> DataFrame:
    """Units and revenue of every product at each price change in percent.

    `forecast_units` has (product_id, baseline_units), the forecast total. The
    current price is the latest by date. Products without an elasticity or a
    forecast are left out.
    """
    prices = sales.keyed().groupBy("product_id").agg(latest(sales, "unit_price").alias("current_price"))
    base = (
        price_elasticity(sales)
        .select("product_id", "elasticity_coefficient")
        .join(prices, "product_id")
        .join(forecast_units, "product_id")
    )
    grid = base.withColumn(
        "price_change_pct", F.explode(F.array(*[F.lit(float(c)) for c in changes]))
    )
    grid = grid.withColumns(
        {
            "new_price": F.col("current_price") * (1 + F.col("price_change_pct") / 100),
            "demand_pct": F.col("elasticity_coefficient") * F.col("price_change_pct"),
        }
    )
    units = F.greatest(F.col("baseline_units") * (1 + F.col("demand_pct") / 100), F.lit(0.0))
    grid = grid.withColumn("units", units).withColumns(
        {
            "before": F.col("baseline_units") * F.col("current_price"),
            "after": F.col("units") * F.col("new_price"),
        }
    )
    change = F.try_divide(F.col("after") - F.col("before"), F.col("before")) * 100
    return grid.select(
        "product_id",
        "elasticity_coefficient",
        "current_price",
        "new_price",
        "price_change_pct",
        "baseline_units",
        F.col("units").alias("projected_units"),
        F.col("demand_pct").alias("projected_demand_change_pct"),
        F.col("before").alias("baseline_revenue"),
        F.col("after").alias("projected_revenue"),
        F.when(F.col("before") > 0, change).otherwise(0.0).alias("revenue_change_pct"),
    )


def rounded_what_if(scenarios: DataFrame) -> DataFrame:
    """The scenarios as shown to people: money to the cent, the rest to one place."""
    places = {
        "new_price": 2, "baseline_units": 1, "projected_units": 1,
        "projected_demand_change_pct": 1, "baseline_revenue": 2, "projected_revenue": 2,
        "revenue_change_pct": 1,
    }
    return scenarios.withColumns({name: F.round(name, n) for name, n in places.items()})
