"""The registered queries: every operator over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import (
    cleaning, eda, elasticity, forecasting, kpis, mapping, recommendations, report, risk,
    seasonality, statistics, stockout, validation,
)
from granary.schema import Sales, field_availability
from granary.session import configure, materialize
from granary.sources import readers, results
from workload import views
from workload.present import present

QUERIES = {}


def query(name: str, **places):
    """Register a function (spark, sf_dir) -> DataFrame under `name`."""

    def register(build):
        def run(spark, sf_dir):
            return present(build(configure(spark), sf_dir), **places)

        QUERIES[name] = run
        return build

    return register


def on_sales(name: str, operator, view=views.sales, **places):
    query(name, **places)(lambda spark, sf_dir: operator(view(spark, sf_dir)))


# Canonical table
query("canonical_sales", places=None)(lambda s, d: views.sales(s, d).df.drop("_ord"))
query("mapped_sales", places=None)(
    lambda s, d: mapping.apply_mapping(
        views.raw_sales(s, d), mapping.FieldMapping(views.RAW_HEADERS, confirmed=True)
    ).df.drop("_ord")
)
query("field_availability")(lambda s, d: field_availability(views.sales(s, d).df))
query("field_availability_minimal")(lambda s, d: field_availability(views.sales_minimal(s, d).df))

# KPIs
on_sales("turnover", kpis.turnover)
on_sales("days_of_inventory", kpis.days_of_inventory)
on_sales("abc_analysis", kpis.abc_analysis, value=2)
on_sales("abc_analysis_minimal", kpis.abc_analysis, views.sales_minimal)
on_sales("xyz_analysis", kpis.xyz_analysis)
on_sales("safety_stock", kpis.safety_stock)
on_sales("reorder_point", kpis.reorder_point)
query("reorder_point_minimal")(
    lambda s, d: kpis.reorder_point(views.sales_minimal(s, d), default_lead=7)
)
on_sales("safety_stock_scenarios", kpis.safety_stock_scenarios)
on_sales("dead_slow_stock", kpis.dead_slow_stock, views.sales_returns)
on_sales("dead_slow_stock_events", kpis.dead_slow_stock, views.events_sales)
on_sales("kpi_summary", kpis.kpi_summary)
on_sales("lowest_cover", kpis.lowest_cover)
on_sales("flagged_stock", kpis.flagged_stock, views.sales_returns)
on_sales("tier_counts", kpis.tier_counts)

# Exploration
on_sales("demand_over_time", eda.demand_over_time)
on_sales("revenue_by_category", eda.revenue_by_category, revenue=2)
on_sales("top_products", eda.top_products)
on_sales("trending_products", eda.trending_products)
on_sales("trending_products_launches", lambda x: eda.trending_products(x, top_n=60), views.sales_launches)
on_sales("distribution_summary", eda.distribution_summary)
on_sales("product_distribution", eda.product_distribution)
on_sales("outlier_points", eda.outlier_points)
on_sales("eda_stats", eda.eda_stats, total_revenue=2)
on_sales("eda_overview", eda.eda_overview, total_revenue=2)
on_sales("eda_overview_events", eda.eda_overview, views.events_sales)
on_sales("product_labels", eda.product_labels)
on_sales("product_stats", eda.product_stats, total_revenue=2, total_profit=2)
on_sales("product_daily_demand", eda.product_daily_demand, views.sales_returns)

# Validation and cleaning
AS_OF = "2001-06-01 00:00:00"


def _issues(spark, sf_dir):
    rows = views.sales_dirty(spark, sf_dir)
    return validation.validation_issues(rows, F.lit(AS_OF).cast("timestamp_ntz")).drop("message")


query("validation_issues")(_issues)
for _check in (
    "product_id_missing", "quantity_sold_not_numeric", "unit_cost_not_numeric", "dates_in_future",
    "dates_absurdly_old", "negative_quantity_sold",
):
    query(f"check_{_check}")(
        lambda s, d, name=_check: validation.scalar_issues(
            views.sales_dirty(s, d), F.lit(AS_OF).cast("timestamp_ntz")
        ).where(F.col("check_name") == name).drop("message")
    )
for _check in ("unit_price_outliers", "warehouse_id_rare_values"):
    query(f"check_{_check}")(
        lambda s, d, name=_check: _issues(s, d).where(F.col("check_name") == name)
    )
for _check in ("date_parseable", "unit_price_negative", "unit_cost_negative"):
    query(f"check_{_check}")(
        lambda s, d, name=_check: validation.scalar_issues(
            views.sales_unreadable(s, d), F.lit(AS_OF).cast("timestamp_ntz")
        ).where(F.col("check_name") == name).drop("message")
    )
on_sales(
    "check_minimum_date_span",
    lambda x: validation.scalar_issues(x.df, F.lit(AS_OF).cast("timestamp_ntz"))
    .where("check_name = 'minimum_date_span'").drop("message"),
    views.events_sales,
)
for _name, _view in (("data_gate", views.sales), ("data_gate_short", views.events_sales)):
    on_sales(_name, lambda x: cleaning.data_gate(x.df).withColumn("reasons", F.concat_ws("; ", "reasons")), _view)
query("outlier_bounds")(lambda s, d: validation.outlier_bounds(views.sales_dirty(s, d)))
query("rare_values")(lambda s, d: validation.rare_values(views.sales_dirty(s, d)))
query("record_violations")(lambda s, d: validation.record_violations(views.sales_dirty(s, d)))
query("cleaned_rows")(lambda s, d: cleaning.clean(views.sales_dirty(s, d)).sales.df.drop("_ord"))
query("cleaning_actions")(
    lambda s, d: cleaning.cleaning_actions(views.sales_dirty(s, d)).drop("message")
)
query("clean_log")(lambda s, d: cleaning.clean(views.sales_dirty(s, d)).actions.drop("message"))
query("cleaning_row_counts")(lambda s, d: cleaning.row_counts(views.sales_dirty(s, d)))

# Sources and mapping
query("load_summary")(
    lambda s, d: readers.load_summary(
        readers.read_source(s, f"{d}/lineitem.parquet"), "lineitem", "parquet"
    )
)
query("dataset_fingerprint")(
    lambda s, d: results.dataset_fingerprint(views.table(s, d, "lineitem"))
)
query("normalize_names")(
    lambda s, d: views.catalogue(s, d).withColumn(
        "normalized", mapping.normalize_name(F.col("raw_column"))
    )
)
query("column_scores")(lambda s, d: mapping.column_scores(views.catalogue(s, d)))
query("mapping_rivals")(lambda s, d: mapping.mapping_rivals(views.catalogue(s, d)))
query("unmapped_columns")(
    lambda s, d: mapping.unmapped_columns(views.catalogue(s, d), mapping.suggest_mappings(views.catalogue(s, d)))
)
query("suggest_mappings")(lambda s, d: mapping.suggest_mappings(views.catalogue(s, d)))

# Statistics
on_sales("descriptive_stats", statistics.descriptive_stats)
on_sales("pearson", lambda x: statistics.pearson(x).drop("pearson_p_value"))
on_sales("pearson_p_values", lambda x: statistics.pearson(x))
on_sales("spearman", lambda x: statistics.spearman(x).drop("spearman_p_value"))
on_sales("all_correlations", lambda x: statistics.all_correlations(x).drop("pearson_p_value", "spearman_p_value", "interpretation"))
on_sales("correlation_matrix", statistics.correlation_matrix)
on_sales(
    "mann_whitney",
    lambda x: statistics.compare_groups(x, "category", "ECONOMY", "PROMO").select(
        "group_a", "group_b", "n_a", "n_b", "mean_a", "mean_b", "u_statistic"
    ),
    u_statistic=1,
)
on_sales(
    "top_two_groups",
    lambda x: statistics.compare_largest_groups(x, "category").select(
        "group_a", "group_b", "n_a", "n_b", "mean_a", "mean_b", "u_statistic"
    ),
    u_statistic=1,
)
on_sales("group_tests", statistics.group_tests, u_statistic=1)
on_sales("normality", lambda x: statistics.normality(x).drop("p_value"))
on_sales("normality_p_values", statistics.normality)
on_sales("histogram", statistics.histogram, views.events_sales)
on_sales("histogram_sales", lambda x: statistics.histogram(x).select("field", "bin", "rows"))
on_sales("normal_curve", statistics.normal_curve)

# Price elasticity
on_sales("price_elasticity", lambda x: elasticity.price_elasticity(x).drop("p_value"))
on_sales("price_elasticity_p_values", elasticity.price_elasticity)
on_sales("elasticity_status", elasticity.elasticity_status)

# Stockouts
on_sales("daily_stock", stockout.daily_stock, views.sales_brand)
on_sales("stock_readings", stockout.stock_readings)
on_sales("stockout_events", stockout.stockout_events)
on_sales("stockout_counts", stockout.stockout_counts)
on_sales("ml_gate", stockout.ml_gate)
on_sales("snapshots", stockout.snapshots)
on_sales("risk_features", lambda x: stockout.feature_table(x).drop("stockout_occurred"))
on_sales("feature_table", stockout.feature_table)

# Seasonality and forecasting
on_sales("seasonality", lambda x: seasonality.seasonality(x).drop("interpretation"))
on_sales("seasonality_events", lambda x: seasonality.seasonality(x).drop("interpretation"), views.events_sales)
on_sales("product_seasonality", lambda x: seasonality.product_seasonality(x).drop("interpretation"), views.sales_brand)
on_sales("seasonal_period", seasonality.seasonal_periods)
on_sales("daily_series", forecasting.daily_series, views.sales_brand)
on_sales("backtest_mae", forecasting.backtest_naive)
on_sales("forecast_naive", lambda x: forecasting.forecast_points(forecasting.naive_forecasts(x)))
on_sales("model_selection", lambda x: forecasting.model_selection(x).drop("series"), views.sales_brand)
on_sales("forecast_summary", lambda x: forecasting.forecast_summary(forecasting.forecasts(x)), views.sales_brand)
def _choices(x: Sales):
    """What a stored forecast must hold whatever the models say: the baseline's error, the least as winner."""
    fitted = forecasting.stored_forecasts(x).where("error IS NULL")
    least = F.array_min(F.map_values("all_scores"))
    return fitted.select(
        "product_id", F.col("all_scores")["naive"].alias("naive_mae"),
        ((F.col("test_mae") == least) & (F.col("all_scores")[F.col("technique_used")] == least)).alias("is_least"),
        F.size("forecast").alias("days"),
    )


on_sales("stored_forecasts", _choices, views.sales_brand)
on_sales("forecast_points", lambda x: forecasting.forecast_points(forecasting.forecasts(x)), views.sales_brand)
on_sales("forecast_summary_products", lambda x: forecasting.forecast_summary(forecasting.forecasts(x)))
WHAT_IF_CHANGES = [-50, -20, -10, -5, 5, 10, 20, 50]
on_sales(
    "price_what_if",
    lambda x: elasticity.price_what_if(
        x, forecasting.forecast_units(forecasting.naive_forecasts(x)), WHAT_IF_CHANGES
    ),
    baseline_revenue=4,
    projected_revenue=4,
)

# Risk and recommendations


def _rule_risk(x: Sales):
    return recommendations.rule_based_risk(x, forecasting.naive_forecasts(x))


def _advice(x: Sales):
    return recommendations.recommendations(x, _rule_risk(x)).drop("reasoning", "source_signals")


on_sales("rule_based_risk", _rule_risk)
on_sales("risk_ranking", lambda x: recommendations.by_risk(_rule_risk(x)))
on_sales("recommendations", _advice, views.sales_returns)
for _name, _actions in {
    "rec_reorder": ["increase_inventory"],
    "rec_reduce": ["reduce_inventory"],
    "rec_discount": ["discount"],
    "rec_safety_stock": ["increase_safety_stock"],
    "rec_price": ["consider_price_increase", "consider_price_decrease"],
}.items():
    on_sales(
        _name,
        lambda x, actions=_actions: _advice(x).where(F.col("action").isin(actions)),
        views.sales_returns,
    )
on_sales("recommendations_high", lambda x: recommendations.by_priority(_advice(x), "high"), views.sales_returns)


def _signals(x: Sales):
    """What each recommendation rests on: numbers, or a word where there is none."""
    advice = recommendations.recommendations(x, _rule_risk(x))
    value = F.col("value")
    return advice.select("product_id", "rule", F.explode("source_signals").alias("signal", "value")).select(
        "product_id", "rule", "signal", value.try_cast("double").alias("number"),
        F.when(value.try_cast("double").isNull(), value).alias("word"),
    )


on_sales("recommendation_signals", _signals, views.sales_returns, number=4)


def _report(x: Sales, write):
    """Reports read risk and advice several times, so both are written once."""
    risks = materialize(_rule_risk(x))
    return write(x, risks, materialize(recommendations.recommendations(x, risks)))


on_sales("executive_facts", lambda x: _report(x, report.executive_facts), views.sales_returns)
on_sales(
    "product_facts", lambda x: _report(x, report.product_report).drop("reasoning"), views.sales_returns
)
on_sales("risk_model_metrics", lambda x: risk.inventory_ml(x).metrics)
on_sales("risk_table", lambda x: risk.risk_table(risk.inventory_ml(x)))
on_sales("risk_explanations", lambda x: risk.risk_explanations(risk.inventory_ml(x)))
on_sales(
    "recommendations_ml",
    lambda x: recommendations.recommendations(
        x, recommendations.risk_assessment(x, forecasting.naive_forecasts(x))
    ),
)
