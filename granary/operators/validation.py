"""Report-only data checks: every check is counted, no row is changed.

All scalar checks come from one aggregate over the table; outliers need the
quartiles first and so a second pass, over distinct values; rare categories are
one aggregation per categorical field.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.parsing import to_datetime, to_number, whole_days
from granary.plans.box import fences
from granary.plans.radix import field_quantiles
from granary.plans.ranking import value_counts
from granary.schema import CATEGORICAL_FIELDS, NUMERIC_FIELDS, REQUIRED_FIELDS

# Thresholds of the checks.
MIN_ROWS = 50
MIN_SPAN_DAYS = 30
MAX_MISSING_SHARE = 0.5
EARLIEST_SANE = "1990-01-01 00:00:00"
RARE_SHARE = 0.01
PRICE_FIELDS = ["unit_price", "unit_cost"]
ISSUE_SCHEMA = (
    "position int, check_name string, severity string, message string, "
    "affected_field string, affected_row_count bigint"
)


def typed_columns(df: DataFrame) -> DataFrame:
    """Raw columns next to their parsed forms `_date` and `_<field>`."""
    parsed = {"_date": to_datetime(df, "date")}
    parsed |= {f"_{f}": to_number(df, f) for f in NUMERIC_FIELDS if f in df.columns}
    return df.withColumns(parsed)


def _issue(position, name, severity, message, field, rows, when) -> Column:
    """An issue struct where `when` holds, else null."""
    return F.when(
        when,
        F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("check_name"),
            (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
            message.alias("message"),
            F.lit(field).cast("string").alias("affected_field"),
            rows.cast("bigint").alias("affected_row_count"),
        ),
    )


def count_columns(columns: Sequence[str], as_of: Column | None = None) -> list[Column]:
    """Every count the single-pass checks need, as aggregates over `typed_columns`."""
    now = F.current_timestamp() if as_of is None else as_of
    now = now.cast("timestamp_ntz")
    counts = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_date").isNull()).alias("date_unparsed"),
        F.min("_date").alias("first"),
        F.max("_date").alias("last"),
        F.count_if(F.col("_date") > now).alias("date_future"),
        F.count_if(F.col("_date") < F.lit(EARLIEST_SANE).cast("timestamp_ntz")).alias("date_old"),
    ]
    for f in REQUIRED_FIELDS:
        counts.append(F.count_if(F.col(f).isNull()).alias(f"{f}_missing"))
    for f in NUMERIC_FIELDS:
        if f in columns:
            bad = F.col(f).isNotNull() & F.col(f"_{f}").isNull()
            counts.append(F.count_if(bad).alias(f"{f}_bad"))
            counts.append(F.count_if(F.col(f"_{f}") < 0).alias(f"{f}_negative"))
    return counts


def scalar_counts(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row with every count the single-pass checks need."""
    return typed_columns(df).agg(*count_columns(df.columns, as_of))


def scalar_issues(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The checks that need one pass only, as issue rows."""
    return issues_of(scalar_counts(df, as_of), df.columns)


def issues_of(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Issue rows from the one row of counts of a table with these columns."""
    rows = F.col("rows")

    def share(c):
        return F.coalesce(F.try_divide(c, rows), F.lit(0.0))

    issues = [
        _issue(
            1, "minimum_row_count", "error",
            F.format_string(f"%d rows; at least {MIN_ROWS} are needed", rows),
            None, rows, rows < MIN_ROWS,
        ),
        _issue(
            2, "date_parseable", "error",
            F.format_string("%d of %d rows have no readable date", F.col("date_unparsed"), rows),
            "date", F.col("date_unparsed"), share(F.col("date_unparsed")) > MAX_MISSING_SHARE,
        ),
        _issue(
            3, "minimum_date_span", "error",
            F.format_string(
                f"the dates span %d days; at least {MIN_SPAN_DAYS} are needed",
                whole_days(F.col("first"), F.col("last")),
            ),
            "date", F.lit(0), whole_days(F.col("first"), F.col("last")) < MIN_SPAN_DAYS,
        ),
    ]
    for i, f in enumerate(REQUIRED_FIELDS):
        missing = F.col(f"{f}_missing")
        severity = F.when(share(missing) > MAX_MISSING_SHARE, "error").otherwise("warning")
        issues.append(
            _issue(
                4 + i, f"{f}_missing", severity,
                F.format_string(f"%d of %d rows have no {f}", missing, rows), f, missing, missing > 0,
            )
        )
    for i, f in enumerate(NUMERIC_FIELDS):
        if f in columns:
            bad = F.col(f"{f}_bad")
            issues.append(
                _issue(
                    7 + i, f"{f}_not_numeric", "error",
                    F.format_string(f"%d rows have a {f} that is no number", bad), f, bad, bad > 0,
                )
            )
    warnings = [
        (11, "dates_in_future", "date", "date_future", "%d rows have a date in the future"),
        (12, "dates_absurdly_old", "date", "date_old", "%d rows are dated before 1990"),
        (13, "negative_quantity_sold", "quantity_sold", "quantity_sold_negative",
         "%d rows have negative units; returns or errors"),
    ]
    warnings += [
        (14 + i, f"{f}_negative", f, f"{f}_negative", f"%d rows have a negative {f}")
        for i, f in enumerate(PRICE_FIELDS)
        if f in columns
    ]
    for position, name, field, count, text in warnings:
        issues.append(
            _issue(
                position, name, "warning", F.format_string(text, F.col(count)),
                field, F.col(count), F.col(count) > 0,
            )
        )
    return counts.select(F.inline(F.filter(F.array(*issues), lambda x: x.isNotNull())))


def outlier_bounds(df: DataFrame) -> DataFrame:
    """Quartiles, fences and the number of rows outside them, per numeric field."""
    typed = typed_columns(df)
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("value"))
            for f in NUMERIC_FIELDS
            if f in df.columns
        ]
    )
    values = typed.select(F.inline(pairs)).where(F.col("value").isNotNull())
    # One row per numeric field, four at most.
    limits = F.broadcast(fences(field_quantiles(values, {"q1": 0.25, "q3": 0.75})))
    outside = ~F.col("value").between(F.col("lower_fence"), F.col("upper_fence"))
    return (
        values.join(limits, "field")
        .groupBy("field", "q1", "q3", "lower_fence", "upper_fence", "n")
        .agg(F.count_if(outside).alias("outliers"))
    )


def rare_values(df: DataFrame) -> DataFrame:
    """Category and warehouse values held by under one percent of the field's rows."""
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
            for f in CATEGORICAL_FIELDS
            if f in df.columns
        ]
    )
    counts = value_counts(df.select(F.inline(pairs)), "value", ["field"])
    # One row per categorical field, two at most.
    totals = F.broadcast(counts.groupBy("field").agg(F.sum("copies").alias("field_rows")))
    return (
        counts.join(totals, "field")
        .where(F.col("copies") < F.col("field_rows") * RARE_SHARE)
        .select("field", "value", F.col("copies").alias("rows"))
    )


def _position(base: int, fields: list[str]) -> Column:
    return reduce(
        lambda acc, pair: acc.when(F.col("field") == pair[1], base + pair[0]),
        enumerate(fields[1:], 1),
        F.when(F.col("field") == fields[0], base),
    )


def validation_issues(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """All checks as issue rows, numbered in their fixed order.

    `as_of` is what counts as now (default: the current time). The table is valid
    when no issue is an error.
    """
    outliers = outlier_bounds(df).where(F.col("outliers") > 0).select(
        _position(16, NUMERIC_FIELDS).alias("position"),
        F.concat("field", F.lit("_outliers")).alias("check_name"),
        F.lit("warning").alias("severity"),
        F.format_string(
            "%d rows have a %s outside %.2f to %.2f",
            "outliers", "field", "lower_fence", "upper_fence",
        ).alias("message"),
        F.col("field").alias("affected_field"),
        F.col("outliers").alias("affected_row_count"),
    )
    rare = (
        rare_values(df)
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("values"), F.sum("rows").alias("rows"))
        .select(
            _position(20, CATEGORICAL_FIELDS).alias("position"),
            F.concat("field", F.lit("_rare_values")).alias("check_name"),
            F.lit("warning").alias("severity"),
            F.format_string(
                "%d values of %s are each in under 1%% of rows", "values", "field"
            ).alias("message"),
            F.col("field").alias("affected_field"),
            F.col("rows").alias("affected_row_count"),
        )
    )
    return scalar_issues(df, as_of).unionByName(outliers).unionByName(rare)


def record_violations(df: DataFrame) -> DataFrame:
    """Rows that break the row contract: negative units, price, cost, stock or lead time."""
    rules = ["quantity_sold", "unit_price", "unit_cost", "current_stock", "lead_time_days"]
    counts = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("field"),
                    F.count_if(to_number(df, f) < 0).alias("violations"),
                )
                for f in rules
                if f in df.columns
            ]
        ).alias("counts")
    )
    return counts.select(F.inline("counts"))
