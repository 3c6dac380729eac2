"""Cleaning: coerce types, drop unusable rows, log what was done."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.parsing import to_datetime, to_number, whole_days
from granary.operators.validation import (
    MIN_ROWS,
    MIN_SPAN_DAYS,
    count_columns,
    issues_of,
    scalar_counts,
    typed_columns,
)
from granary.schema import CANONICAL_FIELDS, ORDER_COLUMN, REQUIRED_FIELDS, Sales
from granary.session import materialize

OPTIONAL_NUMBERS = ["unit_price", "unit_cost", "current_stock", "lead_time_days"]


class InsufficientDataError(ValueError):
    """The table is too small or too short to be of use."""

    def __init__(self, reasons: list[str]):
        self.reasons = reasons
        super().__init__("; ".join(reasons))


@dataclass
class Cleaned:
    sales: Sales
    actions: DataFrame
    issues: DataFrame


def data_gate(df: DataFrame) -> DataFrame:
    """One row: rows, days the dates span, whether both suffice, and the reasons where not.

    Without a single readable date the span is null and gives no reason of its own;
    the rows without a date are then dropped one by one.
    """
    return _gate_of(scalar_counts(df))


def _gate_of(counts: DataFrame) -> DataFrame:
    counts = counts.select("rows", whole_days(F.col("first"), F.col("last")).alias("days"))
    reasons = F.filter(
        F.array(
            F.when(F.col("rows") < MIN_ROWS, F.format_string(f"%d rows; at least {MIN_ROWS} are needed", "rows")),
            F.when(
                F.col("days") < MIN_SPAN_DAYS,
                F.format_string(f"%d days of data; at least {MIN_SPAN_DAYS} are needed", "days"),
            ),
        ),
        lambda r: r.isNotNull(),
    )
    return counts.select("rows", "days", (F.size(reasons) == 0).alias("enough"), reasons.alias("reasons"))


def _tagged(df: DataFrame) -> DataFrame:
    """Parsed columns, with the first reason to drop the row (null: keep)."""
    typed = typed_columns(df)
    others = {f"_{f}": to_number(df, f) for f in OPTIONAL_NUMBERS if f in df.columns and f"_{f}" not in typed.columns}
    reason = (
        F.when(F.col("_date").isNull(), "date_parseable")
        .when(
            F.col("product_id").isNull() | F.col("quantity_sold").isNull(),
            "required_field_missing",
        )
        .when(F.col("_quantity_sold").isNull(), "quantity_sold_not_numeric")
    )
    return typed.withColumns(others).withColumn("_reason", reason)


def cleaned_rows(df: DataFrame) -> DataFrame:
    """The rows that survive, on canonical types; optional bad values become null."""
    columns = []
    for name, dtype, _, _ in CANONICAL_FIELDS:
        if name not in df.columns:
            continue
        if name == "date":
            source = to_datetime(df, name)
        elif name == "quantity_sold" or name in OPTIONAL_NUMBERS:
            source = to_number(df, name)
        else:
            source = F.col(name)
        columns.append(source.cast(dtype).alias(name))
    if ORDER_COLUMN in df.columns:
        columns.append(F.col(ORDER_COLUMN))
    return df.select(*columns).dropna(subset=REQUIRED_FIELDS)


def _actions(columns: Sequence[str]) -> list[tuple[str, str, str | None, str, Column]]:
    """(name, action, field, text, count over `_tagged`) of everything cleaning may do."""
    kept = F.col("_reason").isNull()
    dropped = [
        ("date_parseable", "date", "rows dropped: no readable date"),
        ("required_field_missing", None, "rows dropped: a required field is missing"),
        ("quantity_sold_not_numeric", "quantity_sold", "rows dropped: units are no number"),
    ]
    entries = [
        (name, "dropped_rows", field, text, F.count_if(F.col("_reason") == name))
        for name, field, text in dropped
    ]
    return entries + [
        (
            f"{f}_not_numeric", "coerced_to_null", f, f"values of {f} set to missing: no number",
            F.count_if(kept & F.col(f).isNotNull() & F.col(f"_{f}").isNull()),
        )
        for f in OPTIONAL_NUMBERS
        if f in columns
    ]


def _log_of(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Log rows from one row that has a column `action_<name>` for every action."""
    log = F.array(
        *[
            F.struct(
                F.lit(name).alias("check_name"),
                F.lit(action).alias("action"),
                F.lit(field).cast("string").alias("affected_field"),
                F.col(f"action_{name}").alias("affected_row_count"),
                F.lit(text).alias("message"),
            )
            for name, action, field, text, _ in _actions(columns)
        ]
    )
    return (
        counts.select(F.inline(log))
        .where(F.col("affected_row_count") > 0)
        .withColumn("message", F.concat_ws(" ", "affected_row_count", "message"))
    )


def _action_counts(columns: Sequence[str]) -> list[Column]:
    return [count.alias(f"action_{name}") for name, *_, count in _actions(columns)]


def cleaning_actions(df: DataFrame) -> DataFrame:
    """What cleaning does, one row per action that touches any row; one pass."""
    return _log_of(_tagged(df).agg(*_action_counts(df.columns)), df.columns)


def row_counts(df: DataFrame) -> DataFrame:
    """Rows before and after cleaning."""
    return _tagged(df).agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(F.col("_reason").isNull()).alias("rows_after"),
    )


def clean(df: DataFrame, as_of: Column | None = None) -> Cleaned:
    """Cleaned table, action log and single-pass issues from one scan of the raw rows.

    The rows that stay are written to the shared folder, so what follows reads typed
    columns instead of parsing again. All counts, also those of the gate and of the
    checks, are observed on the rows as they pass. The write has no shuffle before it,
    so a task that is repeated after a lost executor counts once. A table that does not
    pass the gate raises InsufficientDataError; an empty one too.
    """
    spark, columns = df.sparkSession, df.columns
    tagged = _tagged(df)
    if ORDER_COLUMN not in columns:
        # The input order, before files are dealt anew to the tasks that read them.
        tagged = tagged.withColumn(ORDER_COLUMN, F.monotonically_increasing_id())
    wanted = [*count_columns(columns, as_of), *_action_counts(columns)]
    types = tagged.agg(*wanted).schema
    seen = Observation()
    kept = tagged.observe(seen, *wanted).where(F.col("_reason").isNull())
    sales = materialize(
        kept.select(
            *[
                F.col(f"_{name}" if f"_{name}" in tagged.columns else name).cast(dtype).alias(name)
                for name, dtype, _, _ in CANONICAL_FIELDS
                if name in columns
            ],
            ORDER_COLUMN,
        )
    )
    # One row of numbers. Where nothing was there to be observed, all counts are 0.
    found = seen.get
    row = [found.get(f.name, 0 if f.dataType.typeName() == "long" else None) for f in types]
    counts = spark.createDataFrame([row], T.StructType([T.StructField(f.name, f.dataType) for f in types]))
    gate = _gate_of(counts).first()
    if not gate["enough"]:
        raise InsufficientDataError(gate["reasons"])
    return Cleaned(Sales(sales), _log_of(counts, columns), issues_of(counts, columns))
