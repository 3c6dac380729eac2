"""The ten-field sales contract and the `Sales` handle the operators take."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The canonical contract (name, Spark type, required, default).
CANONICAL_FIELDS = (
    ("date", T.TimestampNTZType(), True, None),
    ("product_id", T.StringType(), True, None),
    ("quantity_sold", T.DoubleType(), True, None),
    ("product_name", T.StringType(), False, None),
    ("category", T.StringType(), False, None),
    ("unit_price", T.DoubleType(), False, None),
    ("unit_cost", T.DoubleType(), False, None),
    ("warehouse_id", T.StringType(), False, "main"),
    ("current_stock", T.DoubleType(), False, None),
    ("lead_time_days", T.DoubleType(), False, None),
)
FIELD_TYPES = {name: dtype for name, dtype, _, _ in CANONICAL_FIELDS}
FIELD_DEFAULTS = {name: default for name, _, _, default in CANONICAL_FIELDS}
REQUIRED_FIELDS = [name for name, _, required, _ in CANONICAL_FIELDS if required]
OPTIONAL_FIELDS = [name for name, _, required, _ in CANONICAL_FIELDS if not required]
NUMERIC_FIELDS = ["quantity_sold", "unit_price", "unit_cost", "current_stock"]
CATEGORICAL_FIELDS = ["category", "warehouse_id"]
ORDER_COLUMN = "_ord"


@dataclass
class Sales:
    """A canonical sales table plus what is known about its optional fields.

    `df` holds the canonical columns (nulls, never NaN, for missing numbers) and
    `_ord`, a column unique per row that stands for the input order. A field is
    *available* when at least one row has a value. `known` records answers that
    need no scan, such as fields a mapping left out. `aggregates` is where
    `rollups.stored_aggregates` keeps its tables.
    """

    df: DataFrame
    known: dict[str, bool] = field(default_factory=dict)
    aggregates: tuple | None = field(default=None, repr=False, compare=False)

    def __post_init__(self):
        if ORDER_COLUMN not in self.df.columns:
            self.df = self.df.withColumn(ORDER_COLUMN, F.monotonically_increasing_id())

    def has(self, name: str) -> bool:
        """True when the field holds any value; stops at the first one found."""
        if name not in self.known:
            self.known[name] = name in self.df.columns and not (
                self.df.select(name).where(F.col(name).isNotNull()).isEmpty()
            )
        return self.known[name]

    def numeric_fields(self) -> list[str]:
        return [f for f in NUMERIC_FIELDS if self.has(f)]

    def keyed(self) -> DataFrame:
        """Rows that belong to a product."""
        return self.df.where(F.col("product_id").isNotNull())

    def date_range(self) -> Column:
        """Struct(first, last) of the whole table's dates, as a scalar subquery."""
        return self.df.agg(
            F.struct(F.min("date").alias("first"), F.max("date").alias("last")).alias("r")
        ).scalar()


def field_availability(df: DataFrame) -> DataFrame:
    """One row per canonical field: whether it holds any value (one pass)."""
    flags = [
        F.struct(
            F.lit(name).alias("field"),
            F.lit(required).alias("required"),
            ((F.count(name) if name in df.columns else F.lit(0)) > 0).alias("available"),
        )
        for name, _, required, _ in CANONICAL_FIELDS
    ]
    return df.agg(F.array(*flags).alias("flags")).select(F.inline("flags"))


def unavailable(spark, schema: str) -> DataFrame:
    """The empty table that stands for a result the data cannot support."""
    return spark.createDataFrame([], schema)
