"""Null-safe conversions from text, and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted spellings. A number has no type suffix; a date is ISO
# (optionally with a time) or month/day/year.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
ISO_DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?)?\s*$"
TIME = r"([ T]\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?)?\s*$"
SLASHED_YEAR_FIRST = r"^\s*(\d{4})/(\d{1,2})/(\d{1,2})" + TIME
SLASHED_MONTH_FIRST = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})" + TIME


def to_number(df: DataFrame, name: str) -> Column:
    """The column as double; text that is no number, and NaN, become null."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(name), F.col(name).cast("double"))
    if isinstance(dtype, T.NumericType):
        return F.col(name).cast("double")
    text = F.col(name).cast("string")
    return F.when(text.rlike(NUMBER), text).try_cast("double")


def to_datetime(df: DataFrame, name: str) -> Column:
    """The column as timestamp without zone; what is no date becomes null."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return F.col(name).cast("timestamp_ntz")
    text = F.col(name).cast("string")
    iso = (
        F.when(text.rlike(ISO_DATE), text)
        .when(text.rlike(SLASHED_MONTH_FIRST), F.regexp_replace(text, SLASHED_MONTH_FIRST, "$3-$1-$2$4"))
        .when(text.rlike(SLASHED_YEAR_FIRST), F.regexp_replace(text, SLASHED_YEAR_FIRST, "$1-$2-$3$4"))
    )
    return iso.try_cast("timestamp_ntz")


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed 24-hour units, rounded down."""
    return F.timestamp_diff("DAY", start, end)


def micros(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def day_number(c: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(F.to_date(c))
