"""Reading raw files: everything as text, types come with the mapping."""

from __future__ import annotations

import os
import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats by file extension.
FORMATS = {
    ".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl",
    ".parquet": "parquet", ".orc": "orc",
}


class SourceError(ValueError):
    """A source that cannot be read."""


class UnsupportedFormatError(SourceError):
    """A file whose extension names no format we read."""


def detect_format(path: str) -> str:
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in FORMATS:
        raise UnsupportedFormatError(
            f"{os.path.basename(path)}: supported formats are {', '.join(sorted(set(FORMATS.values())))}"
        )
    return FORMATS[extension]


def read_source(
    spark: SparkSession, path: str, fmt: str | None = None, encoding: str = "UTF-8", multi_line: bool = False
) -> DataFrame:
    """A lazy frame over one file or a folder of files.

    CSV is in the usual dialect: a quote inside quotes is doubled, and a record
    with more cells than the header is malformed. `multi_line` allows line breaks
    inside quotes, at the price of one task per file. `json` is an array of
    objects per file (one task per file); `jsonl`, one object per line, is the
    form that splits and so the one for large data.

    Malformed input is a SourceError: here, where the schema is read from the
    data, else when the rows are; `checked` turns those into SourceErrors too.
    """
    fmt = fmt or detect_format(path)
    try:
        if fmt == "csv":
            reader = spark.read.option("header", True).option("encoding", encoding)
            reader = reader.option("quote", '"').option("escape", '"').option("multiLine", multi_line)
            columns = reader.csv(path).schema
            return reader.schema(columns).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
        if fmt in ("json", "jsonl"):
            return (
                spark.read.option("multiLine", fmt == "json")
                .option("encoding", encoding)
                .option("primitivesAsString", True)
                .option("mode", "FAILFAST")
                .json(path)
            )
        if fmt in ("parquet", "orc"):
            return spark.read.format(fmt).load(path)
    except (PySparkException, Py4JJavaError) as error:
        raise SourceError(f"{path}: {_cause(error)}") from error
    raise UnsupportedFormatError(f"{fmt} is not supported")


def checked(df: DataFrame, name: str) -> DataFrame:
    """The same frame, after one pass over all columns that finds malformed records."""
    try:
        df.write.format("noop").mode("overwrite").save()
    except (PySparkException, Py4JJavaError) as error:
        raise SourceError(f"{name}: {_cause(error)}") from error
    return df


def _cause(error: Exception) -> str:
    found = re.search(r"\[([A-Z_]+(?:\.[A-Z_]+)*)\]", str(error))
    return found[1] if found else type(error).__name__


def load_summary(df: DataFrame, name: str, fmt: str) -> DataFrame:
    """One row: what was loaded."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("source"),
        F.lit(fmt).alias("format"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
    )
