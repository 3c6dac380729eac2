from __future__ import annotations

import os
import sys

import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from granary.schema import CANONICAL_FIELDS, Sales  # noqa: E402
from granary.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def make_sales(spark):
    """A Sales table from a dict of columns; what is left out is null."""

    def build(**columns) -> Sales:
        frame = pd.DataFrame(columns)
        frame["_ord"] = range(len(frame))
        if "date" in frame:
            frame["date"] = pd.to_datetime(frame["date"])
        fields, values = [], {}
        for name, dtype, _, _ in CANONICAL_FIELDS:
            fields.append(f"{name} {dtype.simpleString()}")
            if name not in frame:
                values[name] = [None] * len(frame)
            elif dtype.simpleString() == "double":
                values[name] = [None if pd.isna(v) else float(v) for v in frame[name]]
            else:
                values[name] = [
                    None if pd.isna(v) else (v.to_pydatetime() if name == "date" else str(v))
                    for v in frame[name]
                ]
        values["_ord"] = list(frame["_ord"])
        rows = list(zip(*values.values()))
        return Sales(spark.createDataFrame(rows, ", ".join(fields) + ", _ord long"))

    return build


def rows_by(df, *keys):
    """Collected rows as dicts, by key."""
    out = {}
    for row in df.collect():
        key = tuple(row[k] for k in keys)
        out[key[0] if len(keys) == 1 else key] = row.asDict(recursive=True)
    return out
