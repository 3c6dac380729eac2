"""Results kept under the fingerprint of the table they came from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.schema import ORDER_COLUMN
from granary.session import materialize

#: Raised whenever stored results would come out differently.
VERSION = 4


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """One row that changes with the content, whatever the order of the rows.

    Names, types and null flags are hashed with the values, so a value that moves
    to another column, or takes another type, counts as a change. The order
    column of a Sales table, which may depend on partitioning, is left out. The
    sum of row hashes keeps copies apart, which the xor alone would cancel.
    """
    columns = sorted(c for c in df.columns if c != ORDER_COLUMN)
    types = dict(df.dtypes)
    described = F.lit(";".join(f"{c}:{types[c]}" for c in columns))
    return df.select(_row_hash(columns, described).alias("h")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
    )


def _row_hash(columns: list[str], *first: Column) -> Column:
    named = [F.col(f"`{c.replace('`', '``')}`") for c in columns]
    return F.xxhash64(*first, *[x for c in named for x in (c.isNull(), c)])


def group_fingerprints(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, print): changes with the rows of a key in these columns, whatever their order.

    Rows are added up before the shuffle, so a hot key costs one row per task.
    """
    hashed = df.select(key, _row_hash(columns).alias("h")).groupBy(key)
    sums = hashed.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"))
    return sums.select(key, F.concat_ws("-", F.col("rows").cast("string"), F.col("sum").cast("string")).alias("print"))


def fingerprint(df: DataFrame) -> str:
    row = dataset_fingerprint(df).first()
    return f"{row['row_count']}-{row['hash_xor'] & (2**64 - 1):016x}-{row['hash_sum']}"


class ResultStore:
    """Result tables and models in a shared folder.

    The key of a result is its table's fingerprint with the library's version and
    the parameters that made it, so neither a change of these nor of the data is
    answered with an old result. A result counts as stored when its writer has
    finished (its folder has a _SUCCESS file).
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def path(self, name: str, key: str, **parameters) -> str:
        made_by = json.dumps([VERSION, parameters], sort_keys=True, default=str)
        digest = hashlib.sha256(made_by.encode()).hexdigest()[:16]
        return f"{self.folder}/{name}/fingerprint={key}/made={digest}"

    def table(self, name: str, key: str, source: DataFrame, build: Callable[[], DataFrame], **parameters) -> DataFrame:
        """The stored table, or the built one, stored; unreadable means build again.

        A stored table is read through once, so that a damaged file is found here.
        """
        spark, path = source.sparkSession, self.path(name, key, **parameters)
        if not (_finished(spark, path) and _sound(spark, path)):
            build().write.mode("overwrite").parquet(path)
            spark.catalog.refreshByPath(path)
        return spark.read.parquet(path)

    def rows(
        self, name: str, prints: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], **parameters
    ) -> DataFrame:
        """One result per key, worked out anew only where the key's print is not stored yet.

        `prints` has (key, print), a print per key. `build` gets a table of the keys to
        work out and returns rows with `key`, without running them; they are appended
        with their print, so what is stored grows by what changed. Damaged files count
        as not stored.
        """
        spark, path = prints.sparkSession, self.path(name, f"by-{key}", **parameters)
        wanted = materialize(prints)
        schema = build(wanted.select(key)).join(wanted, key).schema
        stored = _kept_rows(spark, path, schema)
        missing = wanted if stored is None else wanted.join(stored.select(key, "print"), [key, "print"], "left_anti")
        missing = materialize(missing)
        if stored is None or not missing.isEmpty():
            build(missing.select(key)).join(missing, key).write.mode("append").parquet(path)
            spark.catalog.refreshByPath(path)
        # Two writers at a time may store the same key twice.
        found = _kept_rows(spark, path, schema).join(wanted, [key, "print"], "left_semi").dropDuplicates([key, "print"])
        return found.drop("print")

    def forest(self, name: str, key: str, build: Callable[[], RandomForestClassificationModel], **parameters):
        """The stored forest, or the built one, stored.

        It is read back in either case: a fitted forest holds its training summary and
        with it the session, which tasks cannot take along once it has observed a table.
        """
        path = self.path(name, key, **parameters)
        try:
            return RandomForestClassificationModel.load(path)
        except (PySparkException, Py4JJavaError):
            build().write().overwrite().save(path)
            return RandomForestClassificationModel.load(path)


def _finished(spark, path: str) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def _sound(spark, path: str) -> bool:
    """Whether every page of a stored table can be read."""
    try:
        df = spark.read.parquet(path)
        df.agg(F.bit_xor(_row_hash(df.columns))).collect()
        return True
    except (PySparkException, Py4JJavaError):
        return False


def _kept_rows(spark, path: str, schema: StructType) -> DataFrame | None:
    """The rows of all files that can be read; None where nothing was stored yet."""
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    except AnalysisException:
        return None
