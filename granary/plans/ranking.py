"""Running totals, ranks and exact quantiles that never sort in one task.

An ordered pass over a whole table is cut into buckets of neighbouring rows by
range partitioning on keys and sort key together: Spark samples a bounded number
of rows per partition for the bounds, whatever the types, and splits a hot key, or
a hot value by its second sort key, like anything else. The partition number is
written down with the rows, so a repeated task finds the same buckets. Inside a
bucket a window does the work. Only keys that reach over a bucket's end, two per
bucket at most, need the totals of earlier buckets. Callers first reduce rows to
distinct sort keys, so that copies of one value count as one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import materialize

ROWS_PER_BUCKET = 250_000


def with_running_totals(
    df: DataFrame,
    order: Sequence[Column],
    measures: Mapping[str, str],
    keys: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    stored: bool = False,
) -> DataFrame:
    """Add, for each measure m, `m_before` and `m_total` within `keys`.

    `m_before` sums the rows that come earlier in `order`, which must be unique
    within a key; `m_total` sums the whole key. `measures` maps m to its zero
    type ("bigint" or "double"). The (already reduced) input is written once to
    the shared folder, because its size is needed first, unless it is `stored`
    there already. A null key is a key of its own.
    """
    keys = list(keys)
    sort = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rows = df if stored else materialize(df)
    buckets = -(-rows.count() // rows_per_bucket)
    rows = rows.withColumn("_sort", sort)
    zero = {m: F.lit(0).cast(t) for m, t in measures.items()}

    if buckets <= 1:
        whole = Window.partitionBy(*keys, F.lit(0))
        before = whole.orderBy("_sort").rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(
            *df.columns,
            *[F.coalesce(F.sum(m).over(before), zero[m]).alias(f"{m}_before") for m in measures],
            *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
        )

    placed = materialize(
        rows.repartitionByRange(buckets, *keys, "_sort").withColumn("_bucket", F.spark_partition_id())
    )
    whole = Window.partitionBy(*keys, F.lit(0))
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (
        placed.groupBy(*keys, "_bucket")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(
            *[F.col(k).alias(f"_{k}_key") for k in keys],
            F.col("_bucket").alias("_at"),
            F.count(F.lit(1)).over(whole).alias("_parts"),
            *[F.coalesce(F.sum(m).over(earlier), zero[m]).alias(f"_{m}_start") for m in measures],
            *[F.sum(m).over(whole).alias(f"_{m}_all") for m in measures],
        )
        .where("_parts > 1")
    )
    bucket = Window.partitionBy(*keys, "_bucket")
    inside = bucket.orderBy("_sort").rowsBetween(Window.unboundedPreceding, -1)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}_key")) for k in keys], F.col("_bucket") == F.col("_at"))
    joined = placed.join(crossing, same, "left")
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(f"_{m}_start", zero[m]) + F.coalesce(F.sum(m).over(inside), zero[m])).alias(f"{m}_before")
            for m in measures
        ],
        *[F.coalesce(F.col(f"_{m}_all"), F.sum(m).over(bucket)).alias(f"{m}_total") for m in measures],
    )


def value_counts(values: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct values per key with their number of `copies`."""
    return (
        values.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def quantiles_of_counts(
    counts: DataFrame,
    value: str,
    probabilities: Mapping[str, float],
    keys: Sequence[str] = (),
    **bucketing,
) -> DataFrame:
    """Linearly interpolated quantiles from distinct values and their `copies`.

    Exact at any size. Returns the keys, one column per named probability and
    `n`, the number of values.
    """
    keys = list(keys)
    placed = with_running_totals(counts, [F.col(value)], {"copies": "bigint"}, keys, **bucketing)
    through = F.col("copies_before") + F.col("copies")
    picks = []
    for name, p in probabilities.items():
        low = F.floor((F.col("copies_total") - 1) * F.lit(float(p)))
        high = F.least(low + 1, F.col("copies_total") - 1)
        picks += [
            F.min(F.when(through > low, F.col(value))).alias(f"_{name}_low"),
            F.min(F.when(through > high, F.col(value))).alias(f"_{name}_high"),
        ]
    found = placed.groupBy(*keys).agg(F.max("copies_total").alias("n"), *picks)
    results = []
    for name, p in probabilities.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        results.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(*keys, *results, "n")


def exact_quantiles(
    values: DataFrame,
    value: str,
    probabilities: Mapping[str, float],
    keys: Sequence[str] = (),
    **bucketing,
) -> DataFrame:
    """Linearly interpolated quantiles of `value` per key."""
    counts = value_counts(values, value, keys)
    return quantiles_of_counts(counts, value, probabilities, keys, **bucketing)
