"""Box-plot numbers per key: quartiles, fences, whiskers, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.plans.lookup import join_lookup
from granary.plans.radix import field_quantiles
from granary.plans.ranking import quantiles_of_counts, value_counts
from granary.session import materialize

# How many interquartile ranges a value may lie outside, and the most rows
# of a key that are put in order in one row.
FENCE = 1.5
ROWS_HELD = 20_000


def long_form(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row (keep..., field, value) per row and numeric field with a value."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields]
    )
    return df.select(*keep, F.inline(pairs)).where(F.col("value").isNotNull())


def fences(quartiles: DataFrame) -> DataFrame:
    width = (F.col("q3") - F.col("q1")) * FENCE
    return quartiles.withColumns(
        {"lower_fence": F.col("q1") - width, "upper_fence": F.col("q3") + width}
    )


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def field_box(values: DataFrame) -> DataFrame:
    """Box-plot numbers per field, for rows (field, value) of a few fields.

    Quartiles by radix selection, then one pass against the fences; nothing is
    sorted or written.
    """
    # One row per field, four at most.
    limits = F.broadcast(fences(field_quantiles(values, QUARTILES)))
    inside = F.col("value").between(F.col("lower_fence"), F.col("upper_fence"))
    return (
        values.join(limits, "field")
        .groupBy("field", *QUARTILES, "n", "lower_fence", "upper_fence")
        .agg(*_extremes(inside, F.lit(1)))
    )


def _extremes(inside: Column, copies: Column) -> list[Column]:
    return [
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        F.min(F.when(inside, F.col("value"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("upper_whisker"),
        F.coalesce(F.sum(F.when(~inside, copies)), F.lit(0)).alias("outliers"),
    ]


def box_numbers(values: DataFrame, keys: Sequence[str], **bucketing) -> DataFrame:
    """Quartiles with whiskers and the number of outliers, per key.

    The second pass, against the fences, reads the distinct values, not the rows.
    """
    keys = list(keys)
    counts = materialize(value_counts(values, "value", keys))
    quartiles = quantiles_of_counts(counts, "value", QUARTILES, keys, stored=True, **bucketing)
    limits = materialize(fences(quartiles))
    total = limits.agg(F.sum("n")).scalar()
    lookup = limits.select(*keys, "lower_fence", "upper_fence", "n", total.alias("total"))
    inside = F.col("value").between(F.col("lower_fence"), F.col("upper_fence"))
    extremes = (
        join_lookup(counts, lookup, keys, "n", "total")
        .groupBy(*keys)
        .agg(*_extremes(inside, F.col("copies")))
    )
    return limits.join(extremes, keys)


def field_box_numbers(rows: DataFrame, fields: Sequence[str], keys: Sequence[str], **bucketing) -> DataFrame:
    """`box_numbers` of several fields, keys with the field's name, for rows of wide form.

    The rows of a key are shuffled once, as they are, and put in order field by field in
    one row. Keys with more rows than `ROWS_HELD` (or than `rows_per_bucket`, if that is
    less) are counted out first and go the long way, through buckets.
    """
    keys = list(keys)
    held = min(ROWS_HELD, bucketing.get("rows_per_bucket", ROWS_HELD))
    rows = rows.select(*keys, *[F.col(f).cast("double").alias(f) for f in fields])
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    crowded = materialize(sizes.where(F.col("_rows") > held).select(*keys))
    if crowded.isEmpty():
        return _ordered_box(rows, fields, keys)
    small = _ordered_box(rows.join(crowded, keys, "left_anti"), fields, keys)
    large = long_form(rows.join(crowded, keys, "left_semi"), fields, keys)
    return small.unionByName(box_numbers(large, [*keys, "field"], **bucketing))


def _ordered_box(rows: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Box-plot numbers from the values of a key in order, as one array per field."""
    # Zero has one sign, as where values are grouped.
    plain = {f: F.when(F.col(f) == 0, 0.0).otherwise(F.col(f)) for f in fields}
    held = rows.repartition(*keys).groupBy(*keys).agg(*[F.collect_list(plain[f]).alias(f) for f in fields])
    lists = F.array(*[F.struct(F.lit(f).alias("field"), F.sort_array(f).alias("of")) for f in fields])

    def quartile(r, p: float) -> Column:
        at = (F.size(r["of"]) - 1) * F.lit(p)
        low = F.floor(at).cast("int")
        below, above = F.get(r["of"], low), F.get(r["of"], F.least(low + 1, F.size(r["of"]) - 1))
        return below + (above - below) * (at - F.floor(at))

    def with_limits(r) -> Column:
        # The fences' own formulas, on the fields of one struct.
        width = (r["q3"] - r["q1"]) * FENCE
        return F.struct(
            *[r[c].alias(c) for c in ("field", "of", *QUARTILES)],
            (r["q1"] - width).alias("lower_fence"), (r["q3"] + width).alias("upper_fence"),
        )

    def with_inside(r) -> Column:
        inside = F.filter(r["of"], lambda v: v.between(r["lower_fence"], r["upper_fence"]))
        return F.struct(*[r[c].alias(c) for c in ("field", "of", *QUARTILES, "lower_fence", "upper_fence")], inside.alias("inside"))

    def numbers(r) -> Column:
        n, inside = F.size(r["of"]), r["inside"]
        return F.struct(
            r["field"].alias("field"), *[r[c].alias(c) for c in QUARTILES], n.cast("bigint").alias("n"),
            r["lower_fence"].alias("lower_fence"), r["upper_fence"].alias("upper_fence"),
            F.get(r["of"], F.lit(0)).alias("minimum"), F.get(r["of"], n - 1).alias("maximum"),
            F.get(inside, F.lit(0)).alias("lower_whisker"), F.get(inside, F.size(inside) - 1).alias("upper_whisker"),
            (n - F.size(inside)).cast("bigint").alias("outliers"),
        )

    found = F.filter(lists, lambda r: F.size(r["of"]) > 0)
    found = F.transform(
        found, lambda r: F.struct(r["field"].alias("field"), r["of"].alias("of"), *[quartile(r, p).alias(q) for q, p in QUARTILES.items()])
    )
    for step in (with_limits, with_inside, numbers):
        found = F.transform(found, step)
    return held.select(*keys, F.inline(found))
