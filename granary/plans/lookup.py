"""Joins to a lookup whose keys may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1_000
SPREAD = 10_000


def join_lookup(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], weight: str, total: str
) -> DataFrame:
    """Inner join where `lookup` has one row per key, with `weight` copies in `rows`.

    Keys holding more than 1/HOT_SHARE of `total` are, by counting, fewer than
    HOT_SHARE; a broadcast gives them their value. For the ordinary join that
    serves the other keys, rows already served are spread by a salt which no
    lookup row has, so no task receives all copies of a hot key, and `rows` is
    worked out once.
    """
    keys = list(keys)
    values = F.struct(*[c for c in lookup.columns if c not in (*keys, weight, total)])
    is_hot = F.col(weight) * HOT_SHARE > F.col(total)
    hot = lookup.where(is_hot).select(*keys, values.alias("_hot"))
    cold = lookup.where(~is_hot).select(*keys, F.lit(0).alias("_salt"), values.alias("_cold"))
    salt = 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)).cast("int")
    served = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), salt).otherwise(0)
    )
    found = served.join(cold, [*keys, "_salt"], "left").withColumn(
        "_value", F.coalesce("_hot", "_cold")
    )
    return found.where(F.col("_value").isNotNull()).select(
        *[F.col(c) for c in rows.columns], "_value.*"
    )
