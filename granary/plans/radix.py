"""Exact quantiles and counted buckets of a few fields by radix selection: no sort, no written table.

A double becomes a whole number of the same order, read in four digits of 16 bits.
Each pass counts the digits of the rows that share the digits found so far, at most
65,536 counts for each place looked for, and goes on with the digit that holds the
place. Its least and greatest value tell its rows apart, so later passes convert no
others. A digit whose rows all have one value ends the search: small integers take two
passes, any table takes four at most. All places of all fields share the passes.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT = 16
DIGITS = 64 // DIGIT
# Bits that value buckets are first told apart by (sign, exponent, eight of the fraction) and at
# most (36 of the fraction, so eleven digits); buckets that a later scan may make.
FIRST_BITS, LAST_BITS, BUCKETS = 20, 48, 1 << 20
# The layout of a double.
FRACTION_BITS, BIAS = 52, 1023
SMALLEST, SMALLEST_NORMAL, LARGEST = 5e-324, 2.0**-1022, (2.0 - 2.0**-52) * 2.0**1023


def with_bits(df: DataFrame, value: str = "value") -> DataFrame:
    """Add `bits`, a long in the order of the doubles: equal for equal values (so for both zeros), NaN last.

    In steps, so that each is worked out once a row.
    """
    size, scale = F.abs(F.col(value)), float(1 << FRACTION_BITS)
    # Powers of two from two small arrays: 2^(64 i - 1022) and 2^j.
    steps = F.array(*[F.lit(2.0 ** (64 * i + 1 - BIAS)) for i in range(32)])
    units = F.array(*[F.lit(2.0**j) for j in range(64)])
    guess = F.floor(F.log2(F.when(size.between(SMALLEST_NORMAL, LARGEST), size).otherwise(1.0))).cast("int")
    stepped = df.withColumn("_power", F.least(guess + (BIAS - 1), F.lit(2 * BIAS - 1)))
    part = size / F.get(steps, F.shiftright("_power", 6)) / F.get(units, F.col("_power").bitwiseAND(63))
    stepped = stepped.withColumn("_part", part)
    # The logarithm may be off by one just at a power of two: the part is then below 1, or is 2 and carries over.
    low = F.col("_part") < 1
    whole = (F.col("_power") + F.when(low, 0).otherwise(1)).cast("long") * F.lit(1 << FRACTION_BITS)
    normal = whole + ((F.when(low, F.col("_part") * 2).otherwise(F.col("_part")) - 1) * scale).cast("long")
    bits = (
        F.when(size.between(SMALLEST_NORMAL, LARGEST), normal)
        .when(size < SMALLEST_NORMAL, (size / F.lit(SMALLEST)).cast("long"))
        .when(F.isnan(value), F.lit((1 << 63) - 1))
        .otherwise(F.lit((2 * BIAS + 1) << FRACTION_BITS))
    )
    stepped = stepped.withColumn("_size", bits).drop("_power", "_part")
    return stepped.withColumn("bits", F.when(F.col(value) < 0, -F.col("_size")).otherwise(F.col("_size"))).drop("_size")


def _digit(bits: Column, k: int) -> Column:
    """The k-th digit, from the highest; the first one carries the sign."""
    shifted = F.shiftright(bits, 64 - DIGIT * (k + 1))
    return (shifted if k == 0 else shifted.bitwiseAND((1 << DIGIT) - 1)).cast("int")


def field_quantiles(
    values: DataFrame, probabilities: Mapping[str, float], field: str = "field", value: str = "value"
) -> DataFrame:
    """Linearly interpolated quantiles of `value` per `field`, a column of few distinct values.

    Returns field, one column per named probability, and n, for every field that has
    a value. Nulls are left out. Up to four scans of `values`, each with a hash
    aggregate; what reaches the driver is two rows per field and probability.
    """
    spark = values.sparkSession
    names, shares = list(probabilities), [float(p) for p in probabilities.values()]
    rows = values.where(F.col(value).isNotNull()).select(F.col(field).alias("field"), F.col(value).alias("value"))
    found: dict[tuple, float] = {}
    counts: dict = {}

    def settle(chosen: list) -> dict[tuple, dict]:
        """Keep what is found; the others by field and range of values."""
        open_ = {}
        for r in chosen:
            if r["one_value"]:
                found[(r["field"], r["place"])] = r["least"]
            else:
                open_.setdefault((r["field"], r["least"], r["most"]), {})[r["place"]] = r["rest"]
        return open_

    # The first pass also gives the number of values, on which the places depend.
    per_field = Window.partitionBy("field")
    earlier = per_field.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    first = with_bits(rows).groupBy("field", _digit(F.col("bits"), 0).alias("digit")).agg(*_of_digit())
    first = first.withColumns({"before": F.coalesce(F.sum("rows").over(earlier), F.lit(0)), "n": F.sum("rows").over(per_field)})
    places = F.array(
        *[
            F.struct(
                F.lit(2 * i + high).alias("place"),
                F.least(F.floor((F.col("n") - 1) * F.lit(p)) + high, F.col("n") - 1).alias("rank"),
            )
            for i, p in enumerate(shares)
            for high in (0, 1)
        ]
    )
    chosen = first.select("*", F.inline(places)).where(_holds("rank"))
    chosen = chosen.select(
        "field", "place", "n", (F.col("rank") - F.col("before")).alias("rest"),
        (F.col("least") == F.col("most")).alias("one_value"), "least", "most",
    ).collect()
    counts = {r["field"]: r["n"] for r in chosen}
    open_ = settle(chosen)

    for k in range(1, DIGITS):
        if not open_:
            break
        ranges = list(open_)
        match = reduce(
            lambda case, i: case.when(_within(*ranges[i]), i), range(1, len(ranges)), F.when(_within(*ranges[0]), 0)
        )
        part = rows.withColumn("part", match).where("part is not null")
        part = with_bits(part).groupBy("part", _digit(F.col("bits"), k).alias("digit")).agg(*_of_digit())
        earlier = Window.partitionBy("part").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        part = part.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        # Two places for each probability and range at most.
        ranks = F.create_map(
            *[
                x
                for i, key in enumerate(ranges)
                for x in (F.lit(i), F.array(*[F.struct(F.lit(p).alias("place"), F.lit(r).alias("rank")) for p, r in open_[key].items()]))
            ]
        )
        chosen = part.select("*", F.inline(F.element_at(ranks, F.col("part")))).where(_holds("rank"))
        chosen = chosen.select(
            "part", "place", (F.col("rank") - F.col("before")).alias("rest"),
            (F.col("least") == F.col("most")).alias("one_value"), "least", "most",
        ).collect()
        open_ = settle([r.asDict() | {"field": ranges[r["part"]][0]} for r in chosen])

    out = []
    for f, n in counts.items():
        row = [f]
        for i, p in enumerate(shares):
            low, high, at = found[(f, 2 * i)], found[(f, 2 * i + 1)], (n - 1) * p
            row.append(low if low == high else low + (high - low) * (at - int(at)))
        out.append((*row, n))
    kind = values.schema[field].dataType.simpleString()
    return spark.createDataFrame(out, ", ".join([f"{field} {kind}", *[f"{n} double" for n in names], "n long"]))


def value_buckets(df: DataFrame, columns: Sequence[str], share: float) -> dict[str, list[tuple[int, float, float]]]:
    """Per column its values, counted in ascending buckets: (rows, least, most).

    A bucket holds at most `share` of the column's rows, or is one value, where values that
    agree to LAST_BITS count as one. Nulls are left out. The first scan tells values apart
    by their leading bits; only columns with buckets that are too full are read again, by
    as many further bits as BUCKETS allows. What reaches the driver is bounded by the
    bits, not by the rows.
    """
    found: dict[str, list[tuple[int, float, float]]] = {c: [] for c in columns}
    too_many: dict[str, float] = {}
    open_: dict[str, list[tuple[float, float]]] = {c: [] for c in columns}
    width = FIRST_BITS
    while open_:
        fields = list(open_)
        rows = df.select(F.posexplode(F.array(*fields)).alias("field", "value")).where("value is not null")
        if too_many:
            rows = rows.where(reduce(or_, [_within(i, *ends) for i, c in enumerate(fields) for ends in open_[c]]))
        top = F.shiftright("bits", 64 - width).alias("top")
        counted = with_bits(rows).groupBy("field", top).agg(*_of_digit()).collect()
        if not too_many:
            too_many = {c: share * sum(r["rows"] for r in counted if r["field"] == i) for i, c in enumerate(fields)}
        open_ = {}
        for r in counted:
            c, ends = fields[r["field"]], (r["least"], r["most"])
            if r["rows"] <= too_many[c] or width == LAST_BITS or _agree(*ends):
                found[c].append((r["rows"], *ends))
            else:
                open_.setdefault(c, []).append(ends)
        places = sum(map(len, open_.values()))
        width = min(LAST_BITS, width + max(1, (BUCKETS // max(places, 1)).bit_length() - 1))
    return {c: sorted(buckets, key=lambda b: (math.isnan(b[1]), b[1])) for c, buckets in found.items()}


def _agree(low: float, high: float) -> bool:
    """Whether two values of one bucket agree to LAST_BITS."""
    tops = [struct.unpack(">Q", struct.pack(">d", abs(x)))[0] >> (64 - LAST_BITS) for x in (low, high)]
    return low == high or tops[0] == tops[1]


def _of_digit() -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.min("value").alias("least"), F.max("value").alias("most")]


def _holds(rank: str) -> Column:
    return (F.col("before") <= F.col(rank)) & (F.col(rank) < F.col("before") + F.col("rows"))


def _within(field: str | int, least: float, most: float) -> Column:
    return (F.col("field") == field) & F.col("value").between(least, most)
