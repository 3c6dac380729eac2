"""Descriptive and inferential statistics of the numeric fields."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.shapiro import inverse_normal, shapiro_p, shapiro_w, shapiro_z
from granary.functions.tails import EXACT_SIZE, rank_sum_tail, t_tail
from granary.plans.box import long_form
from granary.plans.lookup import join_lookup
from granary.plans.radix import field_quantiles
from granary.plans.ranking import value_counts, with_running_totals
from granary.schema import Sales
from granary.session import materialize

# Labels by size of the coefficient, test level, sample and plot sizes.
STRENGTHS = [(0.1, "negligible"), (0.3, "weak"), (0.5, "moderate"), (0.7, "strong")]
STRONGEST = "very strong"
ALPHA = 0.05
Z_LIMIT = 1.6448536269514722
BINS = 40
CURVE_POINTS = 200
# Ranks that one row stands for before they are expanded.
RANKS_PER_ROW = 10_000
GROUP_FIELDS = ["category", "warehouse_id"]


def descriptive_stats(sales: Sales) -> DataFrame:
    """Mean, median, deviation, range, quartiles, skew and excess kurtosis per field."""
    fields = sales.numeric_fields()
    moments = sales.df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("field"),
                    F.count(f).alias("n"),
                    F.avg(f).alias("mean"),
                    F.stddev_samp(f).alias("std"),
                    F.min(f).alias("min"),
                    F.max(f).alias("max"),
                    F.skewness(f).alias("skewness"),
                    F.kurtosis(f).alias("kurtosis"),
                )
                for f in fields
            ]
        ).alias("rows")
    ).select(F.inline("rows"))
    quartiles = field_quantiles(long_form(sales.df, fields), {"q1": 0.25, "median": 0.5, "q3": 0.75})
    # One row per numeric field, four at most.
    return moments.join(F.broadcast(quartiles.drop("n")), "field")


def _pairs(sales: Sales) -> list[tuple[str, str]]:
    return list(combinations(sales.numeric_fields(), 2))


def _correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation, from t with n-2 degrees of freedom."""
    rest = F.greatest(1 - r * r, F.lit(0.0))
    t = F.when(rest > 0, r * F.sqrt((n - 2) / F.when(rest > 0, rest)))
    return F.when(rest == 0, 0.0).otherwise(t_tail(t, (n - 2).cast("double")))


def pearson(sales: Sales) -> DataFrame:
    """Pearson r and p of every pair, from one pass over pairwise complete rows.

    Pairs with fewer than three rows or a constant side are left out.
    """
    rows = []
    for a, b in _pairs(sales):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        left, right = F.when(both, F.col(a)), F.when(both, F.col(b))
        rows.append(
            F.struct(
                F.lit(a).alias("field_a"),
                F.lit(b).alias("field_b"),
                F.count(left).alias("n"),
                F.covar_pop(left, right).alias("joint"),
                (F.stddev_pop(left) * F.stddev_pop(right)).alias("spread"),
                ((F.min(left) < F.max(left)) & (F.min(right) < F.max(right))).alias("varies"),
            )
        )
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("joint", "spread")))
    return (
        sales.df.agg(F.array(*rows).alias("rows"))
        .select(F.inline("rows"))
        .where((F.col("n") >= 3) & F.col("varies"))
        .withColumn("pearson_r", r)
        .select(
            "field_a",
            "field_b",
            "n",
            "pearson_r",
            _correlation_p(F.col("pearson_r"), F.col("n")).alias("pearson_p_value"),
        )
    )


def _average_ranks(joint: DataFrame, side: str, **bucketing) -> DataFrame:
    counts = joint.groupBy("pair", side).agg(F.sum("copies").alias("held"))
    placed = with_running_totals(counts, [F.col(side)], {"held": "bigint"}, ["pair"], **bucketing)
    rank = F.col("held_before") + (F.col("held") + 1) / 2
    return placed.select(
        "pair",
        side,
        rank.alias(f"rank_{side}"),
        "held",
        F.col("held_total").alias("n"),
    )


def spearman(sales: Sales, **bucketing) -> DataFrame:
    """Spearman r and p of every pair, with average ranks.

    Ranks are worked out on distinct values and joined to the distinct pairs of
    values, so copies of one value weigh in as a count, not as rows.
    """
    pairs = _pairs(sales)
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    joint = materialize(
        sales.df.select(F.inline(entries))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("pair", "a", "b")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    ranked = join_lookup(joint, _average_ranks(joint, "a", **bucketing), ["pair", "a"], "held", "n")
    ranks_b = _average_ranks(joint, "b", **bucketing).withColumn("size", F.col("n"))
    ranked = join_lookup(ranked, ranks_b, ["pair", "b"], "held", "n")
    off_a = F.col("rank_a") - (F.col("size") + 1) / 2
    off_b = F.col("rank_b") - (F.col("size") + 1) / 2
    sums = ranked.groupBy("pair").agg(
        F.max("size").alias("n"),
        F.sum(F.col("copies") * off_a * off_b).alias("joint"),
        F.sum(F.col("copies") * off_a * off_a).alias("spread_a"),
        F.sum(F.col("copies") * off_b * off_b).alias("spread_b"),
    )
    names = F.array(
        *[F.struct(F.lit(a).alias("field_a"), F.lit(b).alias("field_b")) for a, b in pairs]
    )
    r = F.try_divide("joint", F.sqrt(F.col("spread_a") * F.col("spread_b")))
    return (
        sums.where((F.col("n") >= 3) & (F.col("spread_a") > 0) & (F.col("spread_b") > 0))
        .select(
            F.inline(F.array(F.get(names, F.col("pair")))),
            "n",
            F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("spearman_r"),
        )
        .withColumn("spearman_p_value", _correlation_p(F.col("spearman_r"), F.col("n")))
    )


def strength(r: Column) -> Column:
    label = F.when(F.abs(r) < STRENGTHS[0][0], STRENGTHS[0][1])
    for limit, name in STRENGTHS[1:]:
        label = label.when(F.abs(r) < limit, name)
    return label.otherwise(STRONGEST)


def all_correlations(sales: Sales, **bucketing) -> DataFrame:
    """Both coefficients of every pair, with a reading in words."""
    both = pearson(sales).join(
        spearman(sales, **bucketing).drop("n"), ["field_a", "field_b"]
    )
    r = F.col("pearson_r")
    return both.withColumns(
        {
            "strength": strength(r),
            "direction": F.when(r > 0, "positive").otherwise("negative"),
        }
    ).withColumn(
        "interpretation",
        F.format_string(
            "%s and %s: %s %s relationship (r = %.2f)",
            "field_a", "field_b", "strength", "direction", "pearson_r",
        ),
    )


def correlation_matrix(sales: Sales) -> DataFrame:
    """The symmetric Pearson matrix in long form; needs two fields."""
    upper = pearson(sales).select("field_a", "field_b", "pearson_r")
    sides = F.array(
        F.struct(F.col("field_a").alias("row"), F.col("field_b").alias("column"), "pearson_r"),
        F.struct(F.col("field_b").alias("row"), F.col("field_a").alias("column"), "pearson_r"),
    )
    diagonal = F.array(
        *[F.struct(F.lit(f).alias("row"), F.lit(f).alias("column")) for f in sales.numeric_fields()]
    )
    ones = sales.df.agg(F.lit(1.0).alias("pearson_r")).select(F.inline(diagonal), "pearson_r")
    return upper.select(F.inline(sides)).unionByName(ones)


def compare_groups(
    sales: Sales, group_field: str, group_a: str, group_b: str, field: str = "quantity_sold",
    **bucketing,
) -> DataFrame:
    """Mann-Whitney test of one field between two values of a group field; one row.

    One rule whatever the size of the table: exact where nothing is tied and the
    smaller group has up to eight values, else normal with continuity correction; the
    column `method` says which. Ranks come from a histogram of the distinct values. With fewer than two
    values in a group, `error` says so and the rest is null.
    """
    in_a = F.col(group_field) == group_a
    histogram = (
        sales.df.where(F.col(group_field).isin(group_a, group_b) & F.col(field).isNotNull())
        .groupBy(F.col(field).alias("value"))
        .agg(
            F.count_if(in_a).alias("held_a"),
            F.count_if(~in_a).alias("held_b"),
            F.count(F.lit(1)).alias("held"),
        )
    )
    placed = with_running_totals(histogram, [F.col("value")], {"held": "bigint"}, **bucketing)
    rank = F.col("held_before") + (F.col("held") + 1) / 2
    held = F.col("held").cast("double")
    sums = placed.agg(
        F.coalesce(F.sum("held_a"), F.lit(0)).alias("n_a"),
        F.coalesce(F.sum("held_b"), F.lit(0)).alias("n_b"),
        F.sum(F.col("held_a") * rank).alias("rank_sum"),
        F.sum(held * held * held - held).alias("ties"),
        F.try_divide(F.sum(F.col("held_a") * F.col("value")), F.sum("held_a")).alias("mean_a"),
        F.try_divide(F.sum(F.col("held_b") * F.col("value")), F.sum("held_b")).alias("mean_b"),
    )
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    u = F.col("rank_sum") - F.col("n_a") * (F.col("n_a") + 1) / 2
    tested = sums.withColumn("u_statistic", F.when(enough, u)).withColumn(
        "p_value", rank_sum_tail(F.col("u_statistic"), F.col("n_a"), F.col("n_b"), F.col("ties"))
    )
    small = (F.least("n_a", "n_b") <= EXACT_SIZE) & (F.col("ties") == 0)
    used = F.when(small, "exact").otherwise("normal")
    higher = F.when(F.col("mean_a") > F.col("mean_b"), "higher").otherwise("lower")
    return tested.select(
        F.lit(group_field).alias("group_field"),
        F.lit(group_a).alias("group_a"),
        F.lit(group_b).alias("group_b"),
        "n_a",
        "n_b",
        F.when(enough, F.col("mean_a")).alias("mean_a"),
        F.when(enough, F.col("mean_b")).alias("mean_b"),
        "u_statistic",
        "p_value",
        (F.col("p_value") < ALPHA).alias("is_significant"),
        F.when(F.col("p_value") < ALPHA, higher).alias("direction"),
        F.when(enough, used).alias("method"),
        F.when(~enough, "fewer than two values in a group").alias("error"),
    )


def largest_groups(sales: Sales, group_field: str) -> list[str]:
    """The two values held by most rows."""
    top = (
        sales.df.where(F.col(group_field).isNotNull())
        .groupBy(group_field)
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), group_field)
        .limit(2)
    )
    return [row[0] for row in top.collect()]


def compare_largest_groups(
    sales: Sales, group_field: str, field: str = "quantity_sold", **bucketing
) -> DataFrame | None:
    """The test between the two largest groups; None when there is only one."""
    groups = largest_groups(sales, group_field)
    if len(groups) < 2:
        return None
    return compare_groups(sales, group_field, *groups, field, **bucketing)


def group_tests(sales: Sales, **bucketing) -> DataFrame:
    """The test for category and for warehouse, where the data allows it."""
    tests = [
        compare_largest_groups(sales, g, **bucketing) for g in GROUP_FIELDS if sales.has(g)
    ]
    tests = [t.where(F.col("error").isNull()) for t in tests if t is not None]
    if not tests:
        none = compare_groups(sales, GROUP_FIELDS[0], "", "", **bucketing)
        return none.where(F.lit(False))
    result = tests[0]
    for other in tests[1:]:
        result = result.unionByName(other)
    return result


def normality(sales: Sales, ranks_per_row: int = RANKS_PER_ROW, **bucketing) -> DataFrame:
    """Shapiro-Wilk per numeric field over all its values; fields need three.

    Distinct values get their ranges of ranks from running totals; copies of one
    value are cut into chunks of ranks, so no task expands a hot value alone. The
    weights are normal scores of the ranks, an expression, and W follows from
    sums. Royston's p is fitted for up to 5,000 values and carried on beyond.
    """
    fields = sales.numeric_fields()
    counts = value_counts(long_form(sales.df, fields), "value", ["field"])
    placed = with_running_totals(counts, [F.col("value")], {"copies": "bigint"}, ["field"], **bucketing)
    n = F.col("copies_total")
    chunks = placed.where(n >= 3).select(
        "field", "value", "copies", n.alias("n"), F.col("copies_before").alias("before"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(ranks_per_row).cast("long"))).alias("from"),
    )
    # The chunks of one value spread over the tasks by their ranks.
    spread = chunks.repartition(F.col("field"), F.col("value"), F.col("from"))
    last = F.least(F.col("from") + ranks_per_row, F.col("copies"))
    rank = F.explode(F.sequence(F.col("before") + F.col("from") + 1, F.col("before") + last)).alias("rank")
    ranked = spread.select("field", "value", "n", rank)
    score = inverse_normal((F.col("rank") - 0.375) / (F.col("n") + 0.25))
    scored = ranked.withColumn("m", score)
    ends = {"x1": F.lit(1), "x2": F.lit(2), "y2": F.col("n") - 1, "y1": F.col("n")}
    sums = scored.groupBy("field", "n").agg(
        F.sum(F.col("m") * F.col("m")).alias("mm"),
        F.sum(F.col("m") * F.col("value")).alias("mx"),
        (F.var_pop("value") * F.col("n")).alias("squares"),
        *[F.max(F.when(F.col("rank") == at, F.col("value"))).alias(name) for name, at in ends.items()],
        F.max("m").alias("m1"),
        F.max(F.when(F.col("rank") == F.col("n") - 1, F.col("m"))).alias("m2"),
    )
    w = F.when((F.col("squares") == 0) | (F.col("x1") == F.col("y1")), 1.0).otherwise(shapiro_w())
    z = shapiro_z(F.col("w_statistic"), F.col("n"))
    return (
        sums.withColumn("w_statistic", w)
        .withColumn("p_value", shapiro_p("w_statistic", "n"))
        .withColumn("is_normal", F.when(F.col("n") < 12, F.col("p_value") >= ALPHA).otherwise(F.coalesce(z <= Z_LIMIT, F.lit(True))))
        .select("field", "n", "w_statistic", "p_value", "is_normal")
    )


def _field_summary(sales: Sales) -> DataFrame:
    """One row with a struct of count, range, mean and deviation per numeric field."""
    return sales.df.agg(
        F.struct(
            *[
                F.struct(
                    F.count(f).alias("n"),
                    F.min(f).alias("low"),
                    F.max(f).alias("high"),
                    F.avg(f).alias("mean"),
                    F.stddev_samp(f).alias("std"),
                ).alias(f)
                for f in sales.numeric_fields()
            ]
        ).alias("s")
    )


def histogram(sales: Sales, bins: int = BINS) -> DataFrame:
    """Density in equal bins between each field's least and greatest value, empty ones too."""
    fields = sales.numeric_fields()
    entries = []
    for f in fields:
        s = F.col("_s")[f]
        width = (s["high"] - s["low"]) / bins
        place = F.coalesce(F.try_divide(F.col(f) - s["low"], width), F.lit(0.0))
        bin_of = F.when(F.col(f).isNotNull(), F.least(F.floor(place), F.lit(bins - 1)).cast("int"))
        entries.append(F.struct(F.lit(f).alias("field"), bin_of.alias("bin")))
    counts = (
        sales.df.withColumn("_s", _field_summary(sales).scalar())
        .select(F.inline(F.array(*entries)))
        .where(F.col("bin").isNotNull())
        .groupBy("field", "bin")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col("s")[f].alias("s")) for f in fields])
    frame = (
        _field_summary(sales)
        .select(F.inline(rows))
        .where(F.col("s.n") > 0)
        .select("field", "s", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    )
    width = (F.col("s.high") - F.col("s.low")) / bins
    return (
        frame.join(counts, ["field", "bin"], "left")
        .withColumn("rows", F.coalesce("rows", F.lit(0)))
        .select(
            "field",
            "bin",
            (F.col("s.low") + F.col("bin") * width).alias("bin_start"),
            (F.col("s.low") + (F.col("bin") + 1) * width).alias("bin_end"),
            "rows",
            F.try_divide("rows", F.col("s.n") * width).alias("density"),
        )
    )


def normal_curve(sales: Sales, points: int = CURVE_POINTS) -> DataFrame:
    """The normal density fitted to each field, at evenly spaced points."""
    rows = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col("s")[f].alias("s")) for f in sales.numeric_fields()]
    )
    x = F.col("s.low") + F.col("point") * (F.col("s.high") - F.col("s.low")) / (points - 1)
    z = F.try_divide(x - F.col("s.mean"), F.col("s.std"))
    return (
        _field_summary(sales)
        .select(F.inline(rows))
        .select("field", "s", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .select(
            "field",
            "point",
            x.alias("x"),
            F.try_divide(F.exp(-z * z / 2), F.col("s.std") * F.sqrt(2 * F.pi())).alias("density"),
        )
    )


def analytics(sales: Sales) -> dict[str, DataFrame]:
    """Every statistics table the data supports."""
    fields = sales.numeric_fields()
    tables = {
        "descriptive_stats": descriptive_stats(sales),
        "group_tests": group_tests(sales),
        "normality": normality(sales),
        "histogram": histogram(sales),
        "normal_curve": normal_curve(sales),
    }
    if len(fields) >= 2:
        tables["correlations"] = all_correlations(sales)
        tables["correlation_matrix"] = correlation_matrix(sales)
    return tables
