"""Stock readings, stockout events and point-in-time features.

Series stay sparse: a product has a row per day with data, and forward filling,
trailing windows and look-ahead labels are found by search among those rows, so
nothing is spread out to one row per calendar day.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.parsing import zero_if_null
from granary.schema import Sales
from granary.session import heavy_tasks

# The gate and the feature windows, in days.
MIN_READINGS = 5
MIN_EVENTS = 30
LOOKBACK = 30
LOOKAHEAD = 14
SNAPSHOT_EVERY = 7
MAX_COVER = 365.0
# More day numbers than a date can have, so that product and day make one key.
DAYS = 1 << 33
# Days and snapshots worked out at once in a task.
BLOCK_ROWS = 200_000
FEATURES = [
    "days_of_inventory", "demand_volatility", "trailing_demand_slope", "trailing_total_demand",
]
NO_STOCK = "current_stock is not available"
NO_HISTORY = "current_stock does not vary: a single snapshot, not a history"


def daily_activity(sales: Sales) -> DataFrame:
    """Per product and day: units and the last stock reading of the day (if any)."""
    reading = F.max_by(
        F.col("current_stock"), F.when(F.col("current_stock").isNotNull(), F.col("_ord"))
    )
    return (
        sales.keyed()
        .where(F.col("date").isNotNull())
        .groupBy("product_id", F.to_date("date").alias("day"))
        .agg(zero_if_null(F.sum("quantity_sold")).alias("quantity"), reading.alias("stock"))
    )


def stock_readings(sales: Sales, activity: DataFrame | None = None) -> DataFrame:
    """The last reading of every day that has one, and the reading before it."""
    order = Window.partitionBy("product_id").orderBy("day")
    return (
        (daily_activity(sales) if activity is None else activity)
        .where(F.col("stock").isNotNull())
        .select("product_id", "day", "stock", F.lag("stock").over(order).alias("previous_stock"))
    )


def daily_stock(sales: Sales) -> DataFrame:
    """One row per calendar day between a product's first and last reading."""
    order = Window.partitionBy("product_id").orderBy("day")
    held = F.coalesce(F.date_sub(F.lead("day").over(order), 1), F.col("day"))
    return (
        daily_activity(sales)
        .where(F.col("stock").isNotNull())
        .select("product_id", "stock", F.col("day").alias("first"), held.alias("last"))
        .select("product_id", F.explode(F.sequence("first", "last")).alias("day"), "stock")
    )


def _ran_out(stock: Column, previous: Column) -> Column:
    return (previous > 0) & (stock <= 0)


def stockout_events(sales: Sales, activity: DataFrame | None = None) -> DataFrame:
    """Days on which stock went from positive to none.

    Between readings the stock stays as it was, so only reading days count.
    """
    return (
        stock_readings(sales, activity)
        .where(_ran_out(F.col("stock"), F.col("previous_stock")))
        .select("product_id", F.col("day").alias("stockout_date"))
    )


def stockout_counts(sales: Sales, activity: DataFrame | None = None) -> DataFrame:
    """One row: the number of stockout events over all products."""
    return stockout_events(sales, activity).agg(F.count(F.lit(1)).alias("events"))


def ml_gate(sales: Sales, activity: DataFrame | None = None) -> DataFrame:
    """One row: whether a classifier can be trained, else the reason.

    `activity` may hold the stored `daily_activity` of the sales.
    """
    if not sales.has("current_stock"):
        return sales.df.sparkSession.range(1).select(
            F.lit(False).alias("available"), F.lit(NO_STOCK).alias("reason")
        )
    histories = (
        sales.keyed()
        .groupBy("product_id")
        .agg(F.count_distinct("current_stock").alias("readings"))
        .agg(F.count_if(F.col("readings") >= MIN_READINGS).alias("with_history"))
    )
    found = histories.withColumn("events", stockout_counts(sales, activity).scalar())
    few = F.format_string(
        f"%d stockouts in the history; at least {MIN_EVENTS} are needed", "events"
    )
    reason = F.when(F.col("with_history") == 0, NO_HISTORY).when(F.col("events") < MIN_EVENTS, few)
    return found.select(reason.isNull().alias("available"), reason.alias("reason"))


def _spans(activity: DataFrame) -> DataFrame:
    """Per product the first and last day of demand, and its snapshot days."""
    has_stock = F.col("stock").isNotNull()
    spans = activity.groupBy("product_id").agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.min(F.when(has_stock, F.col("day"))).alias("first_reading"),
        F.max(F.when(has_stock, F.col("day"))).alias("last_reading"),
    )
    return spans.withColumns(
        {
            "start": F.date_add("first_reading", LOOKBACK),
            "end": F.date_sub("last_reading", LOOKAHEAD),
        }
    ).where(F.col("start") <= F.col("end"))


def snapshots(sales: Sales) -> DataFrame:
    """Every seventh day that has a full look-back and look-ahead in the readings."""
    return _snapshot_rows(daily_activity(sales)).select("product_id", "snapshot_date")


def _snapshot_rows(activity: DataFrame) -> DataFrame:
    days = F.sequence("start", "end", F.expr(f"INTERVAL {SNAPSHOT_EVERY} DAYS"))
    return _spans(activity).select(
        "product_id", "first_day", "last_day", F.explode(days).alias("snapshot_date")
    )


def _block_features(t, quantity, stock, sizes, ids) -> tuple[np.ndarray, ...]:
    """Features of every snapshot of a block of products, whose days lie one product after the other.

    A day is looked up by product and day number in one, so a search never leaves its product.
    """
    product = np.repeat(np.arange(len(sizes)), sizes)
    key = product * DAYS + t
    first_t, last_t = t[np.cumsum(sizes) - sizes], t[np.cumsum(sizes) - 1]
    read = np.flatnonzero(~np.isnan(stock))
    read_key, level, of = key[read], stock[read], product[read]
    fallen = np.flatnonzero((of[1:] == of[:-1]) & (level[1:] <= 0) & (level[:-1] > 0)) + 1
    event_key = read_key[fallen]
    begins, ends = (np.searchsorted(of, np.arange(len(sizes)), side) for side in ("left", "right"))
    with_reading = np.flatnonzero(ends > begins)
    start, stop = np.zeros(len(sizes), np.int64), np.full(len(sizes), -1)
    start[with_reading] = t[read[begins[with_reading]]] + LOOKBACK
    stop[with_reading] = t[read[ends[with_reading] - 1]] - LOOKAHEAD
    count = np.where(stop >= start, (stop - start) // SNAPSHOT_EVERY + 1, 0)

    at = np.repeat(np.arange(len(sizes)), count)
    s = start[at] + SNAPSHOT_EVERY * (np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count))
    lo_t = np.maximum(s - (LOOKBACK - 1), first_t[at])
    n = (np.minimum(s, last_t[at]) - lo_t + 1).astype(float)
    enough = n >= LOOKBACK // 2
    at, s, lo_t, n = at[enough], s[enough], lo_t[enough], n[enough]
    here = at * DAYS + s
    lo, hi = np.searchsorted(key, here - (LOOKBACK - 1)), np.searchsorted(key, here, "right")
    total, squares, moment = (_sums(x, lo, hi) for x in (quantity, quantity * quantity, quantity * t))
    stock_now = level[np.searchsorted(read_key, here, "right") - 1]
    ahead = np.searchsorted(event_key, here + LOOKAHEAD, "right") > np.searchsorted(event_key, here, "right")
    with np.errstate(all="ignore"):
        mean = total / n
        spread = np.sqrt(np.maximum(squares - total * mean, 0.0) / (n - 1))
        cover = np.where(mean > 0, np.minimum(stock_now / mean, MAX_COVER), MAX_COVER)
        volatility = np.where(mean > 0, spread / mean, 0.0)
    slope = (moment - lo_t * total - total * (n - 1) / 2) / (n * (n * n - 1) / 12)
    return ids.take(pa.array(at)), s.astype(np.int32), cover, volatility, slope, total, ahead.astype(np.int32)


def _sums(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sum of x over [lo, hi) for each pair, added up directly, 0 where empty."""
    if not len(lo):
        return np.zeros(0)
    bounds = np.stack([lo, hi], axis=1).ravel()
    return np.where(hi > lo, np.add.reduceat(np.append(x, 0.0), bounds)[::2], 0.0)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        days = batch.column("days")
        offsets = days.offsets.to_numpy().astype(np.int64)
        flat = days.flatten()
        t, quantity, stock = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        offsets, t, stock = offsets - offsets[0], t.astype(np.int64), stock.astype(float)
        # What a product costs: its days, and its snapshots at most.
        span = (t[offsets[1:] - 1] - t[offsets[:-1]]) // SNAPSHOT_EVERY + 1
        cost = np.cumsum(np.diff(offsets) + span)
        for a, b in _blocks(cost):
            part = slice(offsets[a], offsets[b])
            ids = batch.column("product_id").slice(a, b - a)
            found = _block_features(t[part], quantity[part], stock[part], np.diff(offsets[a : b + 1]), ids)
            arrays = [found[0], pa.array(found[1]).cast(pa.date32()), *map(pa.array, found[2:])]
            yield pa.RecordBatch.from_arrays(arrays, names=["product_id", "snapshot_date", *FEATURES, "stockout_occurred"])


def _blocks(cost: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose running `cost` grows by about BLOCK_ROWS each, one row at least."""
    a = 0
    while a < len(cost):
        spent = cost[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(cost, spent + BLOCK_ROWS, "right")))
        yield a, b
        a = b


def feature_table(sales: Sales, activity: DataFrame | None = None) -> DataFrame:
    """One row per product and snapshot: trailing features and the look-ahead label.

    The days of a product, one entry per day with data, come together in one row; the
    snapshots of many products are then worked out at once, by search among those
    days. `activity` may hold the stored `daily_activity` of the sales.
    """
    activity = daily_activity(sales) if activity is None else activity
    entry = F.struct(
        F.unix_date("day").alias("t"), F.col("quantity").cast("double").alias("quantity"),
        F.col("stock").cast("double").alias("stock"),
    )
    spread = activity.repartition(heavy_tasks(activity.sparkSession), "product_id")
    histories = spread.groupBy("product_id").agg(F.array_sort(F.collect_list(entry)).alias("days"))
    numbers = ", ".join(f"{f} double" for f in FEATURES)
    return histories.mapInArrow(
        _feature_batches, f"product_id string, snapshot_date date, {numbers}, stockout_occurred int"
    )
