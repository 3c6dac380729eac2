"""Matching raw column names to the contract, for a whole catalogue of sources."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.plans.lookup import join_lookup
from granary.schema import (
    CANONICAL_FIELDS, FIELD_DEFAULTS, FIELD_TYPES, ORDER_COLUMN, REQUIRED_FIELDS, Sales,
)
from granary.session import materialize

# Known names per field (the field's own name counts too).
ALIASES = {
    "date": [
        "date", "invoicedate", "invoice_date", "order_date", "orderdate",
        "transaction_date", "transactiondate", "txn_date", "dt", "timestamp",
    ],
    "product_id": [
        "product_id", "productid", "stockcode", "stock_code", "sku",
        "item_id", "itemid", "item_code", "product_code",
    ],
    "quantity_sold": [
        "quantity_sold", "quantity", "qty", "units_sold", "unitssold",
        "units", "demand", "sales_qty", "sold_qty",
    ],
    "product_name": [
        "product_name", "productname", "description", "item_name",
        "item_description", "name", "title",
    ],
    "category": [
        "category", "product_category", "item_category", "family",
        "product_family", "type", "segment",
    ],
    "unit_price": [
        "unit_price", "unitprice", "price", "sale_price", "saleprice", "selling_price",
    ],
    "unit_cost": [
        "unit_cost", "unitcost", "cost", "cost_price", "costprice", "purchase_price",
    ],
    "warehouse_id": [
        "warehouse_id", "warehouseid", "warehouse", "location",
        "location_id", "store_id", "store", "site", "site_id",
    ],
    "current_stock": [
        "current_stock", "stock", "stock_level", "stocklevel", "inventory",
        "inventory_level", "on_hand", "onhand", "quantity_on_hand",
    ],
    "lead_time_days": [
        "lead_time_days", "lead_time", "leadtime", "supplier_lead_time",
        "delivery_time", "days_to_deliver",
    ],
}
# The least score of a suggestion, and how close a rival is.
THRESHOLD = 75.0
AMBIGUITY_MARGIN = 5.0
FIELD_NAMES = [name for name, _, _, _ in CANONICAL_FIELDS]


class MappingError(ValueError):
    """A mapping that must not be applied."""


@dataclass
class FieldMapping:
    """Which raw column feeds which field, and whether a person has confirmed it."""

    columns: dict[str, str] = field(default_factory=dict)
    confirmed: bool = False

    def missing_required(self) -> list[str]:
        return [f for f in REQUIRED_FIELDS if f not in self.columns]


def normalize_name(c: Column) -> Column:
    """Trimmed, lower case, blanks and dashes as underscore, other signs dropped."""
    joined = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
    return F.regexp_replace(joined, r"[^\w]", "")


def _alias_table() -> Column:
    """All (field, alias) with, for each letter of the alias, one bit per place where it stands.

    One literal: an alias has up to 62 letters, so its places fit one long.
    """
    rows = []
    for f in FIELD_NAMES:
        for alias in dict.fromkeys([f, *ALIASES[f]]):
            places = {c: sum(1 << i for i, x in enumerate(alias) if x == c) for c in alias}
            letters = ", ".join(f"'{c}', {m}L" for c, m in places.items())
            rows.append(
                f"named_struct('field', '{f}', 'size', {len(alias)}, "
                f"'full', {(1 << len(alias)) - 1}L, 'places', map({letters}))"
            )
    return F.expr(f"array({', '.join(rows)})")


def _common_subsequence(name: Column, places: Column, full: Column, size: Column) -> Column:
    """Length of the longest common subsequence of a name and an alias given by its places.

    A row of the usual table differs from place to place by 0 or 1; the bits of one
    long hold where it does not, and each letter of the name turns them into the
    next row with an addition.
    """
    def next_row(row: Column, letter: Column) -> Column:
        here = F.coalesce(F.try_element_at(places, letter), F.lit(0).cast("long"))
        kept = row.bitwiseAND(F.bitwise_not(here))
        return (row + row.bitwiseAND(here)).bitwiseOR(kept).bitwiseAND(full)

    return size - F.bit_count(F.aggregate(F.split(name, ""), full, next_row))


def column_scores(catalogue: DataFrame) -> DataFrame:
    """Best similarity of each distinct raw column name to each field.

    Similarity is 0 to 100: twice the common subsequence over the joint length.
    Names are scored once however many sources use them; the fixed alias list is
    unfolded next to each name, so nothing is joined.
    """
    names = catalogue.select("raw_column", normalize_name(F.col("raw_column")).alias("name")).distinct()
    common = _common_subsequence(F.col("name"), F.col("places"), F.col("full"), F.col("size"))
    return (
        names.select("raw_column", "name", F.inline(_alias_table()))
        .withColumn("score", common * 200.0 / (F.length("name") + F.col("size")))
        .groupBy("raw_column", "field")
        .agg(F.max("score").alias("score"))
    )


def _scored_columns(catalogue: DataFrame) -> DataFrame:
    """Every column of every source with its ten scores.

    A name that very many sources share is a hot key of this join.
    """
    scores = column_scores(catalogue).groupBy("raw_column").agg(
        F.collect_list(F.struct("field", "score")).alias("scores")
    )
    held = catalogue.groupBy("raw_column").agg(F.count(F.lit(1)).alias("held"))
    lookup = materialize(scores.join(held, "raw_column"))
    total = lookup.agg(F.sum("held")).scalar()
    found = join_lookup(
        catalogue, lookup.withColumn("total", total), ["raw_column"], "held", "total"
    )
    return found.select("source_id", "position", "raw_column", F.inline("scores"))


def suggest_mappings(
    catalogue: DataFrame, threshold: float = THRESHOLD, margin: float = AMBIGUITY_MARGIN
) -> DataFrame:
    """A suggested field for the columns of every source in the catalogue.

    `catalogue` has (source_id, position, raw_column). The best pair of field
    and column goes first, then the best pair of what is left, while the score
    reaches the threshold; ties go by field order, then column order. A field
    with another free column within `margin` of its best is ambiguous: its
    column is used up but not mapped; `mapping_rivals` lists the others.

    At most nine columns can be used up before a field's turn, so its ten best
    columns decide, and one source contributes a short list however many columns
    it has. The rivals, of which there may be many, are found by a join.
    """
    taken, rivals = _claims(catalogue, threshold, margin)
    rivals = rivals.groupBy("source_id", "field").agg(F.count(F.lit(1)).alias("rivals"))
    return taken.join(rivals, ["source_id", "field"], "left").select(
        "source_id",
        "field",
        "raw_column",
        "score",
        F.coalesce("rivals", F.lit(0)).alias("rivals"),
        F.when(F.col("rivals").isNull(), "mapped").otherwise("ambiguous").alias("status"),
    )


def mapping_rivals(
    catalogue: DataFrame, threshold: float = THRESHOLD, margin: float = AMBIGUITY_MARGIN
) -> DataFrame:
    """The columns a person may choose instead, with their scores: one row per ambiguous field and rival."""
    _, rivals = _claims(catalogue, threshold, margin)
    names = catalogue.select("source_id", "position", "raw_column")
    return rivals.join(names, ["source_id", "position"]).select(
        "source_id", "field", "raw_column", F.col("rival_score").alias("score")
    )


def _claims(catalogue: DataFrame, threshold: float, margin: float) -> tuple[DataFrame, DataFrame]:
    """The pairs that were claimed, and every field's free columns close to its own."""
    fields = F.array(*[F.lit(f) for f in FIELD_NAMES])
    eligible = materialize(
        _scored_columns(catalogue)
        .where(F.col("score") >= threshold - margin)
        .withColumn("field_no", F.array_position(fields, F.col("field")))
    )
    order = F.struct(
        (-F.col("score")).alias("minus_score"), "field_no", "position", "field", "raw_column"
    )
    best = _best_columns(eligible.where(F.col("score") >= threshold), order)
    picks = F.aggregate(
        F.array_sort("pairs"),
        F.slice("pairs", 1, 0),
        lambda taken, pair: F.when(
            F.exists(
                taken,
                lambda t: (t["field"] == pair["field"]) | (t["position"] == pair["position"]),
            ),
            taken,
        ).otherwise(F.concat(taken, F.array(pair))),
    )
    turns = best.select("source_id", F.posexplode(picks).alias("turn", "pair"))
    taken = materialize(
        turns.select(
            "source_id",
            "turn",
            F.col("pair.field").alias("field"),
            F.col("pair.position").alias("position"),
            F.col("pair.raw_column").alias("raw_column"),
            (-F.col("pair.minus_score")).alias("score"),
        )
    )
    used = taken.select("source_id", "position", F.col("turn").alias("used_turn"))
    held = eligible.groupBy("source_id", "field").agg(F.count(F.lit(1)).alias("held"))
    winners = (
        taken.select("source_id", "field", "turn", "score", F.col("position").alias("best_position"))
        .join(held, ["source_id", "field"])
        .withColumn("total", eligible.agg(F.count(F.lit(1))).scalar())
    )
    pairs = eligible.select(
        "source_id", "field", "position", F.col("score").alias("rival_score")
    )
    rivals = (
        join_lookup(pairs, winners, ["source_id", "field"], "held", "total")
        .where(
            (F.col("position") != F.col("best_position"))
            & (F.col("score") - F.col("rival_score") <= margin)
        )
        .join(used, ["source_id", "position"], "left")
        .where(F.col("used_turn").isNull() | (F.col("used_turn") > F.col("turn")))
        .select("source_id", "field", "position", "rival_score")
    )
    return taken, rivals


def _best_columns(pairs: DataFrame, order: Column) -> DataFrame:
    """Per source, the ten best pairs of every field, as one array.

    Ranked per slice of positions first, so a source with very many columns is
    reduced before its rows meet.
    """
    keep = len(FIELD_NAMES)
    sliced = pairs.withColumn("pair", order).withColumn("slice", F.col("position") % 64)
    for keys in (["source_id", "field", "slice"], ["source_id", "field"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("pair"))
        sliced = sliced.withColumn("rank", rank).where(F.col("rank") <= keep)
    return sliced.groupBy("source_id").agg(F.collect_list("pair").alias("pairs"))


def unmapped_columns(catalogue: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Columns that no field, mapped or ambiguous, has taken."""
    taken = suggestions.select("source_id", "raw_column")
    return catalogue.join(taken, ["source_id", "raw_column"], "left_anti")


def apply_mapping(raw: DataFrame, mapping: FieldMapping) -> Sales:
    """The canonical table of a confirmed mapping; numbers and dates stay as they are.

    Text fields become text, absent fields their default or null, and raw
    columns without a field are dropped. Cleaning does the remaining coercion.
    """
    if not mapping.confirmed:
        raise MappingError("the mapping has not been confirmed")
    missing = mapping.missing_required()
    if missing:
        raise MappingError(f"required fields without a column: {', '.join(missing)}")
    columns = []
    for name in FIELD_NAMES:
        text = FIELD_TYPES[name].simpleString() == "string"
        if name in mapping.columns:
            source = F.col(f"`{mapping.columns[name]}`")
            columns.append((source.cast("string") if text else source).alias(name))
        else:
            columns.append(F.lit(FIELD_DEFAULTS[name]).cast(FIELD_TYPES[name]).alias(name))
    if ORDER_COLUMN in raw.columns:
        columns.append(F.col(ORDER_COLUMN))
    known = {
        f: FIELD_DEFAULTS[f] is not None for f in FIELD_NAMES if f not in mapping.columns
    }
    return Sales(raw.select(*columns), known)
