"""Canonical sales views over the test tables (and the same views as SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.schema import OPTIONAL_FIELDS, Sales

ALL_KNOWN = {f: True for f in ["quantity_sold", *OPTIONAL_FIELDS]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined to part, on the canonical schema, plus return flag and brand."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    stock = F.greatest(
        F.lit(0), (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 60 - 12
    ).cast("double")
    # To the cent; floor keeps ties the same in both engines.
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100.0
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_shipdate").alias("date"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_quantity").alias("quantity_sold"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        price.alias("unit_price"),
        F.col("p_retailprice").alias("unit_cost"),
        F.col("l_suppkey").cast("string").alias("warehouse_id"),
        stock.alias("current_stock"),
        (F.lit(1) + F.col("l_suppkey") % 14).cast("double").alias("lead_time_days"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias(
            "_ord"
        ),
        F.col("l_returnflag").alias("return_flag"),
        F.col("p_brand").alias("brand"),
    )


def sales(spark: SparkSession, sf_dir: str) -> Sales:
    return Sales(sales_rows(spark, sf_dir).drop("return_flag", "brand"), dict(ALL_KNOWN))


def sales_returns(spark: SparkSession, sf_dir: str) -> Sales:
    """Lines flagged as returned count as negative units."""
    signed = F.when(F.col("return_flag") == "R", -F.col("quantity_sold")).otherwise(
        F.col("quantity_sold")
    )
    rows = sales_rows(spark, sf_dir).withColumn("quantity_sold", signed)
    return Sales(rows.drop("return_flag", "brand"), dict(ALL_KNOWN))


def sales_launches(spark: SparkSession, sf_dir: str) -> Sales:
    """Some names sell nothing before, some nothing after the middle, some nothing at all."""
    first, old = F.substring("product_name", 1, 1), F.col("date") < F.lit("1998-06-01").cast("timestamp_ntz")
    none = ((first == "b") & old) | ((first == "c") & ~old) | (first == "h")
    rows = sales_rows(spark, sf_dir).withColumn("quantity_sold", F.when(none, 0.0).otherwise(F.col("quantity_sold")))
    return Sales(rows.drop("return_flag", "brand"), dict(ALL_KNOWN))


def sales_brand(spark: SparkSession, sf_dir: str) -> Sales:
    """The brand as product: few products, dense daily series."""
    rows = sales_rows(spark, sf_dir).withColumns(
        {"product_id": F.col("brand"), "product_name": F.col("brand")}
    )
    return Sales(rows.drop("return_flag", "brand"), dict(ALL_KNOWN))


def sales_minimal(spark: SparkSession, sf_dir: str) -> Sales:
    """Only the required fields carry values."""
    lines = table(spark, sf_dir, "lineitem")
    none = {f: F.lit(None).cast("string") for f in ("product_name", "category")}
    none |= {
        f: F.lit(None).cast("double")
        for f in ("unit_price", "unit_cost", "current_stock", "lead_time_days")
    }
    rows = lines.select(
        F.col("l_shipdate").alias("date"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_quantity").alias("quantity_sold"),
        F.lit("main").alias("warehouse_id"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias(
            "_ord"
        ),
    ).withColumns(none)
    return Sales(rows, {f: f == "warehouse_id" for f in OPTIONAL_FIELDS} | {"quantity_sold": True})


def sales_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column as text, with defects that depend on the order key."""
    order = F.col("_ord.l_orderkey")
    text_date = F.date_format("date", "yyyy-MM-dd")
    rows = sales_rows(spark, sf_dir)
    return rows.select(
        F.when(order % 50 == 0, "not-a-date")
        .when(order % 50 == 1, "1985-06-01")
        .when(order % 50 == 2, F.date_format("date", "M/d/yyyy"))
        .otherwise(text_date)
        .alias("date"),
        F.when(order % 40 == 3, None).otherwise(F.col("product_id")).alias("product_id"),
        F.when(order % 60 == 5, "ten")
        .when(order % 60 == 7, "-3")
        .otherwise(F.col("quantity_sold").cast("int").cast("string"))
        .alias("quantity_sold"),
        "product_name",
        "category",
        F.col("unit_price").cast("decimal(18,2)").cast("string").alias("unit_price"),
        F.when(order % 30 == 9, "expensive")
        .otherwise(F.round("unit_cost", 2).cast("decimal(18,2)").cast("string"))
        .alias("unit_cost"),
        "warehouse_id",
        F.col("current_stock").cast("int").cast("string").alias("current_stock"),
        F.col("lead_time_days").cast("int").cast("string").alias("lead_time_days"),
        "_ord",
    )


#: Raw headers of a supplier's file and the fields they are mapped to.
RAW_HEADERS = {
    "date": "InvoiceDate", "product_id": "StockCode", "quantity_sold": "Quantity", "product_name": "Item Name",
    "category": "Product.Family", "unit_price": "Price", "unit_cost": "Unit Cost", "warehouse_id": "Store ID",
    "current_stock": "On-Hand", "lead_time_days": "Lead Time",
}


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales under raw headers, keys as numbers, with a column that no field takes."""
    rows = sales_rows(spark, sf_dir)
    keys = {"product_id": F.col("_ord.l_partkey"), "warehouse_id": F.col("_ord.l_suppkey")}
    return rows.select("brand", *[keys.get(f, F.col(f)).alias(h) for f, h in RAW_HEADERS.items()])


def sales_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three in five dates cannot be read, some prices and costs are negative."""
    order = F.col("_ord.l_orderkey")
    rows = sales_rows(spark, sf_dir).drop("return_flag", "brand")
    return rows.withColumns(
        {
            "date": F.when(order % 5 < 3, "soon").otherwise(F.date_format("date", "yyyy-MM-dd")),
            "unit_price": F.when(order % 35 == 4, -F.col("unit_price")).otherwise(F.col("unit_price")),
            "unit_cost": F.when(order % 21 == 2, -F.col("unit_cost")).otherwise(F.col("unit_cost")),
        }
    )


def events_sales(spark: SparkSession, sf_dir: str) -> Sales:
    """Event values as sales: sub-day timestamps over a month."""
    rows = table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp_ntz").alias("date"),
        F.col("user_id").cast("string").alias("product_id"),
        F.col("value").alias("quantity_sold"),
        F.lit(None).cast("string").alias("product_name"),
        F.col("event_type").alias("category"),
        F.lit(None).cast("double").alias("unit_price"),
        F.lit(None).cast("double").alias("unit_cost"),
        F.lit("main").alias("warehouse_id"),
        F.lit(None).cast("double").alias("current_stock"),
        F.lit(None).cast("double").alias("lead_time_days"),
        F.col("event_id").alias("_ord"),
    )
    known = {f: f in ("category", "warehouse_id") for f in OPTIONAL_FIELDS}
    return Sales(rows, known | {"quantity_sold": True})


# Header spellings that suppliers' files use in the catalogue view.
HEADERS = [
    "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Country", "qty",
    "Unit Cost", "On-Hand", "Store ID", "Lead Time", "Order Date", "Item Name", "SKU",
    "Product Family", "Sale Price ($)", "Customer", "units sold",
]


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column headers of one file per supplier and month; its lines decide which it has."""
    headers = F.array(*[F.lit(h) for h in HEADERS])
    pick = (F.col("l_partkey") + F.col("l_linenumber") * F.col("l_suppkey")) % len(HEADERS)
    source = F.concat_ws("/", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM"))
    return (
        table(spark, sf_dir, "lineitem")
        .select(source.alias("source_id"), pick.cast("int").alias("position"))
        .distinct()
        .select("source_id", "position", F.get(headers, F.col("position")).alias("raw_column"))
    )


SALES_SQL = """
sales AS (
  SELECT l_shipdate AS date, CAST(l_partkey AS VARCHAR) AS product_id, l_quantity AS quantity_sold,
         p_name AS product_name, p_type AS category, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100.0 AS unit_price,
         p_retailprice AS unit_cost, CAST(l_suppkey AS VARCHAR) AS warehouse_id,
         CAST(greatest(0, (l_orderkey * 7 + l_linenumber * 13) % 60 - 12) AS DOUBLE) AS current_stock,
         CAST(1 + l_suppkey % 14 AS DOUBLE) AS lead_time_days,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, p_brand
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""
# Position of a row in the input order, for a list sorted by it.
ORD_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, date"

RETURNS_SQL = (
    SALES_SQL.replace("sales AS", "base AS", 1)
    + """,
sales AS (
  SELECT * REPLACE (CASE WHEN l_returnflag = 'R' THEN -quantity_sold ELSE quantity_sold END AS quantity_sold)
  FROM base
)"""
)
LAUNCHES_SQL = (
    SALES_SQL.replace("sales AS", "base AS", 1)
    + """,
sales AS (
  SELECT * REPLACE (CASE WHEN product_name LIKE 'b%' AND date < '1998-06-01' OR product_name LIKE 'c%' AND date >= '1998-06-01'
                           OR product_name LIKE 'h%' THEN 0 ELSE quantity_sold END AS quantity_sold)
  FROM base
)"""
)
BRAND_SQL = (
    SALES_SQL.replace("sales AS", "base AS", 1)
    + """,
sales AS (SELECT * REPLACE (p_brand AS product_id, p_brand AS product_name) FROM base)"""
)
DIRTY_SQL = (
    SALES_SQL
    + """,
dirty AS (
  SELECT CASE WHEN l_orderkey % 50 = 0 THEN 'not-a-date'
              WHEN l_orderkey % 50 = 1 THEN '1985-06-01'
              WHEN l_orderkey % 50 = 2 THEN month(date) || '/' || day(date) || '/' || year(date)
              ELSE strftime(date, '%Y-%m-%d') END AS date,
         CASE WHEN l_orderkey % 40 = 3 THEN NULL ELSE product_id END AS product_id,
         CASE WHEN l_orderkey % 60 = 5 THEN 'ten' WHEN l_orderkey % 60 = 7 THEN '-3'
              ELSE CAST(CAST(quantity_sold AS INTEGER) AS VARCHAR) END AS quantity_sold,
         product_name, category, CAST(unit_price AS DECIMAL(18,2)) AS unit_price,
         CASE WHEN l_orderkey % 30 = 9 THEN 'expensive'
              ELSE CAST(CAST(unit_cost AS DECIMAL(18,2)) AS VARCHAR) END AS unit_cost,
         warehouse_id, CAST(CAST(current_stock AS INTEGER) AS VARCHAR) AS current_stock,
         CAST(CAST(lead_time_days AS INTEGER) AS VARCHAR) AS lead_time_days,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, sales.date AS ship
  FROM sales
),
typed AS (
  SELECT * REPLACE (
           coalesce(TRY_STRPTIME(date, '%Y-%m-%d'), TRY_STRPTIME(date, '%m/%d/%Y')) AS date,
           TRY_CAST(quantity_sold AS DOUBLE) AS quantity_sold,
           CAST(unit_price AS DOUBLE) AS unit_price, TRY_CAST(unit_cost AS DOUBLE) AS unit_cost,
           TRY_CAST(current_stock AS DOUBLE) AS current_stock,
           TRY_CAST(lead_time_days AS DOUBLE) AS lead_time_days),
         date AS raw_date, quantity_sold AS raw_quantity, unit_cost AS raw_cost
  FROM dirty
)"""
)
