"""The same results in DuckDB SQL, written from the definitions."""

from __future__ import annotations

from granary.operators import mapping
from workload.views import HEADERS, BRAND_SQL, DIRTY_SQL, LAUNCHES_SQL, ORD_SQL, RETURNS_SQL, SALES_SQL

ORACLE = {}


def sql(name: str, text: str, base: str = SALES_SQL):
    """Register `text`, a list of CTEs and a final SELECT, after the view `base`."""
    ORACLE[name] = f"WITH {base}{text}" if base else text


DAY = "CAST({0} AS DATE)"
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
MINIMAL_SQL = """
sales AS (
  SELECT l_shipdate AS date, CAST(l_partkey AS VARCHAR) AS product_id, l_quantity AS quantity_sold
  FROM lineitem
)"""
EVENTS_SQL = """
sales AS (
  SELECT ts AS date, CAST(user_id AS VARCHAR) AS product_id, value AS quantity_sold,
         event_type AS category
  FROM events
)"""

# --- canonical table -------------------------------------------------------

sql(
    "canonical_sales",
    f"""
SELECT {TS.format('date')} AS date, product_id, quantity_sold, product_name, category,
       unit_price, unit_cost, warehouse_id, current_stock, lead_time_days
FROM sales""",
)
ORACLE["mapped_sales"] = ORACLE["canonical_sales"]
_fields = [
    ("date", True), ("product_id", True), ("quantity_sold", True), ("product_name", False),
    ("category", False), ("unit_price", False), ("unit_cost", False), ("warehouse_id", False),
    ("current_stock", False), ("lead_time_days", False),
]
sql(
    "field_availability",
    "\n"
    + "\nUNION ALL ".join(
        f"SELECT '{f}' AS field, {str(r).lower()} AS required, count({f}) > 0 AS available FROM sales"
        for f, r in _fields
    ),
)
_have = {"date", "product_id", "quantity_sold", "warehouse_id"}
sql(
    "field_availability_minimal",
    "\n"
    + "\nUNION ALL ".join(
        f"SELECT '{f}' AS field, {str(r).lower()} AS required, "
        f"{'count(*) > 0' if f in _have else 'count(*) < 0'} AS available FROM lineitem"
        for f, r in _fields
    ),
    base="z AS (SELECT 1)",
)

# --- KPIs ------------------------------------------------------------------

DAILY = """,
daily AS (
  SELECT product_id, CAST(date AS DATE) AS day, sum(quantity_sold) AS quantity
  FROM sales GROUP BY ALL
),
stats AS (
  SELECT product_id, avg(quantity) AS mean_daily_demand,
         coalesce(stddev_samp(quantity), 0) AS std_daily_demand
  FROM daily GROUP BY ALL
)"""
LEADS = """,
leads AS (SELECT product_id, avg(lead_time_days) AS lead FROM sales GROUP BY ALL),
buffers AS (
  SELECT product_id, mean_daily_demand, std_daily_demand, lead,
         1.65 * std_daily_demand * sqrt(lead) AS safety,
         mean_daily_demand * lead + 1.65 * std_daily_demand * sqrt(lead) AS reorder
  FROM stats JOIN leads USING (product_id) WHERE lead IS NOT NULL
)"""
TURNOVER = """,
turn AS (
  SELECT product_id, sum(quantity_sold) AS total_quantity_sold, avg(current_stock) AS avg_inventory,
         sum(quantity_sold) / avg(current_stock) AS turnover_ratio,
         CASE WHEN count(DISTINCT current_stock) > 1 THEN 'historical_average'
              ELSE 'single_snapshot_approximation' END AS inventory_data_type
  FROM sales GROUP BY product_id HAVING avg(current_stock) > 0
)"""
COVER = f""",
newest AS (
  SELECT product_id, current_stock AS latest_stock FROM sales WHERE current_stock IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY product_id
    ORDER BY date DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1
),
cover AS (
  SELECT product_id, latest_stock, rate AS avg_daily_demand, latest_stock / rate AS days_of_inventory
  FROM (SELECT product_id, sum(quantity_sold)
               / (SELECT greatest(date_diff('day', min(date), max(date)), 1) FROM sales) AS rate
        FROM sales GROUP BY product_id)
  LEFT JOIN newest USING (product_id)
  WHERE rate > 0
)"""


def abc(value: str) -> str:
    return f""",
valued AS (SELECT product_id, sum({value}) AS value FROM sales GROUP BY product_id),
abc AS (
  SELECT product_id, value,
         sum(value) OVER (ORDER BY value DESC, product_id ROWS UNBOUNDED PRECEDING)
           / sum(value) OVER () AS pct
  FROM valued
),
abc_tiers AS (
  SELECT product_id, value, pct, CASE WHEN pct <= 0.8 THEN 'A' WHEN pct <= 0.95 THEN 'B' ELSE 'C' END AS tier
  FROM abc
)"""


XYZ = """,
xyz AS (
  SELECT *, CASE WHEN cv < 0.5 THEN 'X' WHEN cv < 1.0 THEN 'Y' ELSE 'Z' END AS xyz_tier
  FROM (SELECT *, std_daily_demand / mean_daily_demand AS cv FROM stats WHERE mean_daily_demand > 0)
)"""
IDLE = """,
span AS (SELECT min(date) AS first, max(date) AS last FROM sales),
moved AS (
  SELECT product_id, coalesce(sum(quantity_sold) FILTER (quantity_sold > 0), 0) AS gross,
         coalesce(-sum(quantity_sold) FILTER (quantity_sold < 0), 0) AS returned,
         sum(quantity_sold) AS net, max(date) AS last_sale
  FROM sales GROUP BY product_id
),
idle AS (
  SELECT product_id, gross AS gross_quantity_sold, returned AS returns, net AS net_quantity_sold,
         last_sale, date_sub('day', last_sale, (SELECT last FROM span)) AS days_since_last_sale,
         last_sale < (SELECT make_timestamp(epoch_us(last) - (epoch_us(last) - epoch_us(first)) // 4) FROM span)
           AS is_dead_stock,
         gross <= (SELECT quantile_cont(gross, 0.2) FROM moved) AS is_slow_mover
  FROM moved
)"""
IDLE_OUT = f"""
SELECT product_id, round(gross_quantity_sold, 6) AS gross_quantity_sold, round(returns, 6) AS returns,
       round(net_quantity_sold, 6) AS net_quantity_sold, {TS.format('last_sale')} AS last_sale_date,
       days_since_last_sale, is_dead_stock, is_slow_mover
FROM idle"""

sql(
    "turnover",
    TURNOVER
    + """
SELECT product_id, total_quantity_sold, round(avg_inventory, 6) AS avg_inventory,
       round(turnover_ratio, 6) AS turnover_ratio, inventory_data_type
FROM turn""",
)
sql(
    "days_of_inventory",
    COVER
    + """
SELECT product_id, latest_stock, round(avg_daily_demand, 6) AS avg_daily_demand,
       round(days_of_inventory, 6) AS days_of_inventory
FROM cover""",
)
sql(
    "abc_analysis",
    abc("quantity_sold * unit_price")
    + """
SELECT product_id, round(value, 2) AS value, round(pct, 6) AS cumulative_pct, tier, 'revenue' AS basis
FROM abc_tiers""",
)
sql(
    "abc_analysis_minimal",
    abc("quantity_sold")
    + """
SELECT product_id, round(value, 6) AS value, round(pct, 6) AS cumulative_pct, tier, 'quantity_sold' AS basis
FROM abc_tiers""",
    base=MINIMAL_SQL,
)
sql(
    "xyz_analysis",
    DAILY
    + XYZ
    + """
SELECT product_id, round(mean_daily_demand, 6) AS mean_daily_demand,
       round(std_daily_demand, 6) AS std_daily_demand, round(cv, 6) AS coefficient_of_variation, xyz_tier
FROM xyz""",
)
sql(
    "safety_stock",
    DAILY
    + LEADS
    + """
SELECT product_id, round(std_daily_demand, 6) AS std_daily_demand,
       round(lead, 6) AS lead_time_days_used, round(safety, 6) AS safety_stock
FROM buffers""",
)
sql(
    "reorder_point",
    DAILY
    + LEADS
    + """
SELECT product_id, round(mean_daily_demand, 6) AS avg_daily_demand, round(lead, 6) AS lead_time_days_used,
       round(safety, 6) AS safety_stock, round(reorder, 6) AS reorder_point
FROM buffers""",
)
sql(
    "reorder_point_minimal",
    DAILY
    + """
SELECT product_id, round(mean_daily_demand, 6) AS avg_daily_demand, 7.0::DOUBLE AS lead_time_days_used,
       round(1.65 * std_daily_demand * sqrt(7), 6) AS safety_stock,
       round(mean_daily_demand * 7 + 1.65 * std_daily_demand * sqrt(7), 6) AS reorder_point
FROM stats""",
    base=MINIMAL_SQL,
)
sql(
    "safety_stock_scenarios",
    DAILY
    + """
SELECT product_id, service_level, round(z * std_daily_demand * sqrt(lead), 6) AS safety_stock
FROM stats JOIN (SELECT product_id, avg(lead_time_days) AS lead FROM sales GROUP BY ALL) USING (product_id),
     (VALUES ('90%', 1.28::DOUBLE), ('95%', 1.65::DOUBLE), ('97.5%', 1.96::DOUBLE), ('99%', 2.33::DOUBLE))
       AS levels(service_level, z)""",
)
sql("dead_slow_stock", IDLE + IDLE_OUT, base=RETURNS_SQL)
sql("dead_slow_stock_events", IDLE + IDLE_OUT, base=EVENTS_SQL)
sql("flagged_stock", IDLE + IDLE_OUT + " WHERE is_dead_stock OR is_slow_mover", base=RETURNS_SQL)
sql(
    "lowest_cover",
    COVER
    + """
SELECT product_id, latest_stock, round(avg_daily_demand, 6) AS avg_daily_demand,
       round(days_of_inventory, 6) AS days_of_inventory
FROM cover WHERE days_of_inventory IS NOT NULL
ORDER BY cover.days_of_inventory, product_id LIMIT 10""",
)
sql(
    "tier_counts",
    DAILY
    + XYZ
    + abc("quantity_sold * unit_price")
    + """
SELECT 'abc' AS analysis, tier, count(*) AS products FROM abc_tiers GROUP BY ALL
UNION ALL SELECT 'xyz', xyz_tier, count(*) FROM xyz GROUP BY ALL""",
)
sql(
    "kpi_summary",
    DAILY
    + LEADS
    + XYZ
    + TURNOVER
    + COVER
    + IDLE
    + abc("quantity_sold * unit_price")
    + f"""
SELECT product_id, round(gross_quantity_sold, 6) AS gross_quantity_sold, round(returns, 6) AS returns,
       round(net_quantity_sold, 6) AS net_quantity_sold, {TS.format('last_sale')} AS last_sale_date,
       days_since_last_sale, is_dead_stock, is_slow_mover, round(avg_inventory, 6) AS avg_inventory,
       round(turnover_ratio, 6) AS turnover_ratio, latest_stock,
       round(days_of_inventory, 6) AS days_of_inventory, abc_tiers.tier AS abc_tier,
       round(cv, 6) AS coefficient_of_variation, xyz_tier,
       round(safety, 6) AS safety_stock, round(reorder, 6) AS reorder_point
FROM idle LEFT JOIN turn USING (product_id) LEFT JOIN cover USING (product_id)
LEFT JOIN abc_tiers USING (product_id) LEFT JOIN xyz USING (product_id)
LEFT JOIN buffers USING (product_id)""",
)

# --- exploration -----------------------------------------------------------

sql(
    "demand_over_time",
    """
SELECT strftime(date, '%Y-%m-%d') AS day, sum(quantity_sold) AS quantity_sold FROM sales GROUP BY 1""",
)
sql(
    "revenue_by_category",
    """
SELECT category, round(sum(quantity_sold * unit_price), 2) AS revenue FROM sales GROUP BY 1""",
)
sql(
    "top_products",
    """
SELECT product_name AS label, sum(quantity_sold) AS quantity_sold FROM sales GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10""",
)
_TRENDS = """,
span AS (SELECT epoch_us(min(date)) AS a, epoch_us(max(date)) AS b FROM sales),
early AS (SELECT product_name, avg(quantity_sold) AS m FROM sales, span
          WHERE epoch_us(date) <= a + (b - a) / 3.0 GROUP BY 1),
recent AS (SELECT product_name, avg(quantity_sold) AS m FROM sales, span
           WHERE epoch_us(date) >= b - (b - a) / 3.0 GROUP BY 1),
grown AS (SELECT product_name AS label, early.m = 0 AS from_zero,
            CASE WHEN early.m <> 0 THEN (recent.m - early.m) / early.m * 100
                 WHEN recent.m > 0 THEN CAST('Infinity' AS DOUBLE) WHEN recent.m < 0 THEN CAST('-Infinity' AS DOUBLE) END AS g
          FROM early JOIN recent USING (product_name))
SELECT label, CASE WHEN isinf(g) THEN g ELSE round(g, 6) END AS growth_percent, from_zero
FROM grown WHERE g IS NOT NULL ORDER BY g DESC, 1 LIMIT """
sql("trending_products", _TRENDS + "10")
sql("trending_products_launches", _TRENDS + "60", base=LAUNCHES_SQL)
LONG = """,
long AS (
  SELECT product_id, date, 'quantity_sold' AS field, quantity_sold AS value FROM sales
  UNION ALL SELECT product_id, date, 'unit_price', unit_price FROM sales
  UNION ALL SELECT product_id, date, 'unit_cost', unit_cost FROM sales
  UNION ALL SELECT product_id, date, 'current_stock', current_stock FROM sales
)"""


def box(keys: str) -> str:
    return f""",
quart AS (
  SELECT {keys}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.75) AS q3, count(*) AS n
  FROM long GROUP BY {keys}
),
limits AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM quart),
tagged AS (SELECT long.*, value >= lower_fence AND value <= upper_fence AS inside
           FROM long JOIN limits USING ({keys})),
ends AS (
  SELECT {keys}, min(value) AS minimum, max(value) AS maximum,
         min(value) FILTER (inside) AS lower_whisker, max(value) FILTER (inside) AS upper_whisker,
         count(*) FILTER (NOT inside) AS outliers
  FROM tagged GROUP BY {keys}
)
SELECT {keys}, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, n,
       round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence,
       round(minimum, 6) AS minimum, round(maximum, 6) AS maximum,
       round(lower_whisker, 6) AS lower_whisker, round(upper_whisker, 6) AS upper_whisker, outliers
FROM limits JOIN ends USING ({keys})"""


sql("distribution_summary", LONG + box("field"))
sql("product_distribution", LONG + box("product_id, field"))
sql(
    "outlier_points",
    LONG
    + f""",
quart AS (SELECT field, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1)
SELECT field, product_id, {TS.format('date')} AS date, round(value, 6) AS value
FROM long JOIN quart USING (field)
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
)
STATS = """
SELECT sum(quantity_sold) AS total_units_sold, count(DISTINCT product_id) AS distinct_products,
       date_sub('day', min(date), max(date)) AS date_range_days,
       {revenue} AS total_revenue{more}
FROM sales"""
sql("eda_stats", STATS.format(revenue="round(sum(quantity_sold * unit_price), 2)", more=""))
sql(
    "eda_overview",
    STATS.format(
        revenue="round(sum(quantity_sold * unit_price), 2)",
        more=""",
       'product_name, category, unit_price, unit_cost, warehouse_id, current_stock, lead_time_days' AS available_fields,
       '' AS unavailable_fields,
       'demand_over_time, revenue_by_category, top_products, distribution_quantity_sold, distribution_unit_price, '
       || 'distribution_unit_cost, distribution_current_stock' AS parts""",
    ),
)
sql(
    "eda_overview_events",
    STATS.format(
        revenue="NULL::DOUBLE",
        more=""",
       'category, warehouse_id' AS available_fields,
       'product_name, unit_price, unit_cost, current_stock, lead_time_days' AS unavailable_fields,
       'demand_over_time, top_products, distribution_quantity_sold' AS parts""",
    ).replace("sum(quantity_sold) AS", "round(sum(quantity_sold), 6) AS"),
    base=EVENTS_SQL,
)
sql(
    "product_labels",
    """,
named AS (SELECT DISTINCT product_id, product_name FROM sales)
SELECT product_id, CASE WHEN count(*) OVER (PARTITION BY product_name) > 1
                        THEN product_name || ' (' || product_id || ')' ELSE product_name END AS label
FROM named""",
)
sql(
    "product_stats",
    """
SELECT product_id, any_value(product_name) AS display_name, sum(quantity_sold) AS total_units_sold,
       date_sub('day', min(date), max(date)) AS date_range_days,
       round(sum(quantity_sold * unit_price), 2) AS total_revenue,
       round(sum((unit_price - unit_cost) * quantity_sold), 2) AS total_profit
FROM sales GROUP BY product_id""",
)
sql(
    "product_daily_demand",
    """
SELECT product_id, strftime(date, '%Y-%m-%d') AS day, sum(quantity_sold) AS quantity FROM sales GROUP BY 1, 2""",
    base=RETURNS_SQL,
)

# --- validation and cleaning -----------------------------------------------

NUM_LONG = """,
long AS (
  SELECT 'quantity_sold' AS field, quantity_sold AS value FROM typed WHERE quantity_sold IS NOT NULL
  UNION ALL SELECT 'unit_price', unit_price FROM typed WHERE unit_price IS NOT NULL
  UNION ALL SELECT 'unit_cost', unit_cost FROM typed WHERE unit_cost IS NOT NULL
  UNION ALL SELECT 'current_stock', current_stock FROM typed WHERE current_stock IS NOT NULL
),
quart AS (SELECT field, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n
          FROM long GROUP BY 1),
bounds AS (
  SELECT field, any_value(q1) AS q1, any_value(q3) AS q3, any_value(q1 - 1.5 * (q3 - q1)) AS lower_fence,
         any_value(q3 + 1.5 * (q3 - q1)) AS upper_fence, any_value(n) AS n,
         count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
  FROM long JOIN quart USING (field) GROUP BY field
),
cats AS (SELECT 'category' AS field, category AS value FROM dirty
         UNION ALL SELECT 'warehouse_id', warehouse_id FROM dirty),
rare AS (
  SELECT field, value, count(*) AS rows FROM cats GROUP BY field, value
  QUALIFY count(*) < 0.01 * sum(count(*)) OVER (PARTITION BY field)
)"""
_T = "(SELECT count(*) FROM dirty)"


def _count(position, name, severity, field, condition, keep="c > 0"):
    return (
        f"SELECT * FROM (SELECT {position} AS position, '{name}' AS check_name, {severity} AS severity, "
        f"'{field}' AS affected_field, count(*) FILTER ({condition}) AS c, count(*) AS n FROM typed) WHERE {keep}"
    )


_missing = "CASE WHEN c > 0.5 * n THEN 'error' ELSE 'warning' END"
_parts = [
    _count(2, "date_parseable", "'error'", "date", "date IS NULL", "c > 0.5 * n"),
    _count(4, "date_missing", "'warning'", "date", "raw_date IS NULL"),
    _count(5, "product_id_missing", "'warning'", "product_id", "product_id IS NULL"),
    _count(6, "quantity_sold_missing", "'warning'", "quantity_sold", "raw_quantity IS NULL"),
    _count(7, "quantity_sold_not_numeric", "'error'", "quantity_sold", "quantity_sold IS NULL"),
    _count(9, "unit_cost_not_numeric", "'error'", "unit_cost", "unit_cost IS NULL"),
    _count(11, "dates_in_future", "'warning'", "date", "date > TIMESTAMP '2001-06-01'"),
    _count(12, "dates_absurdly_old", "'warning'", "date", "date < TIMESTAMP '1990-01-01'"),
    _count(13, "negative_quantity_sold", "'warning'", "quantity_sold", "quantity_sold < 0"),
    _count(14, "unit_price_negative", "'warning'", "unit_price", "unit_price < 0"),
    _count(15, "unit_cost_negative", "'warning'", "unit_cost", "unit_cost < 0"),
]
ISSUES = (
    NUM_LONG
    + ",\nissues AS ("
    + "\nUNION ALL ".join(_parts)
    + """
UNION ALL
SELECT 15 + list_position(['quantity_sold', 'unit_price', 'unit_cost', 'current_stock'], field),
       field || '_outliers', 'warning', field, outliers, n FROM bounds WHERE outliers > 0
UNION ALL
SELECT 19 + list_position(['category', 'warehouse_id'], field), field || '_rare_values', 'warning', field,
       CAST(sum(rows) AS BIGINT), 0 FROM rare GROUP BY field)
SELECT CAST(position AS BIGINT) AS position, check_name, severity, affected_field, c AS affected_row_count
FROM issues"""
)
sql("validation_issues", ISSUES, base=DIRTY_SQL)
for _check in (
    "product_id_missing", "quantity_sold_not_numeric", "unit_cost_not_numeric", "dates_in_future",
    "dates_absurdly_old", "negative_quantity_sold", "unit_price_outliers", "warehouse_id_rare_values",
):
    sql(f"check_{_check}", ISSUES + f" WHERE check_name = '{_check}'", base=DIRTY_SQL)
UNREADABLE_SQL = SALES_SQL.replace("sales AS", "base AS", 1) + """,
sales AS (
  SELECT l_orderkey % 5 < 3 AS unread, l_orderkey % 35 = 4 AND unit_price > 0 AS below_price,
         l_orderkey % 21 = 2 AND unit_cost > 0 AS below_cost
  FROM base
)"""
for _position, _check, _severity, _field, _when, _least in (
    (2, "date_parseable", "error", "date", "unread", "count(*) / 2"),
    (14, "unit_price_negative", "warning", "unit_price", "below_price", 0),
    (15, "unit_cost_negative", "warning", "unit_cost", "below_cost", 0),
):
    sql(
        f"check_{_check}",
        f"""
SELECT {_position} AS position, '{_check}' AS check_name, '{_severity}' AS severity, '{_field}' AS affected_field,
       count(*) FILTER ({_when}) AS affected_row_count
FROM sales HAVING count(*) FILTER ({_when}) > {_least}""",
        base=UNREADABLE_SQL,
    )
_DAYS = "date_sub('day', min(date), max(date))"
sql(
    "check_minimum_date_span",
    f"""
SELECT 3 AS position, 'minimum_date_span' AS check_name, 'error' AS severity, 'date' AS affected_field,
       0 AS affected_row_count
FROM sales HAVING {_DAYS} < 30""",
    base=EVENTS_SQL,
)
_GATE = f"""
SELECT count(*) AS rows, {_DAYS} AS days, count(*) >= 50 AND {_DAYS} >= 30 AS enough,
       concat_ws('; ', CASE WHEN count(*) < 50 THEN count(*) || ' rows; at least 50 are needed' END,
                 CASE WHEN {_DAYS} < 30 THEN {_DAYS} || ' days of data; at least 30 are needed' END) AS reasons
FROM sales"""
sql("data_gate", _GATE)
sql("data_gate_short", _GATE, base=EVENTS_SQL)
sql(
    "outlier_bounds",
    NUM_LONG
    + """
SELECT field, round(q1, 6) AS q1, round(q3, 6) AS q3, round(lower_fence, 6) AS lower_fence,
       round(upper_fence, 6) AS upper_fence, n, outliers
FROM bounds""",
    base=DIRTY_SQL,
)
sql("rare_values", NUM_LONG + "\nSELECT field, value, rows FROM rare", base=DIRTY_SQL)
sql(
    "record_violations",
    "\n"
    + "\nUNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) FILTER ({f} < 0) AS violations FROM typed"
        for f in ("quantity_sold", "unit_price", "unit_cost", "current_stock", "lead_time_days")
    ),
    base=DIRTY_SQL,
)
_KEPT = "date IS NOT NULL AND product_id IS NOT NULL AND quantity_sold IS NOT NULL"
sql(
    "cleaned_rows",
    f"""
SELECT {TS.format('date')} AS date, product_id, quantity_sold, product_name, category, unit_price,
       unit_cost, warehouse_id, current_stock, lead_time_days
FROM typed WHERE {_KEPT}""",
    base=DIRTY_SQL,
)
sql(
    "cleaning_actions",
    f"""
SELECT 'date_parseable' AS check_name, 'dropped_rows' AS action, 'date' AS affected_field,
       count(*) FILTER (date IS NULL) AS affected_row_count FROM typed
UNION ALL SELECT 'required_field_missing', 'dropped_rows', NULL,
       count(*) FILTER (date IS NOT NULL AND (product_id IS NULL OR raw_quantity IS NULL)) FROM typed
UNION ALL SELECT 'quantity_sold_not_numeric', 'dropped_rows', 'quantity_sold',
       count(*) FILTER (date IS NOT NULL AND product_id IS NOT NULL AND quantity_sold IS NULL) FROM typed
UNION ALL SELECT 'unit_cost_not_numeric', 'coerced_to_null', 'unit_cost',
       count(*) FILTER ({_KEPT} AND unit_cost IS NULL) FROM typed""",
    base=DIRTY_SQL,
)
ORACLE["clean_log"] = ORACLE["cleaning_actions"]
sql(
    "cleaning_row_counts",
    f"""
SELECT count(*) AS rows_before, count(*) FILTER ({_KEPT}) AS rows_after FROM typed""",
    base=DIRTY_SQL,
)

# --- sources and mapping ---------------------------------------------------

sql(
    "load_summary",
    """
SELECT 'lineitem' AS source, 'parquet' AS format, count(*) AS row_count, CAST(11 AS BIGINT) AS column_count FROM lineitem""",
    base="z AS (SELECT 1)",
)
_headers = ", ".join("'" + h + "'" for h in HEADERS)
CATALOGUE_SQL = f"""
cat AS (
  SELECT DISTINCT l_suppkey || '/' || strftime(l_shipdate, '%Y-%m') AS source_id,
         (l_partkey + l_linenumber * l_suppkey) % {len(HEADERS)} AS position,
         [{_headers}][CAST(1 + (l_partkey + l_linenumber * l_suppkey) % {len(HEADERS)} AS INTEGER)] AS raw_column
  FROM lineitem
)"""
NORMALIZED = "regexp_replace(regexp_replace(lower(trim(raw_column)), '[\\s\\-]+', '_', 'g'), '[^\\w]', '', 'g')"
sql("normalize_names", f"\nSELECT source_id, position, raw_column, {NORMALIZED} AS normalized\nFROM cat", base=CATALOGUE_SQL)

_aliases = ", ".join(
    f"({no}, '{f}', '{alias}')"
    for no, f in enumerate(mapping.FIELD_NAMES, 1)
    for alias in dict.fromkeys([f, *mapping.ALIASES[f]])
)
# The common subsequence from rows of the usual table, kept as the bits of a number.
SCORES = f""",
aliases(field_no, field, alias) AS (VALUES {_aliases}),
paired AS (
  SELECT raw_column, name, field_no, field, alias, (1::BIGINT << length(alias)) - 1 AS filled
  FROM (SELECT DISTINCT raw_column, {NORMALIZED} AS name FROM cat), aliases
),
common AS (
  SELECT *, length(alias) - bit_count(list_reduce(
    list_prepend(filled, list_transform(string_split(name, ''), lambda c: CAST(list_sum(list_transform(
      range(1, length(alias) + 1), lambda i: CASE WHEN alias[i] = c THEN 1::BIGINT << (i - 1) ELSE 0 END)) AS BIGINT))),
    lambda row, here: ((row + (row & here)) | (row & ~here)) & filled)) AS n
  FROM paired
),
scores AS (
  SELECT raw_column, field_no, field, max(200.0 * n / (length(name) + length(alias))) AS score
  FROM common GROUP BY raw_column, field_no, field
)"""
CLAIMS = SCORES + """,
worth AS (SELECT source_id, position, raw_column, field_no, field, score FROM cat JOIN scores USING (raw_column)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, field_no, position) AS k
  FROM worth WHERE score >= 75
),
claims AS (
  SELECT source_id, 0::BIGINT AS k, 0::BIGINT AS fields, 0::BIGINT AS used, 0::BIGINT AS used_before, false AS taken
  FROM cat GROUP BY source_id
  UNION ALL
  SELECT c.source_id, r.k,
         CASE WHEN free THEN c.fields | (1::BIGINT << r.field_no) ELSE c.fields END,
         CASE WHEN free THEN c.used | (1::BIGINT << r.position) ELSE c.used END, c.used, free
  FROM claims c JOIN ranked r ON r.source_id = c.source_id AND r.k = c.k + 1,
       LATERAL (SELECT (c.fields >> r.field_no) & 1 = 0 AND (c.used >> r.position) & 1 = 0 AS free)
),
won AS (SELECT r.*, c.used_before FROM claims c JOIN ranked r USING (source_id, k) WHERE taken),
rivals AS (
  SELECT w.source_id, w.field, o.raw_column, o.score
  FROM won w JOIN worth o ON o.source_id = w.source_id AND o.field = w.field AND o.position <> w.position
  WHERE w.score - o.score <= 5 AND (w.used_before >> o.position) & 1 = 0
),
suggested AS (
  SELECT source_id, field, raw_column, round(score, 6) AS score,
         (SELECT count(*) FROM rivals v WHERE v.source_id = w.source_id AND v.field = w.field) AS rivals
  FROM won w
)"""
_recursive = CATALOGUE_SQL.replace("\ncat AS", "\nRECURSIVE cat AS", 1)
sql("column_scores", SCORES + "\nSELECT raw_column, field, round(score, 6) AS score FROM scores", base=CATALOGUE_SQL)
sql("mapping_rivals", CLAIMS + "\nSELECT source_id, field, raw_column, round(score, 6) AS score FROM rivals", base=_recursive)
sql(
    "suggest_mappings",
    CLAIMS + "\nSELECT *, CASE WHEN rivals = 0 THEN 'mapped' ELSE 'ambiguous' END AS status FROM suggested",
    base=_recursive,
)
sql(
    "unmapped_columns",
    CLAIMS + "\nSELECT * FROM cat WHERE (source_id, raw_column) NOT IN (SELECT source_id, raw_column FROM suggested)",
    base=_recursive,
)

# --- statistics ------------------------------------------------------------

sql(
    "descriptive_stats",
    LONG
    + """,
centre AS (SELECT field, avg(value) AS m FROM long GROUP BY 1)
SELECT field, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(min(value), 6) AS min, round(max(value), 6) AS max,
       round(avg((value - m) ** 3) / pow(avg((value - m) ** 2), 1.5), 6) AS skewness,
       round(avg((value - m) ** 4) / pow(avg((value - m) ** 2), 2) - 3, 6) AS kurtosis,
       round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median,
       round(quantile_cont(value, 0.75), 6) AS q3
FROM long JOIN centre USING (field) GROUP BY field""",
)
_FOUR = ["quantity_sold", "unit_price", "unit_cost", "current_stock"]
_PAIRS = [(a, b) for i, a in enumerate(_FOUR) for b in _FOUR[i + 1:]]
PEARSON = (
    ",\npear AS ("
    + "\nUNION ALL ".join(
        f"SELECT '{a}' AS field_a, '{b}' AS field_b, count(*) AS n, corr({a}, {b}) AS r FROM sales"
        for a, b in _PAIRS
    )
    + ")"
)
SPEARMAN = (
    ",\nranked AS (SELECT "
    + ", ".join(
        f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS {f}" for f in _FOUR
    )
    + " FROM sales),\nspear AS ("
    + "\nUNION ALL ".join(
        f"SELECT '{a}' AS field_a, '{b}' AS field_b, count(*) AS n, corr({a}, {b}) AS r FROM ranked"
        for a, b in _PAIRS
    )
    + ")"
)
sql("pearson", PEARSON + "\nSELECT field_a, field_b, n, round(r, 6) AS pearson_r FROM pear")
sql("spearman", SPEARMAN + "\nSELECT field_a, field_b, n, round(r, 6) AS spearman_r FROM spear")
sql(
    "all_correlations",
    PEARSON
    + SPEARMAN
    + """
SELECT field_a, field_b, pear.n AS n, round(pear.r, 6) AS pearson_r, round(spear.r, 6) AS spearman_r,
       CASE WHEN abs(pear.r) < 0.1 THEN 'negligible' WHEN abs(pear.r) < 0.3 THEN 'weak'
            WHEN abs(pear.r) < 0.5 THEN 'moderate' WHEN abs(pear.r) < 0.7 THEN 'strong'
            ELSE 'very strong' END AS strength,
       CASE WHEN pear.r > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM pear JOIN spear USING (field_a, field_b)""",
)
sql(
    "correlation_matrix",
    PEARSON
    + """
SELECT field_a AS "row", field_b AS "column", round(r, 6) AS pearson_r FROM pear
UNION ALL SELECT field_b, field_a, round(r, 6) FROM pear
UNION ALL SELECT f, f, 1.0 FROM (VALUES ('quantity_sold'), ('unit_price'), ('unit_cost'), ('current_stock')) t(f)""",
)


def rank_test(groups: str) -> str:
    return f""",
groups AS ({groups}),
pool AS (
  SELECT category, quantity_sold AS v,
         rank() OVER (ORDER BY quantity_sold) + (count(*) OVER (PARTITION BY quantity_sold) - 1) / 2.0 AS r
  FROM sales WHERE category IN (SELECT a FROM groups UNION ALL SELECT b FROM groups)
)
SELECT a AS group_a, b AS group_b, count(*) FILTER (category = a) AS n_a, count(*) FILTER (category = b) AS n_b,
       round(avg(v) FILTER (category = a), 6) AS mean_a, round(avg(v) FILTER (category = b), 6) AS mean_b,
       round(sum(r) FILTER (category = a)
             - count(*) FILTER (category = a) * (count(*) FILTER (category = a) + 1) / 2.0, 1) AS u_statistic
FROM pool, groups GROUP BY a, b"""


sql("mann_whitney", rank_test("SELECT 'ECONOMY' AS a, 'PROMO' AS b"))
sql(
    "top_two_groups",
    rank_test(
        "SELECT max(category) FILTER (k = 1) AS a, max(category) FILTER (k = 2) AS b FROM ("
        "SELECT category, row_number() OVER (ORDER BY count(*) DESC, category) AS k FROM sales GROUP BY category)"
    ),
)


# The normal tail: erf as a series of positive terms.
_ERF = (
    "(SELECT sum(exp((2 * k + 1) * ln(x) + 2 * k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2) - x * x)) * 2 / sqrt(pi()) "
    "FROM generate_series(0, 300) AS terms(k))"
)


def _field_test(field: str) -> str:
    return f"""
SELECT '{field}' AS group_field, a AS group_a, b AS group_b, n_a, n_b, mean_a, mean_b, u,
       greatest(u, n_a * n_b - u) - n_a * n_b / 2.0 - 0.5 AS far,
       sqrt(n_a * n_b / 12.0 * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1.0)))) AS spread
FROM (
  SELECT a, b, count(*) FILTER (g = a) AS n_a, count(*) FILTER (g = b) AS n_b,
         avg(v) FILTER (g = a) AS mean_a, avg(v) FILTER (g = b) AS mean_b, sum(c * c - 1) AS ties,
         sum(r) FILTER (g = a) - count(*) FILTER (g = a) * (count(*) FILTER (g = a) + 1) / 2.0 AS u
  FROM (
    SELECT {field} AS g, quantity_sold AS v, a, b, CAST(count(*) OVER (PARTITION BY quantity_sold) AS DOUBLE) AS c,
           rank() OVER (ORDER BY quantity_sold) + (count(*) OVER (PARTITION BY quantity_sold) - 1) / 2.0 AS r
    FROM sales, (
      SELECT max(g) FILTER (k = 1) AS a, max(g) FILTER (k = 2) AS b FROM (
        SELECT {field} AS g, row_number() OVER (ORDER BY count(*) DESC, {field}) AS k FROM sales GROUP BY {field}))
    WHERE {field} IN (a, b) AND quantity_sold IS NOT NULL)
  GROUP BY a, b)"""


sql(
    "group_tests",
    f""",
tests AS ({_field_test("category")} UNION ALL {_field_test("warehouse_id")}),
placed AS (SELECT *, abs(far / spread) / sqrt(2) AS x FROM tests),
tailed AS (SELECT *, least(1.0, 1 - sign(far) * CASE WHEN x = 0 THEN 0 ELSE {_ERF} END) AS p FROM placed)
SELECT group_field, group_a, group_b, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
       round(u, 1) AS u_statistic, round(p, 6) AS p_value, p < 0.05 AS is_significant,
       CASE WHEN p < 0.05 THEN CASE WHEN mean_a > mean_b THEN 'higher' ELSE 'lower' END END AS direction,
       'normal' AS method, CAST(NULL AS VARCHAR) AS error
FROM tailed""",
)
# Acklam's coefficients for the normal quantile, highest power first.
_CENTRE = ("-39.69683028665376 220.9460984245205 -275.9285104469687 138.3577518672690 -30.66479806614716 2.506628277459239",
           "-54.47609879822406 161.5858368580409 -155.6989798598866 66.80131188771972 -13.28068155288572 1")
_TAIL = ("-0.007784894002430293 -0.3223964580411365 -2.400758277161838 -2.549732539343734 4.374664141464968 2.938163982698783",
         "0.007784695709041462 0.3224671290700398 2.445134137142996 3.754408661907416 1")


def _power_sum(constants: str, x: str) -> str:
    numbers = constants.split()
    return " + ".join(f"{c}::DOUBLE * pow({x}, {len(numbers) - 1 - k})" for k, c in enumerate(numbers))


def _quantile(p: str) -> str:
    q, t = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    centre = f"{q} * ({_power_sum(_CENTRE[0], f'({q} * {q})')}) / ({_power_sum(_CENTRE[1], f'({q} * {q})')})"
    tail = f"({_power_sum(_TAIL[0], t)}) / ({_power_sum(_TAIL[1], t)})"
    return f"CASE WHEN least({p}, 1 - {p}) >= 0.02425 THEN {centre} WHEN {p} < 0.5 THEN {tail} ELSE -({tail}) END"


# Royston (1995), for more than eleven values.
sql(
    "normality",
    LONG
    + f""",
ranked AS (SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY value) AS i, count(*) OVER (PARTITION BY field) AS n FROM long WHERE value IS NOT NULL),
scored AS (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM ranked),
weighed AS (SELECT field, value, i, n, {_quantile('p')} AS m FROM scored),
sums AS (SELECT field, n, sum(m * m) AS mm, var_pop(value) * n AS ss, max(m) AS m1, max(m) FILTER (i = n - 1) AS m2, 1 / sqrt(n) AS u FROM weighed GROUP BY 1, 2),
fixed AS (SELECT *, m1 / sqrt(mm) + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5 AS a1,
                 m2 / sqrt(mm) + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5 AS a2 FROM sums),
scaled AS (SELECT *, sqrt((1 - 2 * a1 * a1 - 2 * a2 * a2) / (mm - 2 * m1 * m1 - 2 * m2 * m2)) AS s FROM fixed),
tested AS (SELECT field, n, pow(sum(value * CASE i WHEN 1 THEN -a1 WHEN 2 THEN -a2 WHEN n - 1 THEN a2 WHEN n THEN a1 ELSE m * s END), 2) / any_value(ss) AS w
           FROM weighed JOIN scaled USING (field, n) GROUP BY 1, 2)
SELECT field, n, round(w, 6) AS w_statistic,
  (ln(1 - w) - (-1.5861 - 0.31082 * ln(n) - 0.083751 * ln(n)**2 + 0.0038915 * ln(n)**3)) / exp(-0.4803 - 0.082676 * ln(n) + 0.0030302 * ln(n)**2) <= 1.6448536269514722 AS is_normal
FROM tested""",
)
BINNED = """,
ends AS (SELECT field, min(value) AS low, (max(value) - min(value)) / 40 AS width, count(*) AS n FROM long GROUP BY 1),
filled AS (
  SELECT field, CAST(least(floor((value - low) / width), 39) AS BIGINT) AS bin, count(*) AS held
  FROM long JOIN ends USING (field) GROUP BY ALL
),
binned AS (
  SELECT field, bin, low, width, n, coalesce(held, 0) AS rows
  FROM ends CROSS JOIN (SELECT unnest(range(40)) AS bin) LEFT JOIN filled USING (field, bin)
)"""
sql(
    "histogram",
    ", long AS (SELECT 'quantity_sold' AS field, quantity_sold AS value FROM sales)"
    + BINNED
    + """
SELECT field, bin, round(low + bin * width, 6) AS bin_start, round(low + (bin + 1) * width, 6) AS bin_end, rows,
       round(rows / (n * width), 6) AS density
FROM binned""",
    base=EVENTS_SQL,
)
sql("histogram_sales", LONG + BINNED + "\nSELECT field, bin, rows FROM binned")
sql(
    "normal_curve",
    LONG
    + """,
fit AS (SELECT field, min(value) AS low, max(value) AS high, avg(value) AS m, stddev_samp(value) AS s
        FROM long GROUP BY 1),
points AS (SELECT field, m, s, point, low + point * (high - low) / 199 AS x
           FROM fit, (SELECT unnest(range(200)) AS point))
SELECT field, point, round(x, 6) AS x, round(exp(0 - ((x - m) / s) * ((x - m) / s) / 2) / (s * sqrt(2 * pi())), 6) AS density
FROM points""",
)

# --- price elasticity ------------------------------------------------------

ELASTIC = """,
fits AS (
  SELECT product_id, count(*) AS n, regr_slope(ln(quantity_sold), ln(unit_price)) AS e,
         pow(corr(ln(quantity_sold), ln(unit_price)), 2) AS r2
  FROM sales WHERE quantity_sold > 0 AND unit_price > 0
  GROUP BY product_id HAVING count(*) >= 5 AND max(unit_price) / min(unit_price) - 1 >= 0.05
),
elastic AS (
  SELECT *, CASE WHEN abs(e) > 5 THEN 'suspect_extreme' WHEN e > 0 THEN 'unexpected_positive'
                 WHEN abs(e) < 1 THEN 'inelastic' ELSE 'elastic' END AS class
  FROM fits
)"""
sql(
    "price_elasticity",
    ELASTIC
    + """
SELECT product_id, round(e, 6) AS elasticity_coefficient, round(r2, 6) AS r_squared,
       class AS classification, n AS n_observations
FROM elastic""",
)
sql("elasticity_status", ELASTIC + "\nSELECT count(*) > 0 AS available, NULL::VARCHAR AS reason FROM elastic")

# --- stockouts -------------------------------------------------------------

READINGS = """,
readings AS (
  SELECT product_id, CAST(date AS DATE) AS day, current_stock AS stock FROM sales
  WHERE current_stock IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY product_id, CAST(date AS DATE)
    ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, date DESC) = 1
),
steps AS (SELECT *, lag(stock) OVER w AS previous_stock, lead(day) OVER w AS next_day FROM readings
          WINDOW w AS (PARTITION BY product_id ORDER BY day)),
events_ AS (SELECT product_id, day FROM steps WHERE previous_stock > 0 AND stock <= 0)"""
sql(
    "daily_stock",
    READINGS
    + """,
bounds AS (SELECT product_id, min(day) AS a, max(day) AS b FROM readings GROUP BY 1),
calendar AS (SELECT product_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM bounds)
SELECT product_id, strftime(c.day, '%Y-%m-%d') AS day, r.stock AS stock
FROM calendar c ASOF JOIN readings r USING (product_id, day)""",
    base=BRAND_SQL,
)
sql(
    "stock_readings",
    READINGS
    + """
SELECT product_id, strftime(day, '%Y-%m-%d') AS day, stock, previous_stock FROM steps""",
)
sql(
    "stockout_events",
    READINGS + "\nSELECT product_id, strftime(day, '%Y-%m-%d') AS stockout_date FROM events_",
)
sql("stockout_counts", READINGS + "\nSELECT count(*) AS events FROM events_")
sql(
    "ml_gate",
    READINGS
    + """
SELECT (SELECT count(*) FROM events_) >= 30
       AND (SELECT max(k) FROM (SELECT count(DISTINCT current_stock) AS k FROM sales GROUP BY product_id)) >= 5
         AS available, NULL::VARCHAR AS reason""",
)
SNAPS = READINGS + """,
snaps AS (
  SELECT product_id, CAST(unnest(generate_series(min(day) + INTERVAL 30 DAY, max(day) - INTERVAL 14 DAY,
                                                 INTERVAL 7 DAY)) AS DATE) AS s
  FROM readings GROUP BY product_id
)"""
FEATURES = SNAPS + """,
daily AS (SELECT product_id, CAST(date AS DATE) AS day, sum(quantity_sold) AS q FROM sales GROUP BY ALL),
ends AS (SELECT product_id, min(day) AS a, max(day) AS b FROM daily GROUP BY 1),
framed AS (
  SELECT snaps.product_id, s, greatest(s - 29, a) AS lo, least(s, b) - greatest(s - 29, a) + 1 AS n
  FROM snaps JOIN ends USING (product_id)
),
sums AS (
  SELECT f.product_id, f.s, any_value(n) AS n, coalesce(sum(q), 0) AS total, coalesce(sum(q * q), 0) AS squares,
         coalesce(sum(q * (day - lo)), 0) AS moment
  FROM framed f LEFT JOIN daily d ON d.product_id = f.product_id AND d.day BETWEEN f.s - 29 AND f.s
  WHERE n >= 15 GROUP BY f.product_id, f.s
),
stocked AS (SELECT sums.*, r.stock FROM sums ASOF JOIN readings r ON sums.product_id = r.product_id AND sums.s >= r.day),
labelled AS (
  SELECT DISTINCT snaps.product_id, s, 1 AS label
  FROM snaps JOIN events_ e ON e.product_id = snaps.product_id AND e.day > s AND e.day <= s + 14
)
SELECT product_id, strftime(s, '%Y-%m-%d') AS snapshot_date,
       round(CASE WHEN total > 0 THEN least(stock / (total / n), 365) ELSE 365 END, 6) AS days_of_inventory,
       round(CASE WHEN total > 0 THEN sqrt(greatest(squares - total * total / n, 0) / (n - 1)) / (total / n)
                  ELSE 0 END, 6) AS demand_volatility,
       round((moment - total * (n - 1) / 2.0) / (n * (n * n - 1) / 12.0), 6) AS trailing_demand_slope,
       round(total, 6) AS trailing_total_demand{label}
FROM stocked LEFT JOIN labelled USING (product_id, s)"""
sql("snapshots", SNAPS + "\nSELECT product_id, strftime(s, '%Y-%m-%d') AS snapshot_date FROM snaps")
sql("risk_features", FEATURES.format(label=""))
sql("feature_table", FEATURES.format(label=",\n       CAST(coalesce(label, 0) AS BIGINT) AS stockout_occurred"))

# --- seasonality and forecasting -------------------------------------------


def dense(key: str) -> str:
    return f""",
daily AS (SELECT {key} AS k, CAST(date AS DATE) AS day, sum(quantity_sold) AS q FROM sales GROUP BY ALL),
edges AS (SELECT k, min(day) AS a, max(day) AS b FROM daily GROUP BY k),
calendar AS (SELECT k, a, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM edges),
dense AS (SELECT k, day, day - a AS i, coalesce(q, 0) AS x, count(*) OVER (PARTITION BY k) AS n
          FROM calendar LEFT JOIN daily USING (k, day))"""


def _strength(p: int) -> str:
    h = p // 2
    if p % 2:
        trend = f"avg(x) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    else:
        trend = (
            f"(sum(x) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN {h - 1} PRECEDING AND {h - 1} FOLLOWING)"
            f" + 0.5 * (lag(x, {h}) OVER (PARTITION BY k ORDER BY i) + lead(x, {h}) OVER (PARTITION BY k ORDER BY i))) / {p}"
        )
    return f""",
d{p} AS (SELECT k, i, CASE WHEN i >= {h} AND i < n - {h} THEN x - {trend} END AS rest FROM dense WHERE n >= {6 * p}),
m{p} AS (SELECT k, i % {p} AS phase, avg(rest) AS m FROM d{p} GROUP BY ALL),
c{p} AS (SELECT k, phase, m - avg(m) OVER (PARTITION BY k) AS season FROM m{p}),
s{p} AS (SELECT k, var_samp(season) AS vs, var_samp(rest - season) AS vr
         FROM d{p} JOIN (SELECT k AS ck, phase, season FROM c{p}) ON ck = k AND phase = i % {p} GROUP BY k)"""


STRENGTHS = "".join(_strength(p) for p in (7, 30, 365)) + """,
strengths AS (
  SELECT k, label, p, n, CASE WHEN n < 6 * p THEN NULL WHEN vs + vr > 0 THEN vs / (vs + vr) ELSE 0 END AS strength
  FROM (SELECT DISTINCT k, n FROM dense),
       (VALUES ('weekly', 7), ('monthly', 30), ('yearly', 365)) t(label, p)
  LEFT JOIN (SELECT *, 7 AS sp FROM s7 UNION ALL SELECT *, 30 FROM s30 UNION ALL SELECT *, 365 FROM s365) v
    ON v.k = k AND sp = p
)"""
STRENGTHS = STRENGTHS.replace(
    """  FROM (SELECT DISTINCT k, n FROM dense),
       (VALUES ('weekly', 7), ('monthly', 30), ('yearly', 365)) t(label, p)
  LEFT JOIN (SELECT *, 7 AS sp FROM s7 UNION ALL SELECT *, 30 FROM s30 UNION ALL SELECT *, 365 FROM s365) v
    ON v.k = k AND sp = p
""",
    """  FROM (SELECT * FROM (SELECT DISTINCT k, n FROM dense),
                      (VALUES ('weekly', 7), ('monthly', 30), ('yearly', 365)) t(label, p)) g
  LEFT JOIN (SELECT *, 7 AS p FROM s7 UNION ALL SELECT *, 30 FROM s30 UNION ALL SELECT *, 365 FROM s365) v
    USING (k, p)
""",
)
SEASONAL_OUT = """
SELECT {key}label AS period_label, CAST(p AS BIGINT) AS period_days, round(strength, 6) AS seasonal_strength,
       strength > 0.3 AS is_seasonal,
       CASE WHEN n < 6 * p THEN 'needs ' || 6 * p || ' days of data, has ' || n END AS error
FROM strengths"""
sql("seasonality", dense("0") + STRENGTHS + SEASONAL_OUT.format(key=""))
sql("seasonality_events", dense("0") + STRENGTHS + SEASONAL_OUT.format(key=""), base=EVENTS_SQL)
sql(
    "product_seasonality",
    dense("product_id") + STRENGTHS + SEASONAL_OUT.format(key="k AS product_id, "),
    base=BRAND_SQL,
)
CHOSEN = STRENGTHS + """,
chosen AS (SELECT k, min(p) FILTER (strength > 0.3) AS period FROM strengths GROUP BY k)"""
sql(
    "seasonal_period",
    dense("product_id") + CHOSEN + "\nSELECT k AS product_id, CAST(period AS BIGINT) AS period FROM chosen",
)
sql(
    "daily_series",
    dense("product_id") + "\nSELECT k AS product_id, strftime(day, '%Y-%m-%d') AS day, x AS quantity FROM dense",
    base=BRAND_SQL,
)


def naive_points(cut: int) -> str:
    """Baseline for the 14 days after day n - cut; CTE `points(k, h, y)`."""
    return f""",
tail AS (SELECT k, n - {cut} AS m, period, avg(x) FILTER (i >= n - {cut} - 7 AND i < n - {cut}) AS week
         FROM dense JOIN chosen USING (k) WHERE n >= 28 GROUP BY k, n, period),
grid AS (SELECT *, CASE WHEN m >= 2 * period THEN m - period + (h - 1) % period END AS back
         FROM tail, (SELECT unnest(range(1, 15)) AS h)),
points AS (SELECT g.k, h, m, coalesce(d.x, week) AS y
           FROM grid g LEFT JOIN (SELECT k, i, x FROM dense) d ON d.k = g.k AND d.i = back)"""


sql(
    "stored_forecasts",
    dense("product_id")
    + CHOSEN
    + naive_points(14)
    + """
SELECT points.k AS product_id, round(avg(abs(x - y)), 6) AS naive_mae, true AS is_least, 14 AS days
FROM points JOIN dense ON dense.k = points.k AND dense.i = m + h - 1 GROUP BY points.k""",
    base=BRAND_SQL,
)
sql(
    "backtest_mae",
    dense("product_id")
    + CHOSEN
    + naive_points(14)
    + """
SELECT points.k AS product_id, round(avg(abs(x - y)), 6) AS naive_mae
FROM points JOIN dense ON dense.k = points.k AND dense.i = m + h - 1 GROUP BY points.k""",
)
sql(
    "forecast_naive",
    dense("product_id")
    + CHOSEN
    + naive_points(0)
    + """
SELECT points.k AS product_id, strftime(b + CAST(h AS INTEGER), '%Y-%m-%d') AS day, round(y, 6) AS quantity
FROM points JOIN edges USING (k)""",
)
sql(
    "price_what_if",
    dense("product_id")
    + CHOSEN
    + naive_points(0)
    + ELASTIC
    + """,
priced AS (
  SELECT product_id, unit_price AS price FROM sales WHERE unit_price IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY product_id
    ORDER BY date DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1
),
base AS (
  SELECT e.product_id, e, price, u.units, pct FROM elastic e JOIN priced USING (product_id)
  JOIN (SELECT k AS product_id, sum(y) AS units FROM points GROUP BY k) u USING (product_id),
  (VALUES (-50::DOUBLE), (-20), (-10), (-5), (5), (10), (20), (50)) t(pct)
),
moved AS (SELECT *, price * (1 + pct / 100) AS new_price, greatest(units * (1 + e * pct / 100), 0) AS after_units FROM base)
SELECT product_id, round(e, 6) AS elasticity_coefficient, round(price, 6) AS current_price,
       round(new_price, 6) AS new_price, pct AS price_change_pct, round(units, 6) AS baseline_units,
       round(after_units, 6) AS projected_units, round(e * pct, 6) AS projected_demand_change_pct,
       round(units * price, 4) AS baseline_revenue, round(after_units * new_price, 4) AS projected_revenue,
       round(CASE WHEN units * price > 0 THEN (after_units * new_price - units * price) / (units * price) * 100
                  ELSE 0 END, 6) AS revenue_change_pct
FROM moved""",
)

# --- risk and recommendations ----------------------------------------------

DENSE = dense("product_id").replace("daily AS", "day_units AS").replace("daily USING", "day_units USING").replace("FROM daily", "FROM day_units")
RISK = (
    DENSE
    + CHOSEN
    + naive_points(0)
    + DAILY
    + LEADS
    + XYZ
    + COVER
    + """,
rising AS (SELECT k AS product_id, max(y) FILTER (h = 14) > max(y) FILTER (h = 1) AS up FROM points GROUP BY k),
scored AS (
  SELECT product_id, days_of_inventory, xyz_tier, latest_stock,
         CASE WHEN days_of_inventory <= 7 THEN 2 WHEN days_of_inventory <= 14 THEN 1 ELSE 0 END
         + CASE xyz_tier WHEN 'Z' THEN 2 WHEN 'Y' THEN 1 ELSE 0 END + CASE WHEN up THEN 1 ELSE 0 END AS score
  FROM cover JOIN xyz USING (product_id) LEFT JOIN rising USING (product_id)
),
risks AS (SELECT *, CASE WHEN score >= 4 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS risk FROM scored)"""
)
RISK_OUT = """
SELECT product_id, risk AS risk_label, CAST(score AS DOUBLE) AS risk_score, 'rule_based' AS method,
       round(days_of_inventory, 6) AS days_of_inventory, xyz_tier
FROM risks"""
sql("rule_based_risk", RISK + RISK_OUT)
sql("risk_ranking", RISK + RISK_OUT)
ADVICE = (
    RISK
    + IDLE
    + ELASTIC
    + """,
named AS (SELECT product_id, any_value(product_name) AS name FROM sales GROUP BY 1),
labels_ AS (SELECT product_id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (' || product_id || ')'
                                    ELSE name END AS display_name FROM named),
advice AS (
  SELECT product_id, 1 AS rule, 'increase_inventory' AS action, risk AS priority
  FROM risks JOIN buffers USING (product_id) WHERE risk IN ('high', 'medium') AND latest_stock <= reorder
  UNION ALL SELECT product_id, 2, 'reduce_inventory', 'medium' FROM risks WHERE days_of_inventory >= 90 AND xyz_tier <> 'Z'
  UNION ALL SELECT product_id, 3, 'increase_safety_stock', 'medium' FROM risks
    WHERE risk IN ('high', 'medium') AND xyz_tier = 'Z'
  UNION ALL SELECT product_id, 4, 'discount', 'low' FROM idle WHERE is_dead_stock OR is_slow_mover
  UNION ALL SELECT product_id, 5, CASE class WHEN 'elastic' THEN 'consider_price_decrease'
                                             ELSE 'consider_price_increase' END, 'low'
    FROM elastic WHERE class IN ('elastic', 'inelastic')
),
full_advice AS (SELECT product_id, display_name, CAST(rule AS BIGINT) AS rule, action, priority
                FROM advice JOIN labels_ USING (product_id))"""
)
ADVICE_OUT = "\nSELECT product_id, display_name, rule, action, priority FROM full_advice"
sql("recommendations", ADVICE + ADVICE_OUT, base=RETURNS_SQL)
_signals = {
    1: ["days_of_inventory", "reorder_point"], 2: ["days_of_inventory", "xyz_tier"], 3: ["xyz_tier", "risk_label"],
    4: ["days_since_last_sale", "gross_quantity_sold"], 5: ["elasticity_coefficient", "r_squared"],
}
_source = {
    "days_of_inventory": "days_of_inventory", "reorder_point": "reorder", "days_since_last_sale": "days_since_last_sale",
    "gross_quantity_sold": "gross_quantity_sold", "elasticity_coefficient": "e", "r_squared": "r2",
    "xyz_tier": "xyz_tier", "risk_label": "risk",
}
_words = ("xyz_tier", "risk_label")
sql(
    "recommendation_signals",
    ADVICE
    + """,
wide AS (SELECT a.product_id, a.rule, days_of_inventory, reorder, days_since_last_sale, gross_quantity_sold, e, r2, xyz_tier, risk
         FROM full_advice a LEFT JOIN risks USING (product_id) LEFT JOIN buffers USING (product_id)
         LEFT JOIN idle USING (product_id) LEFT JOIN elastic USING (product_id))"""
    + "\nUNION ALL".join(
        f"\nSELECT product_id, rule, '{s}' AS signal, "
        + (f"NULL::DOUBLE AS number, {_source[s]} AS word" if s in _words else
           f"round({_source[s]}::DOUBLE, 4) AS number, NULL::VARCHAR AS word")
        + f" FROM wide WHERE rule = {rule}"
        for rule, names in _signals.items()
        for s in names
    ),
    base=RETURNS_SQL,
)
for _name, _where in {
    "rec_reorder": "rule = 1", "rec_reduce": "rule = 2", "rec_discount": "rule = 4",
    "rec_safety_stock": "rule = 3", "rec_price": "rule = 5", "recommendations_high": "priority = 'high'",
}.items():
    sql(_name, ADVICE + ADVICE_OUT + f" WHERE {_where}", base=RETURNS_SQL)
_ORDER = "CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, product_id, rule"
sql(
    "executive_facts",
    ADVICE
    + f"""
SELECT (SELECT count(DISTINCT product_id) FROM sales) AS total_products,
       (SELECT count(*) FROM risks WHERE risk = 'high') AS high_risk_count,
       (SELECT count(*) FROM full_advice WHERE action = 'discount') AS dead_stock_count,
       (SELECT count(*) FROM full_advice) AS total_recommendations,
       (SELECT string_agg(k || '. ' || display_name || ': ' || action || ' (' || priority || ' priority)', chr(10) ORDER BY k)
        FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS k FROM full_advice) WHERE k <= 3) AS top_recommendations""",
    base=RETURNS_SQL,
)
sql(
    "product_facts",
    ADVICE
    + f"""
SELECT l.product_id AS product_id, l.display_name AS display_name, coalesce(risk, 'unknown') AS risk_label,
       CAST(score AS DOUBLE) AS risk_score, round(cover.days_of_inventory, 6) AS days_of_inventory,
       coalesce(f.action, 'none') AS action
FROM labels_ l LEFT JOIN risks r ON r.product_id = l.product_id LEFT JOIN cover ON cover.product_id = l.product_id
LEFT JOIN (SELECT product_id, action FROM full_advice
           QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY {_ORDER}) = 1) f ON f.product_id = l.product_id""",
    base=RETURNS_SQL,
)
