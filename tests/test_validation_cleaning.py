import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.operators import cleaning, validation
from tests.conftest import rows_by

N = 60


def frame(spark, **changes):
    days = pd.date_range("2024-01-01", periods=N).strftime("%Y-%m-%d")
    columns = {
        "date": list(days),
        "product_id": [f"P{i % 10}" for i in range(N)],
        "quantity_sold": [str(10 + i % 5) for i in range(N)],
        "unit_price": ["20"] * N,
        "unit_cost": ["12"] * N,
        "warehouse_id": ["main"] * N,
        "current_stock": ["100"] * N,
        "category": ["A"] * N,
    }
    for name, edit in changes.items():
        for i, v in edit.items():
            columns[name][i] = v
    rows = list(zip(*columns.values()))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def as_of():
    return F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")


def issues(df):
    return rows_by(validation.validation_issues(df, as_of()), "check_name")


def test_clean_table_has_no_issue(spark):
    assert issues(frame(spark)) == {}


@pytest.mark.parametrize(
    "changes, name, severity, rows",
    [
        ({"date": {i: "nope" for i in range(40)}}, "date_parseable", "error", 40),
        ({"product_id": {1: None, 2: None}}, "product_id_missing", "warning", 2),
        ({"product_id": {i: None for i in range(31)}}, "product_id_missing", "error", 31),
        ({"quantity_sold": {0: "ten"}}, "quantity_sold_not_numeric", "error", 1),
        ({"unit_cost": {0: "1d"}}, "unit_cost_not_numeric", "error", 1),
        ({"date": {0: "2030-01-01"}}, "dates_in_future", "warning", 1),
        ({"date": {0: "1/31/1980"}}, "dates_absurdly_old", "warning", 1),
        ({"quantity_sold": {3: "-4"}}, "negative_quantity_sold", "warning", 1),
        ({"unit_price": {3: "-1"}}, "unit_price_negative", "warning", 1),
        ({"current_stock": {3: "9000"}}, "current_stock_outliers", "warning", 1),
    ],
)
def test_one_defect(spark, changes, name, severity, rows):
    issue = issues(frame(spark, **changes))[name]
    assert (issue["severity"], issue["affected_row_count"]) == (severity, rows)


def test_rare_value_needs_a_hundred_rows(spark):
    big = frame(spark).unionByName(frame(spark, category={0: "typo"}))
    assert issues(big)["category_rare_values"]["affected_row_count"] == 1


def test_small_and_short(spark):
    found = issues(frame(spark).limit(10))
    assert {"minimum_row_count", "minimum_date_span"} <= set(found)
    with pytest.raises(cleaning.InsufficientDataError) as error:
        cleaning.clean(frame(spark).limit(10))
    assert len(error.value.reasons) == 2
    empty = rows_by(validation.validation_issues(frame(spark).limit(0), as_of()), "check_name")
    assert set(empty) == {"minimum_row_count"}


def test_cleaning_drops_and_coerces(spark):
    df = frame(
        spark,
        date={0: "not-a-date"},
        product_id={0: None, 1: None},
        quantity_sold={2: "ten", 3: None},
        unit_cost={0: "bad", 4: "expensive", 5: None},
        unit_price={6: "NaN"},
    )
    result = cleaning.clean(df)
    log = rows_by(result.actions, "check_name")
    assert {k: v["affected_row_count"] for k, v in log.items()} == {
        "date_parseable": 1, "required_field_missing": 2, "quantity_sold_not_numeric": 1,
        "unit_cost_not_numeric": 1, "unit_price_not_numeric": 1,
    }
    assert result.sales.df.count() == N - 4
    assert cleaning.row_counts(df).first().asDict() == {"rows_before": N, "rows_after": N - 4}
    types = dict(result.sales.df.dtypes)
    assert types["date"] == "timestamp_ntz" and types["unit_cost"] == "double"


def test_clean_reads_the_raw_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    raw = frame(spark, date={0: "soon", 7: "2031-01-01"}, unit_price={3: "-4", 5: "dear"}, product_id={9: None})
    result = cleaning.clean(raw.mapInArrow(count, raw.schema), as_of())
    log = sorted(map(tuple, result.actions.collect()))
    found = sorted(map(tuple, result.issues.collect()))
    kept = sorted(map(str, result.sales.df.drop("_ord").collect()))
    assert read.value == N
    assert log == sorted(map(tuple, cleaning.cleaning_actions(raw).collect()))
    assert found == sorted(map(tuple, validation.scalar_issues(raw, as_of()).collect()))
    assert kept == sorted(map(str, cleaning.cleaned_rows(raw).collect()))
    assert {"dates_in_future", "unit_price_negative", "unit_price_not_numeric"} <= {r[1] for r in found}
    # Input order: the dates of the table rise with it.
    days = [r["date"] for r in result.sales.df.orderBy("_ord").collect() if r["date"].year == 2024]
    assert days == sorted(days)
    with pytest.raises(cleaning.InsufficientDataError):
        cleaning.clean(raw.limit(0))


def test_record_violations(spark):
    df = frame(spark, quantity_sold={0: "-1"}, current_stock={1: "-2", 2: "-3"})
    found = rows_by(validation.record_violations(df), "field")
    assert found["quantity_sold"]["violations"] == 1
    assert found["current_stock"]["violations"] == 2


def test_date_spellings(spark):
    texts = ["2010-12-01", "2010-12-1 8:26", "12/1/2010", "12/1/2010 8:26", "2010/12/01", "2010", "x", ""]
    df = spark.createDataFrame([(t,) for t in texts], "date string")
    from granary.functions.parsing import to_datetime

    out = [r[0] for r in df.select(to_datetime(df, "date")).collect()]
    assert [v is not None for v in out] == [True] * 5 + [False] * 3
    assert {v.date().isoformat() for v in out[:5]} == {"2010-12-01"}
