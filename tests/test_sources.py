import json

import pytest

from granary.operators.mapping import FieldMapping, MappingError, apply_mapping
from granary.schema import Sales
from granary.sources.readers import (
    SourceError,
    UnsupportedFormatError,
    checked,
    detect_format,
    load_summary,
    read_source,
)
from granary.sources.results import ResultStore, fingerprint, group_fingerprints

HEADER = ("StockCode", "Store", "Price", "Sold on", "Note")
ROWS = [
    (f"K-{i:03d}", "north" if i % 3 else "south", f"{i * 1.25:.2f}", f"2023-0{1 + i % 9}-17", f"batch {i}; row") for i in range(12)
]


def test_csv_and_json(spark, tmp_path):
    csv = tmp_path / "stock.csv"
    csv.write_text("\n".join(",".join(r) for r in (HEADER, *ROWS)) + "\n")
    array = tmp_path / "stock.json"
    records = [dict(zip(HEADER, r)) for r in ROWS]
    array.write_text(json.dumps(records))
    lines = tmp_path / "stock.jsonl"
    lines.write_text("\n".join(json.dumps(r) for r in records))
    for path in (csv, array, lines):
        df = read_source(spark, str(path))
        assert sorted(map(tuple, df.select(*HEADER).collect())) == ROWS
        assert df.where("StockCode = 'K-006'").first()["Price"] == "7.50"
        summary = load_summary(df, path.name, "x").first()
        assert (summary["row_count"], summary["column_count"]) == (12, 5)


def test_other_encoding(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes("product_id,name\n1,Crème\n".encode("latin-1"))
    assert read_source(spark, str(path), encoding="ISO-8859-1").first()["name"] == "Crème"


def test_errors(spark, tmp_path):
    with pytest.raises(UnsupportedFormatError):
        detect_format("notes.txt")
    with pytest.raises(SourceError):
        read_source(spark, str(tmp_path / "absent.csv"))


def test_csv_dialect(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,name,n\n1,"a ""b"", c",5\n2,"two\nlines",6\n3,plain,\n')
    rows = read_source(spark, str(path), multi_line=True).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", 'a "b", c', "5"), ("2", "two\nlines", "6"), ("3", "plain", None)]
    ragged = tmp_path / "r.csv"
    ragged.write_text("id,name\n1,a\n2,b,extra\n")
    with pytest.raises(SourceError):
        checked(read_source(spark, str(ragged)), "r.csv")


def test_malformed_json_is_a_source_error(spark, tmp_path):
    path = tmp_path / "bad.json"
    path.write_text('[{"a": 1}, {"a": ')
    with pytest.raises(SourceError):
        checked(read_source(spark, str(path)), "bad.json")


def test_fingerprint_ignores_order_but_not_copies(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "a int, b string")
    c = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (3, "z")], "a int, b string")
    assert fingerprint(a) == fingerprint(b) != fingerprint(c)
    assert fingerprint(a.limit(0)) == fingerprint(b.limit(0))
    left = spark.createDataFrame([(5, None)], "a int, b int")
    right = spark.createDataFrame([(None, 5)], "a int, b int")
    named = spark.createDataFrame([(5, None)], "a int, c int")
    wide = spark.createDataFrame([(5, None)], "a long, b int")
    assert len({fingerprint(x) for x in (left, right, named, wide)}) == 4


def test_fingerprint_of_odd_names_and_of_groups(spark):
    odd = spark.createDataFrame([(1, 2), (3, 4)], "`Price.` int, `a``b c` int")
    assert fingerprint(odd) == fingerprint(odd.repartition(2)) != fingerprint(odd.limit(1))
    rows = [("x", 1), ("x", 1), ("y", 1), ("y", None), (None, 1)]
    prints = {r[0]: r[1] for r in group_fingerprints(spark.createDataFrame(rows, "k string, v int"), "k", ["v"]).collect()}
    assert len(prints) == len(set(prints.values())) == 3
    other = group_fingerprints(spark.createDataFrame(rows[::-1] + [("z", 9)], "k string, v int"), "k", ["v"])
    assert prints.items() < {r[0]: r[1] for r in other.collect()}.items()


def test_fingerprint_does_not_depend_on_partitions(make_sales):
    sales = make_sales(date=["2024-01-01"] * 50, product_id=[str(i) for i in range(50)], quantity_sold=[1] * 50)
    rows = sales.df.drop("_ord")
    assert fingerprint(Sales(rows.repartition(7)).df) == fingerprint(Sales(rows.coalesce(1)).df)


def test_store_builds_once_and_again_when_unreadable(spark, tmp_path):
    store, calls = ResultStore(str(tmp_path)), []

    def build():
        calls.append(1)
        return spark.range(3)

    source = spark.range(1)
    assert store.table("t", "k", source, build).count() == 3
    assert store.table("t", "k", source, build).count() == 3
    assert len(calls) == 1
    for mark in (tmp_path / "t" / "fingerprint=k").rglob("*_SUCCESS*"):
        mark.unlink()  # as a failed write leaves it
    assert store.table("t", "k", source, build).count() == 3
    assert len(calls) == 2
    assert store.table("t", "k", source, build, depth=4).count() == 3
    assert len(calls) == 3
    for part in (tmp_path / "t" / "fingerprint=k").rglob("part-*.parquet"):
        data = part.read_bytes()
        part.write_bytes(data[:4] + bytes(40) + data[44:])  # the pages, not the footer
    assert store.table("t", "k", source, build).count() == 3
    assert len(calls) == 4


def test_apply_mapping(spark):
    raw = spark.createDataFrame(
        [("85123A", 6, "2010-12-01", "UK"), (None, 2, "2010-12-02", "FR")],
        "StockCode string, Quantity int, InvoiceDate string, Country string",
    )
    columns = {"product_id": "StockCode", "quantity_sold": "Quantity", "date": "InvoiceDate"}
    sales = apply_mapping(raw, FieldMapping(columns, confirmed=True))
    rows = sales.df.orderBy("date").collect()
    assert "Country" not in sales.df.columns
    assert rows[0]["warehouse_id"] == "main" and rows[0]["product_id"] == "85123A"
    assert rows[1]["product_id"] is None and rows[0]["unit_price"] is None
    assert sales.has("warehouse_id") and not sales.has("unit_price")
    with pytest.raises(MappingError):
        apply_mapping(raw, FieldMapping(columns))
    with pytest.raises(MappingError, match="date"):
        apply_mapping(raw, FieldMapping({"product_id": "StockCode", "quantity_sold": "Quantity"}, True))
