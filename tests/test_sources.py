import datetime as dt
from decimal import Decimal

import pytest

from tallybrook.sources import mapping, readers

RETAIL = """Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country
1001,850A,RED LAMP,12,12/1/2009 7:45,6.95,13085,France
C1002,221,OLD LAMP,-2,12/1/2009 8:00,4.95,13085,France
1003,226,HAND WARMER,x,12/13/2009 8:15,1.85,,France
"""
SHOP = """Name,Created at,Financial Status,Total,Email,Discount Amount,Lineitem sku
#1,2025-01-02 10:00:00 -0500,paid,12.50,a@x.example,1.00,00850
#1,2025-01-02 10:00:00 -0500,,,,,00851
"""


@pytest.fixture
def csv(tmp_path):
    def write(text):
        path = tmp_path / "in.csv"
        path.write_text(text)
        return str(path)

    return write


def test_retail_file(spark, csv):
    rows = readers.load_orders(spark, csv(RETAIL)).orderBy("order_id").collect()
    assert [r["amount"] for r in rows] == [Decimal("83.4"), None, Decimal("-9.9")]
    assert rows[0]["order_date"] == dt.datetime(2009, 12, 1, 7, 45)
    assert rows[1]["order_date"] == dt.datetime(2009, 12, 13, 8, 15) and rows[1]["customer_id"] is None


def test_shop_file(spark, csv):
    df = readers.load_orders(spark, csv(SHOP))
    rows = df.orderBy("sku").collect()
    assert rows[0]["order_date"] == dt.datetime(2025, 1, 2, 15, 0)
    assert (rows[0]["sku"], rows[0]["amount"], rows[0]["customer_id"]) == ("00850", Decimal("12.5"), "a@x.example")
    assert rows[1]["amount"] is None and rows[1]["discount"] == 0


def test_missing_columns_raise(spark, csv):
    with pytest.raises(ValueError, match="customer_id"):
        readers.load_orders(spark, csv("order_id,date,total\n1,2025-01-01,3\n"))


def test_bad_dates(spark, csv):
    path = csv("order_id,date,total,email\n1,2025-01-01,3,a\n2,soon,4,b\n")
    assert readers.load_orders(spark, path, on_bad_date="quarantine").count() == 1
    assert readers.bad_dates(readers.read_table(spark, path)).count() == 1
    with pytest.raises(Exception, match="cannot read order date"):
        readers.load_orders(spark, path).collect()


def test_alias_and_similarity():
    assert mapping.alias_map(["Order Number", "DATE", "amount"]) == {"Order Number": "order_id", "DATE": "order_date"}
    assert mapping.overlap(mapping.name_words("order_date"), mapping.name_words("Order  date")) == 1.0
    assert mapping.overlap(mapping.name_words(""), mapping.name_words("x")) == 0.0
    assert mapping.fuzzy_map(["order_id", "sale order date"], {"sale order date": "date"})["sale order date"][0] == "order_date"
    # A canonical column is never taken for another one.
    assert "order_id" not in mapping.fuzzy_map(["order_id", "x"], {})


def test_types_and_report(spark, csv):
    df = readers.read_table(spark, csv(RETAIL))
    kinds = mapping.inferred_types(df)
    assert kinds["InvoiceDate"] == "date" and kinds["Price"] == "currency"
    report = {r["source_col"]: r for r in mapping.mapping_report(df).collect()}
    assert report["StockCode"]["canonical"] == "sku" and report[None]["canonical"] == "amount"
    counts = {r["column"]: r for r in readers.quality_report(mapping.map_columns(df)).collect()}
    assert counts["quantity"]["unparsable"] == 1 and counts["customer_id"]["nulls"] == 1


def test_products_inventory_and_validation(spark, csv):
    products = readers.load_products(spark, csv("Handle,Title,Variant Price,Type\np1,Lamp,9.50,Light\n"))
    assert products.collect()[0]["price"] == Decimal("9.5")
    assert readers.load_inventory(spark, csv("sku,quantity_on_hand\ns1,4\n")).count() == 1
    checked = readers.validate_schema(products, "orders")
    assert not checked.valid and "order_id" in checked.missing_columns and checked.warnings


@pytest.mark.parametrize(
    "text,want",
    [("2025-01-31", dt.datetime(2025, 1, 31)), ("1/31/2025", dt.datetime(2025, 1, 31)), ("31/1/2025", dt.datetime(2025, 1, 31)),
     ("2025-01-31T10:05:00Z", dt.datetime(2025, 1, 31, 10, 5)), ("20250131", dt.datetime(2025, 1, 31)), ("soon", None)],
)
def test_date_forms(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(mapping.parse_timestamp(df["t"]).alias("t")).collect()[0]["t"] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("12/1/09 7:45", dt.datetime(2009, 12, 1, 7, 45)),
        ("12/1/2009 7:45 AM", dt.datetime(2009, 12, 1, 7, 45)),
        ("12/1/2009 7:45pm", dt.datetime(2009, 12, 1, 19, 45)),
        ("31-01-2025", dt.datetime(2025, 1, 31)),
        ("01-31-2025", dt.datetime(2025, 1, 31)),
        ("31.01.2025", dt.datetime(2025, 1, 31)),
        ("13/01/2025 10:05", dt.datetime(2025, 1, 13, 10, 5)),
        ("January 31, 2025", dt.datetime(2025, 1, 31)),
        ("Jan 31, 2025 10:05", dt.datetime(2025, 1, 31, 10, 5)),
        ("2025-01-31 10:05:00 UTC", dt.datetime(2025, 1, 31, 10, 5)),
        ("2025-01-31 10:05:00 -0500", dt.datetime(2025, 1, 31, 15, 5)),
        ("2025-01-31T10:05:00Z", dt.datetime(2025, 1, 31, 10, 5)),
        ("20250131", dt.datetime(2025, 1, 31)),
        ("31 January 2025", dt.datetime(2025, 1, 31)),
        ("2025/1/31 10:05:06", dt.datetime(2025, 1, 31, 10, 5, 6)),
        ("13/13/2025", None),
        ("soon", None),
    ],
)
def test_date_forms(spark, text, want):
    df = spark.createDataFrame([(text,)], "d string")
    assert df.select(mapping.parse_timestamp(df.d)).first()[0] == want


def test_lines_of_several_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text('order_id,date,total,email,note\n1,2025-01-01,3,a,"x, ""y"""\n2,2025-01-02,4\n')
    (folder / "b.csv").write_text("order_id,date,total,email,note\n3,soon,5,c,\n4,,6,d,\n5,2025-01-05,n/a,e,f,g\n6,6/1/2025,7,,z\n")
    found = readers.load_csv_lines(spark, str(folder))
    rows = {r["order_id"]: r for r in found.rows.collect()}
    assert set(rows) == {"1", "4", "6"} and rows["1"]["note"] == 'x, "y"' and rows["4"]["order_date"] is None
    assert rows["6"]["order_date"] == dt.datetime(2025, 6, 1) and rows["6"]["customer_id"] is None
    reasons = {(r["line"][0], r["reason"]) for r in found.rejected.collect()}
    assert reasons == {("2", "width"), ("5", "width"), ("3", "order_date")}
    with pytest.raises(ValueError, match="kind"):
        readers.load_csv_lines(spark, str(folder), kind="visits")
    with pytest.raises(ValueError, match="lacks required"):
        readers.load_csv_lines(spark, str(folder), kind="products")


def test_different_values_at_the_limit(spark):
    def profile(n, different):
        df = spark.range(n).selectExpr(f"concat('x', least(id, {different - 1})) as a", "cast(id as string) as b")
        return {r["column"]: r for r in mapping.column_profile(df).collect()}

    at, above = profile(5000, 4000), profile(5000, 4001)
    assert (at["a"]["inferred_type"], at["a"]["distinct_exact"], at["a"]["distinct_rate"]) == ("unknown", True, 0.8)
    assert (above["a"]["inferred_type"], above["a"]["distinct_exact"]) == ("id", True)
    assert not above["b"]["distinct_exact"] and above["b"]["inferred_type"] == "currency"
    none = mapping.column_profile(spark.createDataFrame([], "a string")).collect()[0]
    assert (none["rows"], none["numeric_rate"], none["inferred_type"]) == (0, None, "unknown")


def test_quoted_line_breaks_and_wrong_width(spark, csv):
    path = csv('order_id,date,total,email,note\n1,2025-01-01,3,a,"line one\nline two"\n2,2025-01-02,4,b,\n')
    rows = readers.load_orders(spark, path).collect()
    assert {r["order_id"]: r["note"] for r in rows} == {"1": "line one\nline two", "2": None}
    with pytest.raises(Exception):
        readers.load_orders(spark, csv("order_id,date,total,email\n1,2025-01-01,3\n2,2025-01-01,3,a,x,y\n")).collect()
