from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import rows
from tillpath import schemas
from tillpath.config import Settings
from tillpath.operators import cleaning

NOON = dt.datetime(2020, 3, 1, 12)
NBSP = " "


def line(invoice="1", code="22", text="mug", quantity=2, at=NOON, price=3.0, customer=7.0, country="France"):
    return (invoice, code, text, quantity, at, price, customer, country)


@pytest.fixture
def clean(spark):
    def run(lines, **settings):
        frame = spark.createDataFrame(lines, schemas.RAW)
        return cleaning.clean_transactions(frame, Settings(**settings))

    return run


def test_strip_handles_all_white_space_and_nan(spark):
    raw = spark.createDataFrame(
        [line(text=f"\t{NBSP} two words \r\n"), line(text=" nan "), line(text=None), line(text="\x1fx\x1c")],
        schemas.RAW,
    )
    got = cleaning.strip_strings(cleaning.rename_columns(raw)).select("description").collect()
    assert [r[0] for r in got] == ["two words", None, None, "x"]


def test_exact_copies_go_and_near_copies_stay(spark):
    raw = spark.createDataFrame(
        [line(), line(), line(), line(quantity=3), line(customer=None), line(customer=None)], schemas.RAW
    )
    named = cleaning.rename_columns(raw)
    assert cleaning.drop_duplicates(named).count() == 3
    counted = cleaning.drop_duplicates(named, copies="n")
    assert sorted(r["n"] for r in counted.collect()) == [1, 2, 3]


def test_first_position_of_copies_is_kept(spark):
    named = cleaning.rename_columns(spark.createDataFrame([line(), line()], schemas.RAW))
    placed = named.withColumn("at", F.monotonically_increasing_id())
    lowest = min(r["at"] for r in placed.collect())
    assert [r["at"] for r in cleaning.drop_duplicates(placed, position="at").collect()] == [lowest]


def test_returns_flag(spark):
    raw = spark.createDataFrame(
        [line("C1"), line("1C"), line("c1"), line(None)], schemas.RAW
    )
    got = cleaning.flag_returns(cleaning.rename_columns(raw))
    assert [r["is_return"] for r in got.collect()] == [True, False, False, False]


@pytest.mark.parametrize(
    ("code", "kept"),
    [
        ("22", True), ("POST", False), ("BANK CHARGES", False), ("Q", False), ("q", False),
        ("Ä", False), ("7", True), ("post", True), (None, True), ("AB", True), ("", True),
    ],
)
def test_service_codes(clean, code, kept):
    assert clean([line(code=code), line(code="33")]).lines.count() == 1 + kept


@pytest.mark.parametrize(
    ("invoice", "price", "kept"),
    [
        ("1", 0.0, False), ("1", 0.001, False), ("1", 0.002, True), ("1", -5.0, False),
        ("C1", -5.0, True), ("C1", 0.0, True), ("1", None, True),
    ],
)
def test_prices(clean, invoice, price, kept):
    assert clean([line(invoice, price=price), line("9")]).lines.count() == 1 + kept


def test_zero_quantity(clean):
    got = clean([line(quantity=0), line("2", quantity=1), line("3", quantity=None)])
    assert rows(got.lines, "invoice") == [("2",), ("3",)]


def test_capping_uses_interpolated_bounds_cut_to_whole_numbers(clean):
    lines = [line(str(i), quantity=i + 1) for i in range(7)] + [line("C9", quantity=-90)]
    got = clean(lines, cap_low=0.1, cap_high=0.9)
    report = got.report.first()
    # numpy: quantile of [-90, 1..7] at .1 is -26.3, at .9 is 6.3.
    assert (report["cap_low"], report["cap_high"]) == (-26, 6)
    assert report["quantity_capped"] == 2
    quantities = sorted(r["quantity"] for r in got.lines.collect())
    assert quantities == [-26, 1, 2, 3, 4, 5, 6, 6]


def test_total_uses_the_capped_quantity(clean):
    got = clean(
        [line(quantity=2, price=3.335), line("C2", quantity=-1, price=4.0)], cap_low=0.0, cap_high=1.0
    )
    assert sorted(float(r["total_amount"]) for r in got.lines.collect()) == [-4.0, 6.67]


def test_customer_number(spark):
    df = spark.createDataFrame([("12346.0",), ("7",), ("x",), (None,)], "customer_id string")
    assert [r[0] for r in cleaning.cast_customer(df).collect()] == [12346, 7, None, None]


def test_report_adds_up(clean):
    got = clean([
        line(), line(),                       # a copy
        line("2", code="POST"),               # service code
        line("3", price=0.0),                 # price
        line("4", quantity=0),                # quantity
        line("5", customer=None), line("C6"),
    ])
    report = {r["step"]: r for r in got.report.collect()}
    assert [report[s]["rows_removed"] for s in (
        "drop_duplicates", "filter_non_products", "filter_invalid_prices", "filter_zero_quantity",
    )] == [1, 1, 1, 1]
    one = report["drop_duplicates"]
    assert (one["initial_rows"], one["final_rows"], one["returns_flagged"]) == (7, 3, 1)
    assert (one["rows_with_customer_id"], one["rows_without_customer_id"]) == (2, 1)
    assert one["pct_dropped"] == 57.14
    assert one["final_rows"] == got.lines.count()


def test_a_line_failing_two_tests_counts_once(clean):
    report = clean([line(code="POST", price=0.0, quantity=0), line("2")]).report
    assert [r["rows_removed"] for r in report.orderBy("step_no").collect()] == [0, 1, 0, 0]


def test_cleaning_is_idempotent(spark, clean):
    once = clean([line(str(i), quantity=i + 1, text=" a ") for i in range(30)], cap_low=0.0, cap_high=1.0)
    back = {v: k for k, v in {
        "Invoice": "invoice", "StockCode": "stock_code", "Description": "description",
        "Quantity": "quantity", "InvoiceDate": "invoice_date", "Price": "price",
        "Customer ID": "customer_id", "Country": "country",
    }.items()}
    raw = once.lines.drop("is_return", "total_amount").withColumnsRenamed(back)
    raw = raw.withColumn("Price", F.col("Price").cast("double")).withColumn(
        "Customer ID", F.col("Customer ID").cast("double")
    )
    again = cleaning.clean_transactions(raw, Settings(cap_low=0.0, cap_high=1.0))
    assert rows(again.lines) == rows(once.lines)


def test_empty_feed(clean):
    got = clean([])
    assert got.lines.count() == 0
    assert [r["rows_before"] for r in got.report.collect()] == [0, 0, 0, 0]


def test_prices_below_a_cent_are_rounded_after_the_product(spark):
    from tillpath.operators.cleaning import add_total

    lines = spark.createDataFrame([(982, 0.004), (100, 0.015), (3, 2.5)], "quantity int, price double")
    assert sorted(str(r.total_amount) for r in add_total(lines).collect()) == ["1.50", "3.93", "7.50"]


def test_only_lines_that_may_have_a_copy_are_merged(spark, monkeypatch):
    merged = []
    drop = cleaning.drop_duplicates

    def recorded(df, **options):
        merged.append(df.count())
        return drop(df, **options)

    monkeypatch.setattr(cleaning, "drop_duplicates", recorded)
    lines = [line(str(i)) for i in range(300)] + [line("7"), line("7 "), line("C9"), line("C9"), line(None), line(None)]
    raw = spark.createDataFrame([(*x, i) for i, x in enumerate(lines)], T.StructType([*schemas.RAW.fields, T.StructField("at", T.LongType())]))
    got = cleaning.clean_transactions(raw.repartition(5), position="at")
    # Three of line 7 and two each of the others, and hardly a line that has its class by chance.
    assert len(merged) == 1 and 7 <= merged[0] < 20
    assert got.report.first()["initial_rows"] == 306 and got.report.first()["final_rows"] == 302
    assert rows(got.lines, "at") == sorted(((i,) for i in [*range(300), 302, 304]), key=repr)


def test_lines_that_share_their_class_are_kept_apart(spark, clean, monkeypatch):
    # Two words of 64 classes for 400 lines, in two blocks.
    monkeypatch.setattr(cleaning, "_CLASS_BITS", 7)
    monkeypatch.setattr(cleaning, "_WORDS", 1)
    got = clean([line(str(i % 400), price=0.5) for i in range(500)]).lines
    assert rows(got, "invoice") == sorted(((str(i),) for i in range(400)), key=repr)


@pytest.mark.parametrize("hashes", [1, 500_000])
def test_classes_of_copies(spark, monkeypatch, hashes):
    monkeypatch.setattr(cleaning, "_HASHES", hashes)

    def floats(*values):
        return spark.createDataFrame([(v, None) for v in values], "x double, y string")

    def marked(lines):
        bits = cleaning.copied_classes(lines, ["x", "y"]).collect()
        return {r["_block"] * 32768 + 64 * i + b for r in bits for i, w in enumerate(r["_words"]) for b in range(64) if w >> b & 1}

    classes = floats(0.0, 1.0).select(cleaning._class(cleaning._hash(["x", "y"]))).collect()
    zero, one = (r[0] for r in classes)
    assert marked(floats(0.0, 1.0, 2.0)) == set()
    assert marked(floats(0.0, -0.0, 1.0)) == {zero}
    assert marked(floats(1.0, 0.0, 1.0, 0.0, 1.0)) == {zero, one}
    # Six tasks count five lines that are taken one a task.
    plan = cleaning.copied_classes(floats(0.0, 1.0, 2.0, 3.0, 4.0), ["x", "y"])._jdf.queryExecution().optimizedPlan().toString()
    assert ("RepartitionByExpression [_hash" in plan) and (f", {1 + 5 // hashes}" in plan)
