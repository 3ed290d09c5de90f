from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks import testbed
from tests.conftest import day
from tillpath import schemas
from tillpath.fixed_values import AGE_SHARES, CHANNEL_SHARES, COUNTRY_REGION
from tillpath.operators import star, validation
from tillpath.session import cut
from tillpath.schemas import Star


def cleaned(spark, lines):
    data = [
        (invoice, code, text, 1, dt.datetime.combine(day(on), dt.time(9)), price, customer, country,
         invoice.startswith("C"), price)
        for invoice, code, text, on, price, customer, country in lines
    ]
    frame = spark.createDataFrame(
        data,
        "invoice string, stock_code string, description string, quantity int, invoice_date timestamp, "
        "price double, customer_id long, country string, is_return boolean, total_amount double",
    )
    return frame.withColumn("price", F.col("price").cast("decimal(18,6)")).withColumn(
        "total_amount", F.col("total_amount").cast("decimal(12,2)")
    )


@pytest.fixture(scope="module")
def lines(spark):
    return cleaned(spark, [
        ("1", "B2", "red", "2020-02-28", 1.0, 7, "France"),
        ("2", "B2", "red", "2020-02-28", 2.0, 7, "Japan"),
        ("3", "B2", "blue", "2020-03-02", 3.0, 8, "Atlantis"),
        ("4", "A1", "two", "2020-03-02", 5.0, None, "France"),
        ("5", "A1", "one", "2020-03-01", 6.01, 9, None),
        ("C6", "Z9", "gone", "2020-03-02", 4.0, 8, "Atlantis"),
        ("7", "N0", None, "2020-03-02", 4.0, 9, "Japan"),
    ])


def test_calendar_has_every_day(lines):
    got = star.dim_dates(lines).orderBy("date_id").collect()
    assert [r["full_date"] for r in got] == [
        day("2020-02-28"), day("2020-02-29"), day("2020-03-01"), day("2020-03-02"),
    ]
    assert [r["date_id"] for r in got] == [1, 2, 3, 4]
    first = got[0]
    assert (first["day_name"], first["day_of_week"], first["is_weekend"]) == ("Friday", 4, False)
    assert (first["month_name"], first["quarter"], first["year"]) == ("February", 1, 2020)
    assert [r["is_weekend"] for r in got] == [False, True, True, False]
    assert not any(r["is_holiday"] for r in got)


@pytest.mark.parametrize("partitions", [1, 3])
def test_products_in_code_order(lines, partitions):
    got = star.dim_products(lines, partitions=partitions).orderBy("product_id").collect()
    assert [(r["product_id"], r["stock_code"], r["description"]) for r in got] == [
        (1, "A1", "one"), (2, "B2", "red"), (3, "N0", None),
    ]
    assert [float(r["avg_unit_price"]) for r in got] == [5.51, 2.0, 4.0]
    assert {r["category"] for r in got} == {None}


def test_customers(lines):
    got = {r["customer_id"]: r for r in star.dim_customers(lines).collect()}
    assert set(got) == {7, 8, 9}
    assert got[7]["country"] == "France" and got[7]["region"] == "Europe"
    assert got[8]["region"] == "Other"
    assert got[9]["country"] == "Japan"
    assert (got[8]["first_purchase"], got[8]["last_purchase"]) == (day("2020-03-02"), day("2020-03-02"))


def test_first_country_follows_the_given_position(lines):
    backwards = lines.withColumn("at", -F.unix_timestamp("invoice_date") - F.col("invoice").substr(1, 1).try_cast("int"))
    got = {r["customer_id"]: r["country"] for r in star.dim_customers(backwards, position="at").collect()}
    assert got[7] == "Japan"


def test_region_lookup_is_complete(spark):
    assert len(COUNTRY_REGION) == 41
    places = spark.createDataFrame([(c,) for c in [*COUNTRY_REGION, "West Indies"]], "country string")
    got = {r["country"]: r["region"] for r in star.with_region(places).collect()}
    assert got.pop("West Indies") == "Other"
    assert got == COUNTRY_REGION


def test_demographics_follow_their_shares_and_not_the_partitions(spark):
    keys = spark.range(20000).withColumnRenamed("id", "customer_id")
    one = star.with_demographics(keys.repartition(1))
    many = star.with_demographics(keys.repartition(7))
    assert one.exceptAll(many).count() == 0
    for column, shares in (("acquisition_channel", CHANNEL_SHARES), ("age_group", AGE_SHARES)):
        found = {r[0]: r[1] / 20000 for r in one.groupBy(column).count().collect()}
        assert set(found) == set(shares)
        assert all(abs(found[k] - shares[k]) < 0.015 for k in shares)


def test_fact_keys(lines):
    built = star.build_star(lines)
    got = built.fact.collect()
    # The line without customer and the code that was only returned are gone.
    assert sorted(r["invoice_no"] for r in got) == ["1", "2", "3", "5", "7"]
    assert sorted(r["transaction_id"] for r in got) == [1, 2, 3, 4, 5]
    assert built.fact.columns == schemas.FACT.names
    by_day = sorted(got, key=lambda r: r["transaction_id"])
    assert [r["date_id"] for r in by_day] == sorted(r["date_id"] for r in by_day)


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_line_numbers_are_dense_with_identical_lines(spark, buckets):
    df = spark.range(300).select(
        (F.col("id") % 3).cast("int").alias("date_id"), F.lit("same").alias("text"), "id"
    )
    got = star.number_lines(df, ["text"], buckets=buckets)
    assert sorted(r["transaction_id"] for r in got.collect()) == list(range(1, 301))


def test_lines_are_stored_with_their_place(spark):
    df = spark.range(50).select(F.lit(1).alias("date_id"), F.col("id").cast("string").alias("text"))
    got = star.number_lines(df, ["text"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # What is read again needs no window over rows, and so no shuffle of them.
    assert "row_number" not in plan and "_digest" not in plan
    assert sorted(r["transaction_id"] for r in got.collect()) == list(range(1, 51))


@pytest.mark.parametrize("most, kind", [(100, "LeftAnti"), (0, "LeftSemi")])
def test_lines_of_customers_with_missing_null_and_repeated_keys(spark, most, kind):
    sold = spark.createDataFrame(
        [("1", 7), ("2", 7), ("3", 8), ("4", None), ("5", 9), ("5", 9)], "invoice string, customer_id long"
    )
    customers = spark.createDataFrame([(7,), (7,), (9,), (None,)], "customer_id long")
    got = star.of_customers(sold, customers, most=most)
    assert sorted((r["invoice"], r["customer_id"]) for r in got.collect()) == [("1", 7), ("2", 7), ("5", 9), ("5", 9)]
    assert kind in got._jdf.queryExecution().optimizedPlan().toString()


def test_raw_feed_joins_orders_and_customers_before_the_lines(spark, tmp_path):
    moment = dt.datetime(1998, 12, 15)
    made = {
        "customer": ([(1, 0), (2, 1), (2, 2)], "c_custkey long, c_nationkey int"),
        "orders": ([(5, 1, moment), (6, 2, moment), (7, None, moment)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "part": ([(3, "red ring")], "p_partkey long, p_name string"),
        "lineitem": (
            [(5, 3, 1.0, 2.0, "N"), (6, 3, 2.0, 4.0, "R"), (6, 4, 2.0, 4.0, "N"), (7, 3, 1.0, 2.0, "N")],
            "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string",
        ),
    }
    for name, (data, kind) in made.items():
        spark.createDataFrame(data, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    parts = testbed.raw_parts(spark, str(tmp_path))
    for part in parts:
        got = sorted((r["Invoice"], r["Country"], r["Quantity"]) for r in part.collect())
        assert got == [("5", "United Kingdom", 1), ("C6", "EIRE", -2), ("C6", "France", -2)]
        joins = [x for x in part._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
        assert "p_partkey" in joins[0] and "o_custkey" in joins[-1]


def test_order_lines_are_moved_without_the_text_of_the_flag(spark, tmp_path):
    moment = dt.datetime(1998, 1, 15)
    made = {
        "customer": ([(1, 0)], "c_custkey long, c_nationkey int"),
        "orders": ([(5, 1, moment)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "part": ([(3, "red ring")], "p_partkey long, p_name string"),
        "lineitem": (
            [(5, 3, 1.0, 2.0, "N"), (5, 3, 1.0, 2.0, "R"), (5, 3, 1.0, 2.0, None)],
            "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string",
        ),
    }
    for name, (data, kind) in made.items():
        spark.createDataFrame(data, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    feed = testbed.raw_parts(spark, str(tmp_path))[0]
    assert sorted((r["Invoice"], r["Quantity"]) for r in feed.collect()) == [("5", 1), ("5", 1), ("C5", -1)]
    plan = feed._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, x in enumerate(plan) if "Join" in x]
    assert all(i > joins[1] for i, x in enumerate(plan) if "l_returnflag" in x)


def test_of_customers_computes_no_more_than_their_numbers(spark):
    sold = spark.createDataFrame([("1", 7), ("2", 8)], "invoice string, customer_id long")
    fails = F.raise_error(F.concat(F.lit("computed for "), "customer_id")).cast("string")
    customers = star.with_region(sold.groupBy("customer_id").agg(F.max(fails).alias("country")))
    assert sorted(r["invoice"] for r in star.of_customers(sold, customers).collect()) == ["1", "2"]


def test_lines_are_moved_without_what_follows_from_other_columns(lines, monkeypatch):
    staged = []
    monkeypatch.setattr(star, "stage", lambda df, name: staged.append(df) or df)
    star.build_star(lines).fact.collect()
    (placed,) = staged
    plan = placed._jdf.queryExecution().executedPlan().toString().splitlines()
    moved = [i for i, x in enumerate(plan) if "Exchange hashpartitioning(date_id" in x]
    joined = [i for i, x in enumerate(plan) if "Join" in x and "stock_code" in x]
    # One move by day and bucket, with neither the bucket nor the price before it is rounded.
    assert len(moved) == 1 and joined[0] > moved[0]
    assert not any("_bucket" in x for x in plan[moved[0] + 1:])
    columns = plan[moved[0] + 1]
    assert "Project" in columns and "unit_price" in columns
    # The lines meet the products before the calendar.
    joins = [x for x in placed._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert "full_date" in joins[0] and "stock_code" in joins[1]


def test_validation_finds_planted_faults(lines):
    built = star.build_star(lines)
    expected = {"dim_dates": 4, "dim_products": 3, "dim_customers": 3, "fact_transactions": 5}
    report = validation.validation_report(built, expected)
    assert validation.all_passed(report).first()["success"]
    broken = Star(
        fact=built.fact.withColumn("customer_id", F.when(F.col("invoice_no") != "1", F.col("customer_id"))),
        dates=built.dates.where("date_id <> 3"),
        customers=built.customers.where("customer_id <> 8"),
        products=built.products,
    )
    report = validation.validation_report(broken, expected)
    failed = {r["check"]: r["details"] for r in report.where("NOT passed").collect()}
    assert failed == {
        "row_count:dim_dates": "expected=4, actual=3",
        "row_count:dim_customers": "expected=3, actual=2",
        "fk_integrity:dim_customers": "orphan_rows=2",
        "fk_integrity:dim_dates": "orphan_rows=1",
        "no_null_customer_id_in_fact": "null_customer_rows=1",
    }
    # The fact is read once for all checks.
    once = validation.validation_report(
        Star(fact=cut(built.fact), dates=built.dates, customers=built.customers, products=built.products), expected
    )
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transaction_id#") <= 1
    outcome = validation.all_passed(report).first()
    assert not outcome["success"] and outcome["failed"] == 5
