from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillpath import schemas  # noqa: E402
from tillpath.operators.star import calendar  # noqa: E402
from tillpath.schemas import Star  # noqa: E402
from tillpath.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def rows(df, *columns):
    """Rows as sorted tuples of the given columns."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


@pytest.fixture(scope="session")
def make_star(spark):
    """A star from (invoice, customer, product, day, quantity, price) tuples."""

    def build(lines, first="2020-01-01", last="2021-12-31") -> Star:
        span = spark.sql(f"SELECT DATE'{first}' AS first_day, DATE'{last}' AS last_day")
        dates = calendar(span)
        start = day(first)
        fact = spark.createDataFrame(
            [
                (
                    i + 1, invoice, customer, product, (day(on) - start).days + 1, quantity,
                    float(price), float(quantity) * float(price), invoice.startswith("C"),
                )
                for i, (invoice, customer, product, on, quantity, price) in enumerate(lines)
            ],
            "transaction_id long, invoice_no string, customer_id long, product_id long, date_id int, "
            "quantity int, unit_price double, total_amount double, is_return boolean",
        )
        fact = fact.withColumn("unit_price", fact["unit_price"].cast("decimal(10,2)")).withColumn(
            "total_amount", fact["total_amount"].cast("decimal(12,2)")
        )
        spans = {}
        for _, customer, _, on, _, _ in lines:
            lo, hi = spans.get(customer, (on, on))
            spans[customer] = (min(lo, on), max(hi, on))
        customers = spark.createDataFrame(
            [
                (c, "France" if c % 2 else "Japan", day(lo), day(hi), "25-34",
                 "Europe" if c % 2 else "Asia Pacific", "Direct")
                for c, (lo, hi) in spans.items()
            ],
            schemas.DIM_CUSTOMERS,
        )
        products = spark.createDataFrame(
            [(p, f"S{p}", f"thing {p}", None, None) for p in sorted({line[2] for line in lines})],
            schemas.DIM_PRODUCTS,
        )
        return Star(fact=fact, dates=dates, customers=customers, products=products)

    return build
