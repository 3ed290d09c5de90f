from __future__ import annotations

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillpath import schemas
from tillpath.fixed_values import RAW_TO_CLEAN
from tillpath.operators import serving
from tillpath.plans.churn import run_churn
from tillpath.plans.etl import run_etl_from_files
from tillpath.plans.forecast import run_forecast
from tillpath.plans.report import build_report, run_report, write_report
from tillpath.plans.segmentation import run_segmentation
from tillpath.operators.series import monthly_series
from tillpath.operators.orders import with_calendar
from tillpath.session import _FREE_SHUFFLES, cut, scope, settled, shared_folder, stage
from tillpath.sources import feeds, reports, tables

HEADER = list(RAW_TO_CLEAN)


def write_part(path, lines, header=HEADER):
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([header, *lines])


def sale(i, customer="7.0", country="France", at="2020-03-01 09:00:00", invoice=None):
    return [invoice or str(i), f"S{i % 5}", f"thing {i % 5}", i % 4 + 1, at, "2.50", customer, country]


def test_parts_are_stacked_and_columns_found_by_name(spark, tmp_path):
    write_part(tmp_path / "a.csv", [sale(1), sale(2)])
    swapped = HEADER[::-1]
    write_part(tmp_path / "b.csv", [sale(2)[::-1], ["Chile", "x", "", "", "", "", "S1", "9"]], swapped)
    got = feeds.read_parts(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert got.schema.names == schemas.RAW.names and got.count() == 4
    assert got.dropDuplicates().count() == 3
    odd = got.where("Country = 'Chile'").first()
    assert odd["Price"] is None and odd["Customer ID"] is None and odd["StockCode"] == "S1"


def test_json_and_parquet_parts(spark, tmp_path):
    write_part(tmp_path / "a.csv", [sale(1), sale(2)])
    whole = feeds.read_parts(spark, [str(tmp_path / "a.csv")])
    for fmt in ("json", "parquet"):
        whole.write.format(fmt).save(str(tmp_path / fmt))
        assert rows(feeds.read_parts(spark, [str(tmp_path / fmt)], fmt)) == rows(whole)


def test_missing_column_is_an_error(spark, tmp_path):
    write_part(tmp_path / "a.csv", [sale(1)[:-1]], HEADER[:-1])
    with pytest.raises(ValueError, match="Country"):
        feeds.read_parts(spark, [str(tmp_path / "a.csv")])
    with pytest.raises(ValueError, match="no parts"):
        feeds.union_parts([])


def test_positions_follow_part_and_row(spark, tmp_path):
    write_part(tmp_path / "a.csv", [sale(i) for i in range(5)])
    write_part(tmp_path / "b.csv", [sale(i) for i in range(5, 8)])
    got = feeds.read_parts(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], position="at")
    assert [r["Invoice"] for r in got.orderBy("at").collect()] == [str(i) for i in range(8)]


def test_full_refresh_replaces_and_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.full_refresh(spark.range(10).toDF("a"), path) == 10
    assert tables.full_refresh(spark.range(3).toDF("a"), path) == 3
    assert tables.read_table(spark, path).count() == 3


def test_a_failed_load_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.full_refresh(spark.range(10).toDF("a"), path)
    before = tables.read_table(spark, path)
    fails = F.when(F.col("id") == 900, F.raise_error(F.lit("half-way"))).otherwise(F.col("id"))
    with pytest.raises(Exception, match="half-way"):
        tables.full_refresh(spark.range(0, 1000, 1, 4).select(fails.cast("long").alias("a")), path)
    assert sorted(os.listdir(path)) == sorted(["_published", os.path.basename(tables.current(spark, path))])
    assert tables.read_table(spark, path).count() == before.count() == 10
    # A writer that died without a chance to clean up.
    spark.range(5).toDF("a").write.parquet(str(tmp_path / "t" / "v-dead"))
    assert tables.read_table(spark, path).count() == 10


def test_readers_keep_their_version_during_a_load(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, path)
    tables.full_refresh(spark.range(10).toDF("a"), path)
    old = tables.read_table(spark, path)
    tables.full_refresh(old.where("a < 4"), path)  # a table made from its own last version
    assert old.count() == 10 and tables.read_table(spark, path).count() == 4
    tables.full_refresh(spark.range(2).toDF("a"), path)
    assert len([d for d in os.listdir(path) if d.startswith("v-")]) == 2
    assert tables.read_table(spark, path).count() == 2


def test_scope_removes_what_it_staged(spark):
    base = shared_folder(spark).removeprefix("file:")
    outside = cut(spark.range(7))
    with pytest.raises(ZeroDivisionError):
        with scope(spark) as own:
            inner = stage(spark.range(3), "x")
            with scope(spark) as nested:
                assert stage(spark.range(2), "y").count() == 2 and nested != own
            assert not os.path.exists(nested) and inner.count() == cut(spark.range(3)).count() == 3
            kept = settled(inner.agg(F.count("id").alias("n")))
            1 / 0
    assert not os.path.exists(own) and kept.first()["n"] == 3
    assert outside.count() == 7 and os.path.exists(base)
    assert not shared_folder(spark).removeprefix("file:").startswith(own)


def folders(spark):
    top = os.path.dirname(shared_folder(spark).removeprefix("file:"))
    return {os.path.join(d, f) for d, _, files in os.walk(top) for f in files}


def test_etl_leaves_nothing_behind(spark, tmp_path):
    write_part(tmp_path / "a.csv", [sale(i) for i in range(40)])
    before = folders(spark)
    result = run_etl_from_files(spark, [str(tmp_path / "a.csv")], str(tmp_path / "star"))
    assert folders(spark) == before
    assert result.success and result.validation.count() == 8 and result.cleaning_report.count() == 4
    assert (result.lines_read, result.lines_refused) == (40, 0)


def test_calendar_filters_prune_the_stored_fact_at_run_time(spark, tmp_path):
    lines = [sale(i, at=f"20{18 + i % 3}-{i % 12 + 1:02d}-05 10:00:00") for i in range(200)]
    write_part(tmp_path / "a.csv", lines)
    run_etl_from_files(spark, [str(tmp_path / "a.csv")], str(tmp_path / "star"))
    star = tables.read_star(spark, str(tmp_path / "star"))
    quarter = with_calendar(star.fact, star.dates.where("quarter = 3 AND year = 2019"), "full_date")
    plan = quarter._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    want = star.fact.join(star.dates.select("date_id", "quarter"), "date_id").where("quarter = 3 AND year = 2019")
    assert quarter.count() == want.count() > 0


def test_lines_that_do_not_fit_are_counted(spark, tmp_path):
    head = ",".join(HEADER)
    fits = "1,A,d,1,2020-01-01 00:00:00,2.5,7.0,France"
    (tmp_path / "a.csv").write_text(
        "\n".join([head, fits, "2,B", fits + ",more", '3,C,"one', 'two",1,2020-01-01 00:00:00,2.5,7.0,Chile', fits]) + "\n"
    )
    lines = feeds.read_lines(spark, [str(tmp_path)])
    assert tuple(feeds.feed_account(lines).first()) == (6, 2, 4)
    refused = {r[0] for r in lines.where(f"{feeds.REFUSED} IS NOT NULL").select(feeds.REFUSED).collect()}
    assert "2,B" in refused and fits + ",more" in refused
    counts = feeds.account()
    kept = feeds.read_parts(spark, [str(tmp_path)], counts=counts)
    # A reader that needs one column only sees the same lines.
    assert [r[0] for r in kept.select("Country").collect()] == ["France", "France"]
    assert counts.get == {"lines_read": 6, "lines_refused": 4}
    result = run_etl_from_files(spark, [str(tmp_path)], str(tmp_path / "star"), multi_line=True)
    assert (result.lines_read, result.lines_refused) == (5, 2)


def test_headers_are_found_in_many_files_of_many_pieces(spark, tmp_path):
    """Large and small files, headers in two orders, files cut into pieces: every head once, right for its file."""
    for i in range(6):
        order = HEADER if i % 2 else HEADER[::-1]
        rows_ = [sale(k) for k in range(3000 if i < 3 else 5)]
        write_part(tmp_path / f"{i}.csv", rows_ if i % 2 else [r[::-1] for r in rows_], order)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        heads = feeds._heads(spark, str(tmp_path)).collect()
        got = feeds.read_parts(spark, [str(tmp_path)])
        assert got.where("Country = 'France'").count() == got.count() == 9015
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((os.path.basename(r["file"]), r["head"][:7]) for r in heads) == [
        (f"{i}.csv", "Invoice" if i % 2 else "Country") for i in range(6)
    ]


def test_reports_round_trip_and_may_be_absent(spark, tmp_path):
    path = str(tmp_path / "models")
    empty = reports.read_report(spark, path, schemas.MODEL_COMPARISON)
    assert empty.count() == 0 and empty.schema.names == schemas.MODEL_COMPARISON.names
    table = spark.createDataFrame(
        [("b", 0.5, 0.6, 0.7, 0.8, 0.9), ("a", 0.1, 0.2, 0.3, 0.9, 0.5)], schemas.MODEL_COMPARISON
    )
    reports.write_csv(table, path)
    stored = reports.read_report(spark, path, schemas.MODEL_COMPARISON)
    assert rows(stored) == rows(table)
    assert [r["model_name"] for r in serving.model_metrics(stored).collect()] == ["a", "b"]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.sparkContext.getCheckpointDir()


def test_jobs_from_files_to_forecast(spark, tmp_path):
    """The chain on a small shop: two overlapping files, three years, 30 customers."""
    months = [f"{2018 + m // 12}-{m % 12 + 1:02d}" for m in range(36)]
    lines = [
        sale(m * 30 + c, f"{c}.0", "France" if c % 3 else "Japan", f"{text}-{c % 27 + 1:02d} 10:00:00")
        for m, text in enumerate(months) for c in range(1, 31) if (m + c) % (c % 4 + 1) == 0
    ]
    returns = [sale(5000 + c, f"{c}.0", at="2019-05-05 10:00:00", invoice=f"C{c}") for c in range(1, 6)]
    for row in returns:
        row[3] = -1
    write_part(tmp_path / "a.csv", lines[:400])
    write_part(tmp_path / "b.csv", lines[380:] + returns)
    root = str(tmp_path / "star")
    result = run_etl_from_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], root)
    assert result.success, result.validation.collect()
    assert result.rows_loaded["fact_transactions"] == len(lines) + 5
    assert result.cleaning_report.where("step = 'drop_duplicates'").first()["rows_removed"] == 20

    star = tables.read_star(spark, root)
    assert star.fact.where("year = 2019").select(F.count_distinct("month")).first()[0] == 12
    plan = star.fact.where("year = 2019 AND month = 5")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan

    write_report(build_report(star, "France"), str(tmp_path / "report"))
    folder = tmp_path / "report" / "summary"
    text = [p for p in os.listdir(folder) if p.endswith(".json")]
    summary = json.loads((folder / text[0]).read_text())
    assert summary["peak_month"] and 0 < summary["home_revenue_share"] < 100

    segmented = run_segmentation(star, sweep=False, restarts=2)
    assert segmented.feature_table.count() == 30
    assert segmented.feature_table.where("segment_name IS NULL OR churn_label").count() == 0

    churn = run_churn(star, segmented.feature_table, models=("logistic_regression",))
    assert churn.best == "logistic_regression" and churn.scores.count() == 30
    table = churn.feature_table
    assert table.where("churn_probability IS NULL OR product_diversity IS NULL").count() == 0
    assert churn.threshold.count() == 1

    forecast = run_forecast(monthly_series(star.fact, star.dates))
    assert forecast.best.count() == 1
    assert forecast.forecast.where("error IS NULL").count() == 6
    assert forecast.comparison.count() == 3


_LINE = '536365,{code},"DOORMAT 16"" X 24"", RED",6,2010-12-01 08:26:00,2.5,17850.0,United Kingdom\n'


def test_csv_with_quotes_and_two_column_orders(spark, tmp_path):
    from tillpath.sources.feeds import read_parts

    names = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country"
    (tmp_path / "a.csv").write_text(names + "\n" + _LINE.format(code="A"))
    other = "Country,Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID"
    (tmp_path / "b.csv").write_text(other + '\nFrance,1,B,"x, ""y""",8,2010-12-01 08:26:00,1.5,7.0\n')
    got = {r.StockCode: r for r in read_parts(spark, [str(tmp_path)]).collect()}
    assert got["A"].Description == 'DOORMAT 16" X 24", RED' and got["A"]["Customer ID"] == 17850.0
    assert got["B"].Description == 'x, "y"' and got["B"].Country == "France" and got["B"].Quantity == 8
    (tmp_path / "c.csv").write_text("Invoice,StockCode\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        read_parts(spark, [str(tmp_path)])


def test_json_whose_first_record_lacks_a_null_field(spark, tmp_path):
    import json

    from tillpath.sources.feeds import read_parts

    full = {"Invoice": "1", "StockCode": "A", "Description": "d", "Quantity": 1, "InvoiceDate": "2010-12-01T08:26:00",
            "Price": 1.5, "Customer ID": 7.0, "Country": "France"}
    first = {k: v for k, v in full.items() if k != "Customer ID"}
    (tmp_path / "a.json").write_text(json.dumps(first) + "\n" + json.dumps(full) + "\n")
    got = read_parts(spark, [str(tmp_path)], "json").collect()
    assert sorted(str(r["Customer ID"]) for r in got) == ["7.0", "None"]
    (tmp_path / "a.json").write_text(json.dumps(first) + "\n")
    with pytest.raises(ValueError, match="Customer ID"):
        read_parts(spark, [str(tmp_path)], "json")


def test_report_files_are_in_order(spark, tmp_path):
    months = [(2019 + m // 12, m % 12 + 1, float(m)) for m in range(40)]
    table = spark.createDataFrame(months[::-1], "year int, month int, revenue double").repartition(7)
    places = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 5.0)], "country string, revenue double")
    write_report({"revenue_trends": table, "geographic_breakdown": places}, str(tmp_path))

    def lines(name):
        parts = sorted(p for p in os.listdir(tmp_path / name) if p.endswith(".csv"))
        return [line for p in parts for line in (tmp_path / name / p).read_text().splitlines()[1:]]

    assert lines("revenue_trends") == [",".join(map(str, m)) for m in months]
    assert lines("geographic_breakdown") == ["c,5.0", "a,1.0", "b,1.0"]


def test_run_report_writes_and_cleans_up(spark, tmp_path, make_star):
    star = make_star([(f"{c}-{m}", c, 1, f"2020-{m:02d}-0{c}", 2, 3) for m in range(1, 13) for c in (1, 2, 3)])
    before = folders(spark)
    run_report(star, "France", str(tmp_path / "report"))
    assert folders(spark) == before
    assert {"summary", "revenue_trends", "churn_tests"} <= set(os.listdir(tmp_path / "report"))


def test_staged_tables_leave_no_shuffle_files(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}

    before = shuffles()
    with scope(spark):
        counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
        staged = stage(counted, "counted")
        assert shuffles() <= before
        assert all(".zstd." in f for f in staged.inputFiles())
        # The frame itself can still be computed.
        assert rows(staged) == rows(counted) and spark.conf.get(_FREE_SHUFFLES) == "false"
