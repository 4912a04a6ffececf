"""Specs beyond the default one: several rules on a column, several targets, odd names and values."""

import datetime as dt
import json

import pytest

from plumbline import ForeignKey, PipelineSpec, RangeRule, TableSpec, business_impact, validate
from plumbline.functions.values import as_date
from plumbline.model import BRONZE
from plumbline.operators.analytics import evidence_for_check, failed_checks, top_failures
from plumbline.plans.metrics import MetricSheet
from plumbline.plans.report import report_documents

DATE = dt.date(2026, 7, 2)


def library(spark, layers, table, **spec):
    """Results of the rule library over one table, by check name."""
    run = validate(layers, PipelineSpec(tables=(table,), **spec), run_date=DATE)
    return run, {(r["pipeline"], r["check_name"]): r for r in run.results.collect() if r["check_id"].startswith("L1-")}


def test_two_foreign_keys_on_one_column(spark):
    child = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    layers = {"t": child, "a": child.where("k = 1"), "b": child}
    table = TableSpec("t", BRONZE, foreign_keys=(ForeignKey("k", "a", "k"), ForeignKey("k", "b", "k")))
    _, rows = library(spark, layers, table)
    found = {name: r["observed_value"] for (_, name), r in rows.items() if "Foreign" in name}
    assert found == {"Foreign Key Integrity: k -> a.k": 2, "Foreign Key Integrity: k -> b.k": 0}


def test_foreign_key_stays_inside_its_pipeline(spark):
    child = spark.createDataFrame([("A", 1), ("A", 2), ("B", 2)], "pipeline string, k int")
    parent = spark.createDataFrame([("A", 1), ("B", 2)], "pipeline string, k int")
    table = TableSpec("t", BRONZE, foreign_keys=(ForeignKey("k", "p", "k"),))
    _, rows = library(spark, {"t": child, "p": parent}, table)
    found = {p: r["observed_value"] for (p, name), r in rows.items() if "Foreign" in name}
    assert found == {"A": 1, "B": 0}
    _, rows = library(spark, {"t": child, "p": parent.drop("pipeline")}, table)
    assert {r["observed_value"] for (_, name), r in rows.items() if "Foreign" in name} == {0}


def test_several_ranges_exact_bounds_and_spaced_names(spark):
    rows = [(-1, 1234568.0, 5), (5, 1234569.0, 50), (11, 1234566.0, -5)]
    table = TableSpec(
        "t",
        BRONZE,
        ranges=(RangeRule("x", min=0), RangeRule("x", max=10), RangeRule("big", min=1234567), RangeRule("unit price", min=0.125)),
    )
    run, found = library(spark, {"t": spark.createDataFrame(rows, "x int, big double, `unit price` int")}, table)
    values = {name: (r["status"], r["observed_value"]) for (_, name), r in found.items() if "Range" in name}
    assert values == {
        "Range Check: x (>= 0)": ("FAIL", 1),
        "Range Check: x (<= 10)": ("FAIL", 1),
        "Range Check: big": ("FAIL", 1),
        "Range Check: unit price": ("FAIL", 1),
    }
    flagged = {r["check_name"] for r in failed_checks(run.results).collect()}
    assert set(values) <= flagged
    shown = [r["check_name"] for r in evidence_for_check(run.results).collect()]
    assert len(shown) == len(set(shown))
    assert top_failures(run.results, None).count() == failed_checks(run.results).count()


def test_colliding_short_ids_lose_no_failure(spark):
    table = TableSpec("t", BRONZE, ranges=(RangeRule("total_a", min=0), RangeRule("total_b", min=0)))
    run, _ = library(spark, {"t": spark.createDataFrame([(-1, -1)], "total_a int, total_b int")}, table)
    names = [r["check_name"] for r in failed_checks(run.results).collect()]
    assert {"Range Check: total_a", "Range Check: total_b"} <= set(names) and len(names) == len(set(names))


def test_null_lists_of_equal_length_do_not_clash(spark):
    silver = spark.createDataFrame([(None, 1), (2, None), (3, None)], "x int, y int")
    table = TableSpec("silver_orders", BRONZE, mandatory=("x",))
    run, found = library(spark, {"silver_orders": silver}, table, silver_mandatory=("y",))
    assert {r["observed_value"] for (_, name), r in found.items() if "Null" in name} == {1}


def test_derive_refuses_another_text(spark):
    sheet = MetricSheet({}, PipelineSpec(), (), "default")
    assert sheet.derive("a", "1") == sheet.derive("a", "1")
    with pytest.raises(ValueError, match="already defined"):
        sheet.derive("a", "2")


def test_report_survives_quotes_in_names(spark):
    bronze = spark.createDataFrame([(1,)], 'k int').withColumnRenamed("k", 'a"b')
    run = validate({"bronze_orders": bronze}, PipelineSpec(), run_date=DATE)
    documents = report_documents(run.results, run.impact).collect()
    assert len(documents) == 1 and all(json.loads(d["report"]) for d in documents)


def test_empty_gold_has_no_impact(spark):
    bronze = spark.createDataFrame([("i", "s", 1, 2.0)], "invoice_no string, stock_code string, quantity int, unit_price double")
    gold = spark.createDataFrame([], "total_revenue double")
    row = business_impact({"bronze_orders": bronze, "gold_metrics": gold}).head()
    assert row["status"] == "NOT_AVAILABLE"


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2024-01-15", "2024-01-15"),
        ("2024-01-15 10:30:00", "2024-01-15"),
        ("2024-01-15T10:30:00.123Z", "2024-01-15"),
        ("2024-01-15 23:30:00+02:00", "2024-01-15"),
        ("2024", None),
        ("2024-01-15 rubbish", None),
        ("2024-13-01", None),
    ],
)
def test_dates_with_a_time_of_day(spark, text, day):
    frame = spark.createDataFrame([(text,)], "d string")
    value = frame.selectExpr(f"CAST({as_date('d', frame.schema['d'].dataType)} AS STRING) AS v").head()["v"]
    assert value == day


def test_date_evidence_gives_the_observed_number(spark):
    rows = spark.createDataFrame([("2024",), ("2024-01-15 10:00:00",), (None,), ("x",)], "d string")
    _, found = library(spark, {"t": rows}, TableSpec("t", BRONZE, date_columns=("d",)))
    check = next(r for (_, name), r in found.items() if name.startswith("Date Parse"))
    rows.createOrReplaceTempView("t")
    assert spark.sql(check["evidence_query"]).head()[0] == check["observed_value"] == 2
