"""Scenarios of the check catalogue, validated together as pipelines of one run."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fixtures import GOLDEN_DATE, gold, healthy, history, orders, with_revenue
from plumbline.operators.faults import stack_cases
from plumbline.operators.rollup import summarize
from plumbline.plans.run import validate
from plumbline.sources.layers import build_gold_country, build_gold_metrics


def _with(layers, **changes):
    out = {**layers, **changes}
    return {k: v for k, v in out.items() if v is not None}


@pytest.fixture(scope="module")
def found(spark):
    base = healthy(spark, 100)
    bronze = base["bronze_orders"]
    silver = base["silver_orders"]
    two_lines = orders(spark, 2, invoice_no="INV1", stock_code=F.format_string("S%d", F.col("id")),
                       quantity=F.when(F.col("id") == 2, 25).otherwise(1), customer_id=1)
    nulls = orders(spark, 4, customer_id=F.when(F.col("id") > 2, F.lit(None)).otherwise(F.col("id")))
    loss = with_revenue(orders(spark, 100, quantity=F.when(F.col("id") > 95, 0).otherwise(1)))
    cases = {
        "healthy": _with(base, raw_orders=bronze),
        "short_bronze": _with(base, raw_orders=bronze, bronze_orders=orders(spark, 90)),
        "one_duplicate": _with(base, bronze_orders=orders(spark, 50).unionByName(orders(spark, 1))),
        "many_duplicates": _with(base, bronze_orders=orders(spark, 10).unionByName(orders(spark, 5))),
        "drop_5": _with(base, silver_orders=with_revenue(orders(spark, 95)), historical_runs=None),
        "drop_28": _with(base, silver_orders=with_revenue(orders(spark, 72)), historical_runs=None),
        "lost_24": _with(base, silver_orders=with_revenue(orders(spark, 76))),
        "lost_line": _with(base, bronze_orders=two_lines,
                           silver_orders=with_revenue(two_lines.filter("quantity = 1"))),
        "null_keys_match": _with(base, bronze_orders=nulls, silver_orders=with_revenue(nulls)),
        "bad_signs": _with(base, silver_orders=with_revenue(
            orders(spark, 3, quantity=F.col("id") - 2, unit_price=F.when(F.col("id") == 3, 0.0).otherwise(5.0)))),
        "negative_bronze": _with(base, bronze_orders=orders(spark, 5, quantity=F.col("id") - 3, unit_price=-1.0)),
        "gold_revenue": _with(base, gold_metrics=gold(spark, 998.0, 100, 100, 9.98)),
        "gold_orders": _with(base, gold_metrics=gold(spark, 1000.0, 999, 100, 10.0)),
        "gold_null": _with(base, gold_metrics=gold(spark, None, 100, 100, 10.0)),
        "low_revenue": _with(
            base,
            bronze_orders=orders(spark, 100, quantity=F.when(F.col("id") > 95, 0).otherwise(1)),
            silver_orders=loss.filter("quantity > 0"),
            gold_metrics=build_gold_metrics(loss.filter("quantity > 0")),
            gold_country_revenue=build_gold_country(loss.filter("quantity > 0")),
            historical_runs=history(spark, [(100, 95, 4.9 + 0.05 * i, 10000.0 + 10 * i) for i in range(5)]),
        ),
        "country_gap": _with(base, gold_country_revenue=spark.createDataFrame(
            [("United Kingdom", 1000.0), ("Atlantis", 50.0), (None, 0.5)], "country string, revenue double")),
        "unknown_silver": _with(base, silver_orders=with_revenue(orders(spark, 101))),
        "future": _with(base, bronze_orders=orders(spark, 20, invoice_date="2026-08-01")),
        "stale": _with(base, bronze_orders=orders(spark, 20, invoice_date="2025-01-01")),
        "wide_dates": _with(base, bronze_orders=orders(
            spark, 20, invoice_date=F.when(F.col("id") == 1, "2024-06-17").otherwise("2026-06-17"))),
        "bad_dates": _with(base, bronze_orders=orders(spark, 20, invoice_date="June 17")),
        "orphan": _with(base, silver_orders=with_revenue(
            orders(spark, 100, customer_id=F.when(F.col("id") == 1, 999999).otherwise(F.col("id") % 100 + 1)))),
        "short_history": _with(base, historical_runs=history(spark, [(100, 100, 0.0, 1000.0)] * 3)),
    }
    stacked = stack_cases(cases)
    # Dimensions are shared by all pipelines.
    stacked["customers"] = spark.range(1, 101).select(F.col("id").alias("customer_id"))
    run = validate(stacked, run_date=GOLDEN_DATE)
    rows = {}
    for row in run.results.collect():
        rows.setdefault(row["pipeline"], {}).setdefault(row["check_id"], row)
    summary = {r["pipeline"]: r for r in summarize(run.results).collect()}
    return rows, summary


# case, check, status, observed value (None: not compared)
EXPECTED = [
    ("healthy", "B1", "PASS", 100), ("healthy", "B8", "PASS", 0), ("healthy", "S8", "PASS", 0),
    ("healthy", "S10", "PASS", 0), ("healthy", "S1", "WARN", 0), ("healthy", "B2", "FAIL", 100),
    ("healthy", "G1", "PASS", 0), ("healthy", "G6", "PASS", 0), ("healthy", "L2-REC-AGG", "PASS", 0),
    ("healthy", "L3-ANO-GOLD_R", "PASS", 1000), ("healthy", "G5", "WARN", 1000),
    ("short_bronze", "B1", "FAIL", 90), ("short_bronze", "L1-BRO-COMP-SRC", "FAIL", 90),
    ("one_duplicate", "B8", "WARN", 1), ("one_duplicate", "L1-BRO-UNIQ-PK", "FAIL", 1),
    ("one_duplicate", "L1-BRO-UNIQ-FULL", "WARN", 1), ("many_duplicates", "B8", "FAIL", 5),
    ("drop_5", "S1", "PASS", 5), ("drop_5", "S2", "PASS", 5), ("drop_28", "S1", "FAIL", 28),
    ("drop_28", "S2", "FAIL", 28), ("drop_28", "L3-ANO-SILVER", "SKIPPED", None),
    ("lost_24", "S8", "FAIL", 24), ("lost_24", "L2-REC-COUNT", "FAIL", 24), ("lost_24", "S10", "FAIL", 24),
    ("lost_24", "S9", "WARN", 24),
    ("lost_line", "S8", "FAIL", 1), ("lost_line", "S10", "FAIL", 1), ("lost_line", "L2-REC-COUNT", "PASS", 0),
    ("null_keys_match", "S8", "PASS", 0), ("null_keys_match", "L1-BRO-COMP-NULL", "FAIL", 2),
    ("null_keys_match", "S4", "PASS", 0),
    ("bad_signs", "S5", "FAIL", 2), ("bad_signs", "S6", "FAIL", 1), ("bad_signs", "S7", "FAIL", 1),
    ("bad_signs", "L1-SIL-VAL-QUAN", "FAIL", 2),
    ("negative_bronze", "B7", "WARN", 7), ("negative_bronze", "L1-BRO-VAL-UNIT", "FAIL", 5),
    ("gold_revenue", "G1", "FAIL", 2), ("gold_revenue", "G2", "PASS", 100),
    ("gold_orders", "G2", "FAIL", 999), ("gold_orders", "L2-REC-KEY", "FAIL", 899), ("gold_orders", "G4", "FAIL", 10),
    ("gold_null", "G1", "FAIL", 1000), ("gold_null", "L2-REC-REV", "FAIL", 1000),
    ("gold_null", "L2-REC-AGG", "SKIPPED", None), ("gold_null", "L3-ANO-GOLD_R", "SKIPPED", None),
    ("gold_null", "G4", "SKIPPED", None),
    ("low_revenue", "G5", "WARN", 950), ("low_revenue", "S1", "PASS", 5),
    ("country_gap", "G6", "FAIL", 1),
    ("unknown_silver", "L2-REC-KEY", "FAIL", 1), ("unknown_silver", "S9", "PASS", -1),
    ("future", "L1-BRO-TIME-FRESH", "FAIL", None), ("stale", "L1-BRO-TIME-FRESH", "WARN", None),
    ("wide_dates", "L1-BRO-TIME", "WARN", 730), ("bad_dates", "L1-BRO-VAL-DATE", "FAIL", 20),
    ("bad_dates", "L1-BRO-TIME-FRESH", "WARN", None), ("bad_dates", "L1-BRO-TIME", "WARN", None),
    ("orphan", "L1-SIL-CONS-FK-CUST", "FAIL", 1), ("healthy", "L1-SIL-CONS-FK-CUST", "PASS", 0),
    ("short_history", "L3-ANO-BRONZE", "SKIPPED", None),
]


@pytest.mark.parametrize("case, check, status, value", EXPECTED)
def test_outcome(found, case, check, status, value):
    row = found[0][case][check]
    assert row["status"] == status, row
    if value is not None:
        assert row["observed_value"] == pytest.approx(value)


def test_details_say_why(found):
    rows = found[0]
    assert "no baseline yet" in rows["short_history"]["L3-ANO-BRONZE"]["detail"]
    assert "future" in rows["future"]["L1-BRO-TIME-FRESH"]["detail"]
    assert "stale" in rows["stale"]["L1-BRO-TIME-FRESH"]["detail"]
    assert "constant baseline" in rows["lost_24"]["L3-ANO-SILVER"]["detail"]
    assert json.loads(rows["lost_24"]["S10"]["observed"]).startswith("unclear filter")
    assert json.loads(rows["lost_line"]["S10"]["observed"]).startswith("quantity > 20")


def test_summaries_are_per_pipeline(found):
    summary = found[1]
    assert summary["lost_24"]["first_failed_layer"] == "Source → Bronze"
    assert summary["lost_24"]["silver"] == "FAIL"
    assert summary["low_revenue"]["silver"] == "PASS"
    assert summary["healthy"]["silver"] == "WARN"


def test_a_pipeline_without_rows_in_a_table_is_still_judged(spark):
    base = healthy(spark, 10)
    layers = stack_cases({"full": base, "empty": {**base, "bronze_orders": orders(spark, 0)}})
    results = validate(layers, run_date=dt.date(2026, 7, 2)).results
    rows = {r["check_id"]: r for r in results.filter("pipeline = 'empty'").collect()}
    assert rows["B3"]["status"] == "FAIL"
    assert rows["S1"]["status"] == rows["S2"]["status"] == "FAIL" and "empty" in rows["S1"]["detail"]
    assert rows["L3-ANO-DROP_P"]["status"] == "SKIPPED"
    assert rows["L2-REC-KEY"]["observed_value"] == 10
