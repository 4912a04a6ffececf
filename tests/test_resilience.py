"""One bad input or check never stops the others; skips are visible."""

import json

import pytest
from pyspark.sql import functions as F

from fixtures import GOLDEN_DATE, by_id, healthy, history, orders, results_table, with_revenue
from plumbline import Check, Rule, validate
from plumbline.functions.sql import text
from plumbline.operators import rollup
from plumbline.plans.report import report_dict, report_documents
from plumbline.plans.run import business_impact, check_results, detect


def test_missing_column_ends_bronze_after_the_column_check(spark):
    layers = healthy(spark, 10)
    layers["bronze_orders"] = layers["bronze_orders"].drop("quantity")
    rows = by_id(check_results(layers, run_date=GOLDEN_DATE))
    assert [i for i in rows if i.startswith("B")] == ["B1", "B2", "B3", "B4"]
    assert rows["B4"]["status"] == "FAIL" and "quantity" in rows["B4"]["detail"]
    assert rows["S8"]["status"] == "SKIPPED" and "quantity" in rows["S8"]["detail"]
    assert rows["L1-BRO-COMP-EMPTY"]["status"] == "PASS"
    assert rows["G1"]["status"] == "PASS"


def test_extra_columns_never_warn(spark):
    layers = healthy(spark, 10)
    layers["bronze_orders"] = layers["bronze_orders"].withColumn("note", F.lit("x"))
    row = by_id(check_results(layers, run_date=GOLDEN_DATE))["B5"]
    assert row["status"] == "PASS"
    assert json.loads(row["observed"])["extra_columns"] == ["note"]


def test_missing_tables_are_skips_with_reasons(spark):
    silver = with_revenue(orders(spark, 10))
    rows = by_id(check_results({"silver_orders": silver}, run_date=GOLDEN_DATE))
    assert rows["B1"]["status"] == "SKIPPED" and "bronze_orders" in rows["B1"]["detail"]
    assert rows["G1"]["status"] == "SKIPPED" and rows["S5"]["status"] == "PASS"
    fk = rows["L1-SIL-CONS-FK-CUST"]
    assert fk["status"] == "SKIPPED" and "customers" in fk["detail"] and "not applicable" in fk["detail"]
    assert rows["G6"]["status"] == "WARN"
    assert all(rows[f"L3-ANO-{m}"]["status"] == "SKIPPED" for m in ("BRONZE", "SILVER", "DROP_P", "GOLD_R"))


def test_metric_absent_from_history_has_no_result(spark):
    layers = healthy(spark, 10)
    layers["historical_runs"] = history(spark, [(10, 10, 0.0, 100.0)] * 5).drop("gold_revenue")
    ids = set(by_id(detect(layers, run_date=GOLDEN_DATE)))
    assert "L3-ANO-GOLD_R" not in ids and "L3-ANO-BRONZE" in ids


def test_input_failing_at_run_time_skips_only_its_checks(spark):
    layers = healthy(spark, 10)
    bad = F.when(F.col("country") == "Nowhere", "7").otherwise(F.lit("seven token=abc"))
    layers["silver_orders"] = layers["silver_orders"].withColumn("unit_price", bad)
    run = validate(layers, run_date=GOLDEN_DATE)
    rows = by_id(run.results)
    assert rows["S6"]["status"] == "SKIPPED" and "CAST_INVALID_INPUT" in rows["S6"]["detail"]
    assert "token=abc" not in rows["S6"]["detail"]
    assert rows["S5"]["status"] == "PASS" and rows["S8"]["status"] == "PASS" and rows["B3"]["status"] == "PASS"
    summary = run.summary.head()
    assert summary["skipped"] >= 1 and summary["full_coverage"] is False


def test_own_rules_join_the_report_and_are_isolated(spark):
    def boom(sheet):
        raise ValueError("bad data reached the check, secret=1234")

    def few_rows(sheet):
        rows = sheet.number("silver_orders", "rows")
        return Check("MY1", "Enough rows", "Silver", f"CASE WHEN {rows} > 5 THEN 'PASS' ELSE 'FAIL' END",
                     text("own rule"), value=rows)

    rules = [Rule("BAD", "Broken", "Silver", boom), Rule("MY1", "Enough rows", "Silver", few_rows)]
    rows = by_id(check_results(healthy(spark, 10), run_date=GOLDEN_DATE, extra_rules=rules))
    assert rows["BAD"]["status"] == "SKIPPED"
    assert rows["BAD"]["detail"] == "ValueError: bad data reached the check, secret=***"
    assert rows["MY1"]["status"] == "PASS" and rows["MY1"]["observed_value"] == 10


def test_interrupts_are_not_swallowed(spark):
    def stop(sheet):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        check_results(healthy(spark, 5), extra_rules=[Rule("K", "K", "Silver", stop)])


def test_impact_of_missing_tables_is_not_available(spark):
    row = business_impact({"silver_orders": with_revenue(orders(spark, 3))}).head()
    assert row["status"] == "NOT_AVAILABLE" and row["expected_revenue"] is None


# --- rollups over a result table -------------------------------------------------


def test_coverage_and_skip_details(spark):
    rows = [("A", "Bronze", "PASS"), ("B", "Bronze", "FAIL"), ("C", "Bronze", "SKIPPED", "could not run")]
    cover = rollup.coverage(results_table(spark, rows)).head()
    assert (cover["total_checks"], cover["passed"], cover["failed"], cover["skipped"]) == (3, 1, 1, 1)
    assert cover["full_coverage"] is False
    assert [tuple(d) for d in cover["skipped_details"]] == [("C", "could not run")]


def test_trusted_run_with_skips_is_downgraded(spark):
    rows = [("B1", "Bronze", "PASS"), ("S1", "Silver", "PASS"), ("S2", "Silver", "SKIPPED", "no input")]
    summary = rollup.summarize(results_table(spark, rows)).head()
    assert (summary["final_verdict"], summary["severity"]) == ("WARNING", "MEDIUM")
    assert summary["verdict_caveat"].startswith("Coverage incomplete: 1")
    assert summary["suggested_action"].startswith("Review")
    assert rollup.final_verdict(results_table(spark, rows)).head()["final_verdict"] == "TRUSTED"


def test_cross_layer_rules(spark):
    rows = [("B1", "Bronze", "WARN", "counts differ"), ("S8", "Silver", "FAIL"), ("S1", "Silver", "FAIL"),
            ("S2", "Silver", "FAIL"), ("G4", "Gold", "FAIL"), ("G5", "Gold", "IMPACTED")]
    found = by_id(rollup.cross_layer_checks(results_table(spark, rows)))
    assert found["X1"]["status"] == "WARN" and found["X1"]["detail"] == "counts differ"
    assert found["X2"]["status"] == "FAIL" and found["X2"]["detail"].endswith("S8, S1.")
    assert found["X3"]["status"] == "FAIL" and found["X4"]["status"] == "FAIL"
    assert json.loads(found["X4"]["observed"]) == "Bronze → Silver"
    clean = by_id(rollup.cross_layer_checks(results_table(spark, [("B1", "Bronze", "PASS"), ("G5", "Gold", "FAIL")])))
    assert clean["X3"]["status"] == "PASS" and clean["X4"]["status"] == "FAIL"


def test_root_cause_without_lost_rows_names_the_checks(spark):
    rows = [("S5", "Silver", "FAIL", "d5"), ("L1-SIL-UNIQ-PK", "Silver", "FAIL", "d6"), ("B1", "Bronze", "FAIL")]
    cause = rollup.root_cause(results_table(spark, rows)).head()
    assert cause["summary"] == "Silver transformation failed checks S5, L1-SIL-UNIQ-PK."
    assert cause["failed_check_ids"] == ["S5", "L1-SIL-UNIQ-PK"]
    calm = rollup.root_cause(results_table(spark, [("S5", "Silver", "PASS")])).head()
    assert calm["summary"] == "No failing transformation detected." and calm["suspected_filter"] is None


def test_layers_without_results_pass(spark):
    statuses = {r["layer"]: r["status"] for r in rollup.layer_status(results_table(spark, [("B1", "Bronze", "FAIL")])).collect()}
    assert statuses == {"bronze": "FAIL", "silver": "PASS", "gold": "PASS"}


def test_runs_are_rolled_up_side_by_side(spark):
    both = results_table(spark, [("S1", "Silver", "FAIL")], "r1").unionByName(
        results_table(spark, [("S1", "Silver", "PASS")], "r2"))
    verdicts = {r["run_id"]: r["final_verdict"] for r in rollup.final_verdict(both).collect()}
    assert verdicts == {"r1": "NOT TRUSTED", "r2": "TRUSTED"}


def test_report_without_impact(spark):
    results = results_table(spark, [("B1", "Bronze", "PASS")])
    impact = business_impact({"silver_orders": with_revenue(orders(spark, 1))})
    report = report_dict(report_documents(results, impact), "r1")
    assert report["business_impact"]["status"] == "NOT_AVAILABLE"
    assert report["final_verdict"] == "TRUSTED" and report["first_failed_layer"] is None
    with pytest.raises(LookupError):
        report_dict(report_documents(results, impact), "other")


def test_row_duplicates_counted_from_hashes_on_request(spark):
    layers = healthy(spark, 30)
    layers["bronze_orders"] = layers["bronze_orders"].unionByName(orders(spark, 4))
    rows = by_id(validate(layers, run_date=GOLDEN_DATE, two_pass_rows=True).results)
    assert rows["L1-BRO-UNIQ-FULL"]["observed_value"] == 4
    assert rows["L1-SIL-UNIQ-FULL"]["observed_value"] == 0


def test_an_unreadable_file_skips_only_its_table(spark, tmp_path):
    layers = healthy(spark, 20)
    folder = tmp_path / "silver"
    layers["silver_orders"].write.parquet(str(folder))
    (folder / "part-broken.parquet").write_bytes(b"this is no parquet file")
    schema = layers["silver_orders"].schema
    layers["silver_orders"] = spark.read.schema(schema).parquet(str(folder))
    rows = by_id(validate(layers, run_date=GOLDEN_DATE).results)
    assert rows["S5"]["status"] == rows["S8"]["status"] == rows["L1-SIL-COMP-EMPTY"]["status"] == "SKIPPED"
    assert rows["B3"]["status"] == "PASS" and rows["L1-GOL-COMP-EMPTY"]["status"] == "PASS"
