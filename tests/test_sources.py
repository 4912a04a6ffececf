"""CSV scans, landing, the result store and report lookups."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fixtures import GOLDEN_DATE, gate_tables, healthy, orders, results_table
from plumbline.operators import analytics
from plumbline.plans.report import report_documents
from plumbline.plans.run import business_impact, validate
from plumbline.sources import layers as etl
from plumbline.sources import results_store as store


def test_orders_csv_keeps_dates_as_text(spark, tmp_path):
    path = str(tmp_path / "raw.csv")
    orders(spark, 3, invoice_date="17/06/2026").write.option("header", True).csv(path)
    back = etl.read_orders_csv(spark, path)
    assert back.schema["invoice_date"].dataType.simpleString() == "string"
    assert back.count() == 3 and back.head()["invoice_date"] == "17/06/2026"


def test_corrupt_lines_are_kept_on_request(spark, tmp_path):
    file = tmp_path / "raw.csv"
    file.write_text(
        "invoice_no,stock_code,description,quantity,invoice_date,unit_price,customer_id,country\n"
        "I1,A,x,1,2026-06-17,2.5,7,UK\nI2,A,x,many,2026-06-17,2.5,7,UK\n")
    assert [r["quantity"] for r in etl.read_orders_csv(spark, str(file)).collect()] == [1, None]
    kept = etl.read_orders_csv(spark, str(file), keep_corrupt=True).cache()
    assert kept.filter(f"{etl.CORRUPT} IS NOT NULL").count() == 1
    kept.unpersist()


def test_missing_files(spark, tmp_path):
    assert etl.read_history_csv(spark, str(tmp_path / "none.csv")) is None
    with pytest.raises(AnalysisException):
        etl.read_orders_csv(spark, str(tmp_path / "none.csv")).count()
    with pytest.raises(AnalysisException):
        etl.read_gate_csvs(spark, str(tmp_path))


def test_history_and_gate_csvs(spark, tmp_path):
    for name, df in gate_tables(spark).items():
        df.limit(20).write.option("header", True).csv(str(tmp_path / f"{name}.csv"))
    tables = etl.read_gate_csvs(spark, str(tmp_path))
    assert set(tables) == set(etl.GATE_FILES)
    assert tables["bronze_orders"].schema == etl.GATE_ORDERS_SCHEMA
    assert tables["historical_runs"].count() == 15


def test_frames_become_layers(spark):
    layers = etl.layers_from_frames(
        spark, {"a": [(1, "x")], "b": spark.range(2)}, {"a": "id int, name string"})
    assert layers["a"].columns == ["id", "name"] and layers["b"].count() == 2


def test_layers_from_raw_orders(spark):
    raw = orders(spark, 10, quantity=F.when(F.col("id") == 1, 0).otherwise(F.col("id")))
    layers = etl.build_layers(raw, defect=F.col("quantity") <= 8)
    assert layers["bronze_orders"].sameSemantics(raw)
    assert layers["silver_orders"].count() == 7
    gold = layers["gold_metrics"].head()
    assert gold["total_orders"] == 7 and gold["total_revenue"] == 350.0 and gold["average_order_value"] == 50.0
    assert layers["gold_product_sales"].head()["total_quantity"] == 35


def test_gold_of_an_empty_silver(spark):
    gold = etl.build_gold_metrics(etl.build_silver(orders(spark, 0))).head()
    assert gold["total_revenue"] is None
    assert (gold["total_orders"], gold["total_customers"], gold["average_order_value"]) == (0, 0, 0.0)


def test_landing_writes_twins_once(spark, tmp_path):
    landed = etl.land_layers(etl.build_layers(orders(spark, 5)), str(tmp_path / "lake"))
    assert landed["raw_orders"] is landed["bronze_orders"]
    assert not (tmp_path / "lake" / "bronze_orders").exists()
    assert landed["silver_orders"].count() == 5


def test_store_round_trip(spark, tmp_path):
    path, reports = str(tmp_path / "results"), str(tmp_path / "reports")
    assert store.latest_report(spark, reports) is None and store.report_by_id(spark, reports, "x") is None
    impact = business_impact({"silver_orders": etl.build_silver(orders(spark, 1))})
    for day, run_id in enumerate(("r1", "r2", "r1"), start=1):
        results = results_table(spark, [("B1", "Bronze", "PASS"), ("S1", "Silver", "FAIL")], run_id)
        when = dt.datetime(2026, 7, day)
        store.write_results(results, path, when)
        store.write_report(report_documents(results, impact), reports, when)
    stored = store.read_store(spark, path)
    # The repeated run replaced its own rows only.
    assert stored.count() == 4
    newest = store.latest_report(spark, reports).collect()
    assert [r["run_id"] for r in newest] == ["r1"]
    assert json.loads(newest[0]["report"])["layer_status"]["silver"] == "FAIL"
    by_id = store.report_by_id(spark, reports, "r2")
    assert by_id.count() == 1 and store.report_by_id(spark, reports, "r9").count() == 0
    attempt = {r["attempt"] for r in store.published_runs(spark, reports).where("run_id = 'r2'").collect()}
    assert len(attempt) == 1 and all(attempt.pop() in f for f in by_id.inputFiles() if "/data/" in f)


def test_store_shows_only_what_is_published(spark, tmp_path):
    """A write that breaks, a file that is no Parquet, a run written again with fewer pipelines."""
    path = str(tmp_path / "store")
    rows = lambda n, *names: spark.createDataFrame([("2026-07-01", p, n) for p in names], "run_id string, pipeline string, n int")
    store.write_results(rows(1, "a", "b"), path)
    broken = store.stage(rows(2, "a", "b", "c"), path)
    assert [r["n"] for r in store.read_store(spark, path).collect()] == [1, 1]
    (tmp_path / "store" / "data" / "attempt=a-broken").mkdir()
    (tmp_path / "store" / "data" / "attempt=a-broken" / "part-0.parquet").write_bytes(b"no parquet")
    store.write_results(rows(3, "a").withColumn("more", F.lit("x")), path)
    assert [tuple(r)[:3] for r in store.read_store(spark, path).collect()] == [("2026-07-01", "a", 3)]
    runs = store.published_runs(spark, path)
    assert [(r["run_id"], r["pipeline"], r["rows"]) for r in runs.collect()] == [("2026-07-01", "a", 1)]
    assert runs.inputFiles() and all("/manifests/" in f for f in runs.inputFiles())
    store.publish(spark, path, broken)
    assert store.latest_report(spark, path).count() == 3
    assert store.report_by_id(spark, path, "other").columns == ["run_id", "pipeline", "n", "run_ts"]


def test_report_as_text(spark, tmp_path):
    run = validate(healthy(spark, 20), run_id="t", run_date=GOLDEN_DATE)
    store.write_report_text(run.report, str(tmp_path / "text"))
    lines = [x for f in Path(tmp_path / "text").glob("part-*") for x in f.read_text().splitlines()]
    assert len(lines) == 1 and json.loads(lines[0])["run_id"] == "t"


def test_report_questions(spark):
    rows = [
        ("S1", "Silver", "WARN", "w"), ("S1", "Silver", "FAIL", "again"), ("B1", "Bronze", "FAIL"),
        ("X4", "Cross-Layer", "FAIL"), ("G5", "Gold", "IMPACTED"), ("B2", "Bronze", "PASS"), ("B3", "Bronze", "SKIPPED"),
    ]
    results = results_table(spark, rows)
    failed = analytics.failed_checks(results).orderBy("position").collect()
    assert [(r["check_id"], r["status"]) for r in failed] == [
        ("B1", "FAIL"), ("S1", "WARN"), ("G5", "IMPACTED"), ("X4", "FAIL")]
    assert analytics.hard_failures(results).count() == 4
    assert [r["check_id"] for r in analytics.top_failures(results, 2).orderBy("rank").collect()] == ["B1", "S1"]
    evidence = {r["check_id"]: r["evidence_query"] for r in analytics.evidence_for_check(results).collect()}
    assert evidence["X4"] == ""
