"""Physical plans: no cross joins, narrow scans, aggregation before the shuffle."""

import re

import pytest

from fixtures import GOLDEN_DATE, healthy
from plumbline.operators import keys, profile
from plumbline.plans.metrics import collect_metrics
from plumbline.plans.run import detect
from plumbline.sources.layers import build_layers, land_layers
from plumbline.specs import PipelineSpec

SPEC = PipelineSpec()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    layers = healthy(spark, 200)
    layers["raw_orders"] = layers["bronze_orders"]
    return land_layers(layers, str(tmp_path_factory.mktemp("lake")))


def test_whole_metric_sheet_has_no_join_but_countries(landed):
    text = plan(collect_metrics(landed, SPEC).wide())
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    # Only the per-country totals are joined; everything else is aggregated.
    assert len(re.findall(r"SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin", text)) == 1


def test_identical_source_and_bronze_are_scanned_once_per_purpose(landed):
    sheet = collect_metrics(landed, SPEC)
    twins = {"raw_orders", "bronze_orders"}
    profiled, = twins & set(sheet.frames)
    rows, = {f"{t}_row" for t in twins} & set(sheet.frames)
    assert set(sheet.twins.values()) == {rows}
    assert not [name for name in sheet.frames if name.endswith("_pk")]
    assert plan(sheet.frames[profiled]).count("FileScan") == 1


def test_profile_reads_only_what_it_needs(landed):
    df = landed["silver_orders"]
    text = plan(profile.profile(df, profile.null_counts(df, ["quantity", "country"])))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"quantity", "country"}
    assert text.count("Exchange") == 1 and "partial_" in text


def test_census_is_two_key_shuffles_and_no_join(landed):
    text = plan(keys.key_census(landed["bronze_orders"], landed["silver_orders"], SPEC))
    assert "Join" not in text
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("FileScan") == 2
    # Map-side aggregation stands below each shuffle.
    assert text.count("partial_") >= 2


def test_valid_filter_reaches_the_scan(landed):
    text = plan(keys.lost_valid_rows(landed["bronze_orders"], landed["silver_orders"], SPEC))
    assert re.search(r"PushedFilters: \[.*GreaterThan\(quantity,0\)", text)
    assert "LeftAnti" in text and "NestedLoopJoin" not in text


def test_orphans_aggregate_before_the_anti_join(landed, spark):
    ref = spark.range(10).withColumnRenamed("id", "customer_id")
    text = plan(keys.fk_orphans(landed["silver_orders"], "customer_id", ref, "customer_id"))
    assert "LeftAnti" in text and "NestedLoopJoin" not in text


def test_metrics_of_all_tables_are_one_query(spark, landed):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-query", "metrics")
    try:
        collect_metrics(landed, SPEC).wide().collect()
        jobs = len(tracker.getJobIdsForGroup("one-query"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # AQE submits each shuffle stage as a job of its own; there is one action.
    assert 0 < jobs <= 40


def test_detection_alone_is_lazy(spark):
    spark.sparkContext.setJobGroup("lazy", "plan only")
    try:
        detect(build_layers(healthy(spark, 5)["bronze_orders"]), run_date=GOLDEN_DATE)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
