"""One Spark query per operator, over the driver's tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.sql import (
    drop_percent,
    pass_or,
    percent,
)
from plumbline.functions.stats import (
    classify_robust_anomaly,
    column_stats,
    modified_z_score,
    robust_iqr_band,
    series_profile,
    tolerance_band,
    unpivot_history,
)
from plumbline.functions.values import as_date, redact
from plumbline.model import PIPELINE
from plumbline.operators import analytics, faults, gate, key_filter, keys, order_stats, profile, rollup
from plumbline.operators.gold import revenue_status
from plumbline.operators.isolation import isolate
from plumbline.operators.reconciliation import mismatched_fields
from plumbline.operators.rules import freshness_status, span_status
from plumbline.operators.silver import (
    learned_status,
    loss_status,
    segment_status,
    suspected_filter,
    window_status,
)
from plumbline.plans import report, run
from plumbline.plans.lineage import cut_lineage, new_folder
from plumbline.plans.metrics import HISTORY_METRICS, collect_metrics
from plumbline.plans.scenarios import Scenario, validate_scenarios
from plumbline.sources import csv_intake
from plumbline.sources import layers as etl
from plumbline.sources import results_store
from plumbline.specs import RangeRule
from workload import roles
from workload.roles import RUN_DATE, RUN_ID, SPEC, gate_tables, layers, results, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
BY = [PIPELINE]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _fold(*frames: DataFrame) -> DataFrame:
    """One row per pipeline from frames with different metrics."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.groupBy(*BY).agg(*[F.max(c).alias(c) for c in stacked.columns if c not in BY])


# --- layer transformations ----------------------------------------------------


@query
def build_silver(spark, sf):
    bronze = roles.lines(spark, sf)
    return etl.build_silver(etl.land_bronze(bronze), SPEC, defect=F.col("quantity") <= 40)


@query
def build_gold_metrics(spark, sf):
    gold = etl.build_gold_metrics(layers(spark, sf)["silver_orders"], SPEC)
    return _rounded(gold, 2, "total_revenue", "average_order_value")


@query
def build_gold_country(spark, sf):
    return _rounded(etl.build_gold_country(layers(spark, sf)["silver_orders"], SPEC), 2, "revenue")


@query
def build_gold_product(spark, sf):
    return _rounded(etl.build_gold_product(layers(spark, sf)["silver_orders"], SPEC), 2, "revenue")


# --- shared-scan profile ------------------------------------------------------


@query
def completeness_nulls(spark, sf):
    bronze = layers(spark, sf)["bronze_orders"]
    counts = profile.null_counts(bronze, SPEC.tables[1].mandatory)
    out = profile.profile(bronze, counts, BY)
    return out.withColumn("status", F.expr(pass_or(" + ".join(counts) + " = 0")))


@query
def range_violations(spark, sf):
    bronze = layers(spark, sf)["bronze_orders"]
    rules = (RangeRule("quantity", 0, strict_min=True), RangeRule("unit_price", 1000))
    metrics = profile.range_violations(bronze, rules)
    signs = profile.bronze_metrics(SPEC)
    for name in ("negative_quantity", "negative_price", "valid_rows", "explained"):
        metrics[name] = signs[name]
    return profile.profile(bronze, metrics, BY)


@query
def date_parse_validity(spark, sf):
    bronze = layers(spark, sf)["bronze_orders"]
    metrics = profile.date_metrics(bronze, ["invoice_date"])
    return profile.profile(bronze, {"unparsed": metrics["unparsed_invoice_date"]}, BY)


@query
def freshness(spark, sf):
    bronze = layers(spark, sf)["bronze_orders"]
    metrics = profile.date_metrics(bronze, ["invoice_date"])
    latest = profile.profile(bronze, {"max_date": metrics["max_invoice_date"]}, BY)
    today = f"DATE '{RUN_DATE}'"
    return latest.selectExpr(
        "*",
        f"{freshness_status('max_date', today, 0, 365)} AS year_status",
        f"{freshness_status('max_date', today, 0, 30)} AS month_status",
    )


@query
def timeliness(spark, sf):
    silver = layers(spark, sf)["silver_orders"]
    metrics = profile.date_metrics(silver, ["invoice_date"])
    ends = {"min_date": metrics["min_invoice_date"], "max_date": metrics["max_invoice_date"]}
    return profile.profile(silver, ends, BY).selectExpr(
        PIPELINE,
        "datediff(max_date, min_date) AS span_days",
        f"{span_status('min_date', 'max_date', 365)} AS status",
    )


@query
def empty_and_source_count(spark, sf):
    tables = layers(spark, sf)
    raw = profile.profile(tables["raw_orders"], {"source_rows": profile.ROWS}, BY)
    bronze = profile.profile(tables["silver_orders"], {"table_rows": profile.ROWS}, BY)
    return _fold(raw, bronze).selectExpr(
        "*",
        f"{pass_or('table_rows > 0')} AS empty_status",
        f"{pass_or('table_rows = source_rows')} AS source_status",
    )


# --- uniqueness ---------------------------------------------------------------


@query
def dup_business_key(spark, sf):
    tables = layers(spark, sf)
    bronze = keys.duplicate_excess(tables["bronze_orders"], SPEC.business_key, BY, "bronze_excess")
    silver = keys.duplicate_excess(tables["silver_orders"], SPEC.business_key, BY, "silver_excess")
    return _fold(bronze, silver)


@query
def dup_primary_key(spark, sf):
    """Copies of a line key within each return flag."""
    return keys.duplicate_excess(table(spark, sf, "lineitem"), ("l_orderkey", "l_linenumber"), ["l_returnflag"])


@query
def dup_full_row(spark, sf):
    return keys.full_row_duplicates(layers(spark, sf)["bronze_orders"], BY)


@query
def dup_full_row_two_pass(spark, sf):
    return keys.full_row_duplicates_two_pass(layers(spark, sf)["bronze_orders"], BY)


@query
def dup_distinct_keys(spark, sf):
    """Line keys that occur more than once within a return flag."""
    return keys.duplicated_keys(table(spark, sf, "lineitem"), ("l_orderkey", "l_linenumber"), ["l_returnflag"])


# --- loss between layers ------------------------------------------------------


@query
def drop_pct_band(spark, sf):
    tables = layers(spark, sf)
    counts = _fold(
        profile.profile(tables["bronze_orders"], {"bronze": profile.ROWS}, BY),
        profile.profile(tables["silver_orders"], {"silver": profile.ROWS}, BY),
        column_stats(unpivot_history(tables["historical_runs"], ["drop_pct"], BY), [*BY, "metric"])
        .select(PIPELINE, "mean", "std"),
    )
    drop = counts.withColumn("drop_pct", F.expr(drop_percent("bronze", "silver")))
    return drop.selectExpr(
        PIPELINE,
        "bronze",
        "silver",
        "round(drop_pct, 4) AS drop_pct",
        f"{learned_status('drop_pct', 'mean', 'std', SPEC)} AS learned_status",
        f"{window_status('drop_pct', SPEC)} AS window_status",
    )


def _census(spark, sf):
    tables = layers(spark, sf)
    return keys.key_census(tables["bronze_orders"], tables["silver_orders"], SPEC, BY)


@query
def key_census(spark, sf):
    return _census(spark, sf)


@query
def valid_rows_lost(spark, sf):
    """The lost rows themselves, through the null-safe anti join."""
    tables = layers(spark, sf)
    lost = keys.lost_valid_rows(tables["bronze_orders"], tables["silver_orders"], SPEC, BY)
    return lost.select(PIPELINE, "invoice_no", "stock_code", "customer_id", "invoice_date", "quantity")


@query
def valid_rows_lost_counted(spark, sf):
    """The same rows, by counted keys and a filter of the lost ones."""
    tables = layers(spark, sf)
    lost = keys.lost_valid_rows_counted(tables["bronze_orders"], tables["silver_orders"], SPEC, BY)
    return lost.select(PIPELINE, "invoice_no", "stock_code", "customer_id", "invoice_date", "quantity")


@query
def valid_loss_status(spark, sf):
    tables = layers(spark, sf)
    valid = {"valid_rows": profile.bronze_metrics(SPEC)["valid_rows"]}
    both = _fold(
        profile.profile(tables["bronze_orders"], valid, BY), _census(spark, sf).select(PIPELINE, "lost_rows")
    )
    return both.selectExpr(
        "*",
        f"round({percent('lost_rows', 'valid_rows')}, 2) AS loss_pct",
        f"{loss_status('lost_rows', 'valid_rows', SPEC)} AS status",
    )


@query
def segment_loss(spark, sf):
    tables = layers(spark, sf)
    segment = F.when(F.col("quantity") > 40, "quantity > 40").otherwise("quantity <= 40")
    loss = keys.segment_loss(tables["bronze_orders"], tables["silver_orders"], segment, SPEC, BY)
    return loss.withColumn("status", F.expr(segment_status("loss_pct", SPEC)))


@query
def wrong_filter(spark, sf):
    return _census(spark, sf).selectExpr(
        PIPELINE,
        "lost_rows",
        "lost_min_quantity",
        "lost_max_quantity",
        f"{suspected_filter('lost_min_quantity', SPEC)} AS suspected_filter",
    )


@query
def unexplained_loss(spark, sf):
    tables = layers(spark, sf)
    counted = profile.bronze_metrics(SPEC)
    wanted = {"bronze_total": profile.ROWS, "bronze_valid": counted["valid_rows"], "explained": counted["explained"]}
    return _fold(
        profile.profile(tables["bronze_orders"], wanted, BY),
        profile.profile(tables["silver_orders"], {"silver_count": profile.ROWS}, BY),
        _census(spark, sf).select(PIPELINE, F.col("lost_document_rows").alias("unexplained")),
    )


@query
def key_set(spark, sf):
    gold = layers(spark, sf)["gold_metrics"].select(PIPELINE, "total_orders")
    census = _census(spark, sf).select(PIPELINE, "silver_rows_unknown", "silver_documents")
    return _fold(census, gold).selectExpr(
        "*",
        "greatest(0L, total_orders - silver_documents) AS gold_excess",
        f"{pass_or('silver_rows_unknown + greatest(0L, total_orders - silver_documents) = 0')} AS status",
    )


@query
def fk_orphans(spark, sf):
    tables = layers(spark, sf)
    return keys.fk_orphans(tables["silver_orders"], "customer_id", tables["customers"], "customer_id", BY)


@query
def fk_orphans_filtered(spark, sf):
    """Lines whose part is none of the large ones, by return flag: most references match nothing."""
    lines, parts = roles.table(spark, sf, "lineitem"), roles.table(spark, sf, "part")
    large = parts.where("p_size > 40").select("p_partkey")
    return keys.fk_orphans_filtered(lines, "l_partkey", large, "p_partkey", ["l_returnflag"])


# --- reconciliation -----------------------------------------------------------


def _fresh_gold(spark, sf):
    fresh = etl.build_gold_metrics(layers(spark, sf)["silver_orders"], SPEC)
    return fresh.selectExpr(
        PIPELINE, "total_revenue AS revenue", "total_orders AS orders", "total_customers AS customers"
    )


@query
def gold_reconcile(spark, sf):
    gold = layers(spark, sf)["gold_metrics"]
    both = _fold(_fresh_gold(spark, sf), gold)
    stored = ("total_revenue", "total_orders", "total_customers")
    wrong = mismatched_fields("revenue", "orders", "customers", stored, SPEC.thresholds.revenue_tolerance)
    value = "CASE WHEN total_orders = 0 THEN 0D ELSE total_revenue / total_orders END"
    return both.selectExpr(
        PIPELINE,
        "round(revenue, 2) AS silver_revenue",
        "round(total_revenue, 2) AS gold_revenue",
        f"{pass_or('abs(revenue - total_revenue) <= 1.0D')} AS revenue_status",
        f"{pass_or('orders = total_orders')} AS order_status",
        f"{pass_or('customers = total_customers')} AS customer_status",
        f"{pass_or(f'abs({value} - average_order_value) <= 0.01D')} AS order_value_status",
        f"array_join({wrong}, ',') AS mismatched",
    )


@query
def country_reconcile(spark, sf):
    tables = layers(spark, sf)
    return keys.country_mismatches(tables["gold_country_revenue"], tables["silver_orders"], SPEC, BY)


@query
def revenue_vs_baseline(spark, sf):
    tables = layers(spark, sf)
    series = unpivot_history(tables["historical_runs"], ["gold_revenue"], BY)
    both = _fold(
        _fresh_gold(spark, sf).select(PIPELINE, "revenue"),
        tables["gold_metrics"].select(PIPELINE, "total_revenue"),
        column_stats(series, [*BY, "metric"]).select(PIPELINE, "mean", "std"),
    )
    gap = "abs(revenue - total_revenue)"
    upstream = "CASE WHEN pipeline = '3-MEDIUM' THEN 'PASS' ELSE 'FAIL' END"
    return both.selectExpr(
        PIPELINE,
        "round(total_revenue, 2) AS gold_revenue",
        "round(mean, 2) AS expected_revenue",
        f"{revenue_status('total_revenue', gap, 'mean', 'std', upstream, SPEC)} AS status",
        f"{revenue_status('total_revenue * 0.2D', '0D', 'mean', 'std', upstream, SPEC)} AS low_status",
    )


@query
def business_impact(spark, sf):
    return run.business_impact(layers(spark, sf), SPEC)


# --- run history --------------------------------------------------------------


def _monthly(spark, sf):
    """Monthly metrics per country; the newest month is the current run.

    Rows whose date is none are a series of their own for each country, with one point.
    """
    tables = layers(spark, sf)
    month = F.substring("invoice_date", 1, 7).alias("month")
    dated = as_date("invoice_date", tables["bronze_orders"].schema["invoice_date"].dataType)
    series = F.expr(f"CASE WHEN {dated} IS NULL THEN concat(country, '/undated') ELSE country END AS country")
    bronze = tables["bronze_orders"].select(series, month, F.lit(1).alias("b"), F.lit(0).alias("s"),
                                            F.lit(0.0).alias("r"))
    silver = tables["silver_orders"].select(series, month, F.lit(0).alias("b"), F.lit(1).alias("s"),
                                            F.col("net_revenue").alias("r"))
    return (
        bronze.unionByName(silver)
        .groupBy("country", "month")
        .agg(F.sum("b").alias("b"), F.sum("s").alias("s"), F.sum("r").alias("r"))
        .selectExpr(
            "country", "month", "b AS bronze_count", "s AS silver_count",
            "round((1D - s / b) * 100, 3) AS drop_pct", "round(r, 2) AS gold_revenue",
        )
    )


def _series(spark, sf):
    return unpivot_history(_monthly(spark, sf), HISTORY_METRICS, ["country", "month"])


@query
def history_stats(spark, sf):
    stats = column_stats(_series(spark, sf), ["country", "metric"])
    low, high = tolerance_band("mean", "std", 3.0)
    return stats.selectExpr(
        "country", "metric", "n", "round(mean, 4) AS mean", "round(std, 4) AS std",
        f"round({low}, 3) AS lower", f"round({high}, 3) AS upper",
    )


@query
def robust_band(spark, sf):
    stats = series_profile(_series(spark, sf), ["country", "metric"])
    iqr, low, high = robust_iqr_band("q1", "q3")
    return stats.selectExpr(
        "country", "metric", "round(q1, 6) AS q1", "round(median, 6) AS median", "round(q3, 6) AS q3",
        f"round({iqr}, 6) AS iqr", f"round({low}, 6) AS lower", f"round({high}, 6) AS upper",
    )


def _scored(spark, sf):
    """The last month of each country against the months before it."""
    series = _series(spark, sf)
    ranked = series.withColumn("last", F.expr("max(month) OVER (PARTITION BY country, metric)"))
    past = ranked.filter("month < last")
    current = ranked.filter("month = last").select("country", "metric", F.col("x").alias("value"))
    return series_profile(past, ["country", "metric"]).join(current, ["country", "metric"])


@query
def modified_z(spark, sf):
    z = modified_z_score("value", "median", "mad")
    return _scored(spark, sf).selectExpr(
        "country", "metric", "round(value, 3) AS value", "round(mad, 4) AS mad", f"round({z}, 2) AS z"
    )


@query
def anomaly_status(spark, sf):
    status = classify_robust_anomaly("value", "n", "q1", "median", "q3", "mad")
    return _scored(spark, sf).selectExpr("country", "metric", "n", f"{status} AS status")


# --- results of a whole run and questions asked of them -------------------------


@query
def check_results(spark, sf):
    found = run.validate(layers(spark, sf), SPEC, run_id=RUN_ID, run_date=RUN_DATE, two_pass_rows=True).results
    return found.selectExpr(
        PIPELINE, "run_id", "seq", "check_id", "check_name", "layer", "status",
        "round(observed_value, 2) AS observed_value", "dimension", "detection_layer", "table_name",
    )


@query
def detection_stack(spark, sf):
    """Rules, reconciliation and anomaly detection for the tables at hand."""
    rows = results(spark, sf).filter("detection_layer IS NOT NULL")
    return rows.groupBy(PIPELINE, "detection_layer", F.col("detected_status").alias("status")).agg(
        F.count(F.lit(1)).alias("checks")
    )


@query
def cross_layer_checks(spark, sf):
    rows = rollup.cross_layer_checks(results(spark, sf).filter("layer <> 'Cross-Layer'"))
    return rows.select(PIPELINE, "run_id", "check_id", "status", "observed")


@query
def layer_status(spark, sf):
    return rollup.layer_status(results(spark, sf))


@query
def final_verdict(spark, sf):
    return rollup.final_verdict(results(spark, sf))


@query
def first_failed_layer(spark, sf):
    return rollup.first_failed_layer(results(spark, sf)).select(PIPELINE, "run_id", "first_failed_layer")


@query
def downstream_impact(spark, sf):
    rows = results(spark, sf).filter("layer = 'Gold' AND detection_layer = 'layer_3_robust_anomaly'")
    return rows.selectExpr(
        PIPELINE, "check_id", "detected_status", "status", "coalesce(extra['upstream_adjusted'], 'false') AS adjusted"
    )


@query
def coverage(spark, sf):
    return rollup.coverage(results(spark, sf)).drop("skipped_details")


@query
def root_cause(spark, sf):
    return rollup.root_cause(results(spark, sf)).selectExpr(
        PIPELINE, "run_id", "summary", "array_join(failed_check_ids, ',') AS failed_check_ids",
        "suspected_filter", "size(evidence) AS evidence_rows",
    )


@query
def run_summary(spark, sf):
    """Verdict after the coverage downgrade, and the suggested action."""
    return rollup.summarize(results(spark, sf)).select(
        PIPELINE, "final_verdict", "severity", "verdict_caveat", "first_failed_layer", "suggested_action"
    )


@query
def report_document(spark, sf):
    """Figures read back out of the assembled JSON report."""
    impact = run.business_impact(layers(spark, sf), SPEC)
    docs = report.report_documents(results(spark, sf), impact)
    parsed = docs.withColumn("doc", F.parse_json("report"))
    paths = {
        "verdict": ("$.final_verdict", "string"),
        "silver": ("$.layer_status.silver", "string"),
        "failed": ("$.coverage.failed", "long"),
        "lost": ("$.checks.silver[7].observed", "long"),
        "expected_revenue": ("$.business_impact.expected_revenue", "double"),
    }
    return parsed.select(
        PIPELINE, *[F.variant_get("doc", path, kind).alias(name) for name, (path, kind) in paths.items()]
    )


@query
def failed_checks(spark, sf):
    return analytics.failed_checks(results(spark, sf)).select(PIPELINE, "run_id", "check_id", "layer", "status")


@query
def hard_failures(spark, sf):
    return analytics.hard_failures(results(spark, sf)).select(PIPELINE, "run_id", "check_id", "layer", "status")


@query
def top_failures(spark, sf):
    return analytics.top_failures(results(spark, sf)).select(PIPELINE, "run_id", "rank", "check_id", "status")


@query
def caught_by(spark, sf):
    labelled = analytics.with_caught_by(results(spark, sf))
    return labelled.groupBy(PIPELINE, "caught_by").agg(F.count(F.lit(1)).alias("checks"))


@query
def evidence_for_check(spark, sf):
    found = analytics.evidence_for_check(results(spark, sf))
    return found.selectExpr(PIPELINE, "check_id", "evidence_query <> '' AS has_sql")


@query
def layer_metrics(spark, sf):
    return _rounded(analytics.layer_metrics(results(spark, sf)), 4, "drop_pct")


@query
def layer_metrics_fallback(spark, sf):
    """The same figures where the order count of Gold has no check of its own."""
    without = results(spark, sf).where("check_id <> 'G2'")
    return _rounded(analytics.layer_metrics(without), 4, "drop_pct")


@query
def flagged_checks(spark, sf):
    rows = analytics.flagged_checks(
        results(spark, sf), detection_layer="layer_1_rules", dimension="validity", check_id_prefix="L1-SIL"
    )
    return rows.select(PIPELINE, "check_id", "detected_status")


def _stored_runs(spark, sf):
    """A result store of many runs: one gate row per pipeline and month."""
    past = gate_tables(spark, sf)["historical_runs"]
    return past.withColumn("run_ts", F.to_timestamp_ntz(F.concat("run_id", F.lit("-01"))))


_stores: dict[tuple[str, str], str] = {}


def _store(spark, sf):
    """A store of the months as runs: two writes, a run written again, and a write that broke half-way."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stores:
        path = new_folder(spark, "store")
        months = _stored_runs(spark, sf).drop("run_ts")
        early = F.col("run_id") < "1997"
        results_store.write_report(months.where(early), path, dt.datetime(2001, 1, 1))
        results_store.write_report(months.where(~early), path, dt.datetime(2001, 1, 2))
        again = months.where("run_id = '1995-06'").withColumn("silver_count", F.col("silver_count") + 1)
        results_store.write_report(again, path, dt.datetime(2001, 1, 1))
        results_store.stage(months.withColumn("bronze_count", F.lit(-1).cast("long")), path, dt.datetime(2001, 1, 3))
        _stores[key] = path
    return _stores[key]


@query
def latest_report(spark, sf):
    return results_store.latest_report(spark, _store(spark, sf)).drop("run_ts")


@query
def report_by_id(spark, sf):
    """A run that was written twice; a run that is unknown adds nothing."""
    path = _store(spark, sf)
    found = results_store.report_by_id(spark, path, "1995-06")
    return found.unionByName(results_store.report_by_id(spark, path, "1995-99")).drop("run_ts")


@query
def stored_runs(spark, sf):
    """What the manifests say of the published runs."""
    return results_store.published_runs(spark, _store(spark, sf)).select(
        PIPELINE, "run_id", F.col("rows").alias("stored_rows"), F.date_format("run_ts", "yyyy-MM-dd").alias("stamped")
    )


@query
def stored_results(spark, sf):
    """All published rows, summed by year."""
    year = F.left("run_id", F.lit(4)).alias("year")
    return results_store.read_store(spark, _store(spark, sf)).groupBy(PIPELINE, year).agg(
        F.sum("bronze_count").alias("bronze_count"), F.sum("silver_count").alias("silver_count")
    )


# --- sources ----------------------------------------------------------------------


def _csv(df, path):
    """All values as text, as a file with a header."""
    df.selectExpr(*[f"CAST({c} AS STRING) AS {c}" for c in df.columns]).write.option("header", True).option("escape", '"').csv(path)


_orders_csv: dict[tuple[str, str], csv_intake.Intake] = {}


def _intake(spark, sf):
    """Order lines as CSV files: sound ones, short ones, long ones, some with text for a number."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _orders_csv:
        folder = new_folder(spark, "csv")
        # The orders are stored once for the three files; each line is shuffled for one of them.
        wanted = roles.ordered(spark, sf).select("o_orderkey", "o_custkey", "n_name")
        orders = etl.land_layers({"ordered": wanted}, new_folder(spark, "csv-orders"))["ordered"]
        rows = table(spark, sf, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey")).selectExpr(
            "l_orderkey AS invoice_no", "l_partkey AS stock_code",
            "CASE WHEN l_partkey % 20 = 3 THEN concat('a \"quoted\", name ', l_linenumber) ELSE n_name END AS description",
            "CASE WHEN l_partkey % 20 = 2 THEN 'many' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS quantity",
            "CAST(l_shipdate AS DATE) AS invoice_date", "l_extendedprice AS unit_price",
            "CASE WHEN l_partkey % 40 = 2 THEN 'nobody' ELSE CAST(o_custkey AS STRING) END AS customer_id",
            "n_name AS country", "l_partkey % 20 AS part",
        )
        _csv(rows.where("part > 1").drop("part"), f"{folder}/sound")
        _csv(rows.where("part = 0").drop("part", "customer_id", "country"), f"{folder}/short")
        _csv(rows.where("part = 1").withColumn("more", F.lit("x")), f"{folder}/long")
        _orders_csv[key] = csv_intake.intake_orders(spark, f"{folder}/*")
    return _orders_csv[key]


@query
def read_csv_quarantine(spark, sf):
    """Good lines and, by reason, bad ones; every line of the files is one of them."""
    found = _intake(spark, sf)
    good = found.rows.agg(
        F.lit("good").alias("reason"), F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("quantity"),
        F.count_if(F.col("description").contains('"quoted", ')).alias("quoted"),
    )
    bad = found.quarantine.groupBy("reason").agg(
        F.count(F.lit(1)).alias("lines"), F.lit(None).cast("long").alias("quantity"), F.lit(0).cast("long").alias("quoted")
    )
    return good.unionByName(bad)


@query
def quarantine_checks(spark, sf):
    """What quarantine holds is what Bronze lacks: B1 and the count rule say so."""
    found = _intake(spark, sf)
    both = {"raw_orders": found.source, "bronze_orders": found.rows}
    checks = run.check_results(both, run_date=RUN_DATE, sheet=collect_metrics(both, SPEC, two_pass_rows=True))
    lines = csv_intake.quarantine_counts({"raw_orders": found}).drop("table_name")
    picked = checks.where("check_id = 'B1'").select("check_id", "status", F.get_json_object("observed", "$").alias("observed"))
    return picked.join(lines, F.lit(True)).select("check_id", "status", "lines", "bad_lines")


@query
def read_gate_files(spark, sf):
    """The release gate from CSV files, in which every tenth order has no number for its amount."""
    tables = gate_tables(spark, sf)
    folder = new_folder(spark, "gate-csv")
    for name in ("bronze_orders", "silver_orders_correct", "silver_orders_buggy"):
        amount = "CASE WHEN order_id % 10 = 0 THEN 'n/a' ELSE CAST(CAST(net_amount AS BIGINT) AS STRING) END AS net_amount"
        _csv(tables[name].selectExpr("order_id", "customer_id", "status", "has_discount", amount, "order_date"), f"{folder}/{name}.csv")
    past = tables["historical_runs"].selectExpr("concat(pipeline, run_id) AS run_id", "bronze_count", "silver_count", "0.5D AS drop_pct")
    _csv(past, f"{folder}/historical_runs.csv")
    return csv_intake.quarantine_counts(csv_intake.intake_gate(spark, folder))


@query
def frames_as_layers(spark, sf):
    """Tables given as a DataFrame, a pandas frame and a list of rows are layers like any other."""
    region = table(spark, sf, "region")
    found = etl.layers_from_frames(
        spark,
        {"nation": table(spark, sf, "nation"), "region": region.toPandas(), "codes": [tuple(r) for r in region.select("r_regionkey").collect()]},
        {"codes": "code int"},
    )
    unknown = keys.fk_orphans(found["nation"], "n_regionkey", found["region"].where("r_regionkey > 0"), "r_regionkey")
    return unknown.join(found["codes"].agg(F.sum("code").alias("codes")), F.lit(True))


@query
def bronze_stop(spark, sf):
    """Bronze without a required column: its checks end there, whatever else is wrong."""
    raw = layers(spark, sf)["raw_orders"]
    both = {"raw_orders": raw, "bronze_orders": raw.where("stock_code % 2 = 0").drop("quantity")}
    found = run.check_results(both, SPEC, run_date=RUN_DATE)
    return found.where("check_id RLIKE '^B[0-9]+$' AND check_id <> 'B2'").select(PIPELINE, "check_id", "status")


# --- long series --------------------------------------------------------------------


@query
def order_statistics(spark, sf):
    """Exact quartiles and MAD of the prices per return flag, each series dealt out in pieces."""
    found = order_stats.robust_profile(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return _rounded(found, 6, "q1", "median", "q3", "mad")


# --- outcomes ---------------------------------------------------------------------

_OUTCOMES = {
    "healthy": "'PASS'",
    "skips": "CASE WHEN check_id = 'S9' THEN 'SKIPPED' ELSE 'PASS' END",
    "ingestion": "CASE WHEN layer = 'Bronze' THEN status ELSE 'PASS' END",
    "warned": "CASE WHEN status = 'FAIL' THEN 'WARN' ELSE status END",
    "loss": "CASE WHEN layer = 'Bronze' THEN 'PASS' WHEN layer = 'Gold' AND status = 'FAIL' THEN 'IMPACTED' ELSE status END",
    "metrics": "CASE WHEN layer = 'Gold' THEN status ELSE 'PASS' END",
}


@query
def verdict_outcomes(spark, sf):
    """The results of every pipeline as if other layers had failed: every verdict, blame and action."""
    core = results(spark, sf).where("layer <> 'Cross-Layer'")
    told = [F.struct(F.lit(v).alias("v"), F.expr(sql).alias("s")) for v, sql in _OUTCOMES.items()]
    versions = core.withColumn("_o", F.explode(F.array(*told)))
    changed = versions.withColumns(
        {PIPELINE: F.concat(PIPELINE, F.lit("/"), "_o.v"), "status": F.col("_o.s"), "detected_status": F.col("_o.s")}
    )
    return rollup.summarize(changed.drop("_o")).select(
        PIPELINE, "bronze", "silver", "gold", "final_verdict", "severity", "verdict_caveat", "first_failed_layer",
        "suggested_action", "skipped",
    )


# --- isolation ------------------------------------------------------------------

_METRICS = {
    "rows": "count(1)",
    "quantity": "sum(l_quantity)",
    "parts": "CAST(max(l_partkey) AS DOUBLE)",
    "flag": "sum(CAST(l_returnflag AS DOUBLE))",
    "discount": "max(l_discount)",
    "lines": "CAST(sum(l_linenumber) AS DOUBLE)",
    "inverse": "sum(1 / (l_linenumber - 1))",
}


@query
def isolated_metrics(spark, sf):
    """Two of the metrics fail on some rows; halving keeps the values of all others."""
    found = isolate(
        _METRICS, lambda part: cut_lineage(profile.profile(table(spark, sf, "lineitem"), part)), "rows"
    )
    values = _fold_wide(found.results)
    listed = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in _METRICS if m in values.columns]
    failed = [F.struct(F.lit(m).alias("metric"), F.lit(None).cast("double").alias("value")) for m in found.failures]
    return values.select(F.inline(F.array(*listed, *failed)))


def _fold_wide(frames):
    """One-row frames side by side."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@query
def gold_reconcile_rows(spark, sf):
    """Pipelines whose Gold holds a second row fail every reconciliation; the others pass."""
    silver = layers(spark, sf)["silver_orders"]
    gold = etl.build_gold_metrics(silver, SPEC)
    second = gold.where("total_orders % 2 = 1").withColumns({"total_revenue": F.lit(0.5), "total_orders": F.lit(1).cast("long")})
    folder = new_folder(spark, "gold-rows")
    landed = etl.land_layers({"gold_metrics": gold.unionByName(second)}, folder)
    found = run.check_results({"silver_orders": silver, **landed}, SPEC, run_date=RUN_DATE)
    reconciled = F.col("check_id").rlike("^(G[1-4]$|L2-REC-(REV|AGG))")
    return found.where(reconciled).groupBy(PIPELINE).agg(
        F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed")
    )


# --- fault injection ----------------------------------------------------------

ROW_KEY = ("invoice_no", "stock_code", "customer_id", "invoice_date", "quantity")


def _clean(spark, sf):
    """Healthy layers of one pipeline: unique documents, complete Silver.

    Only lines whose document number repeats are grouped, to keep the least of their rows; a filter of
    those numbers tells them from the others, which stay where the join left them.
    """
    number = "l_orderkey * 10 + l_linenumber AS invoice_no"
    # The least customer of an order comes with its least rows, as the columns of a line sort before it.
    orders = roles.ordered(spark, sf).groupBy("o_orderkey").agg(F.min(F.struct("o_custkey", "n_name")).alias("o"))
    bronze = table(spark, sf, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey")).selectExpr(
        number,
        "l_partkey AS stock_code",
        "concat(l_returnflag, '-', l_linestatus) AS description",
        "CAST(l_quantity AS BIGINT) AS quantity",
        "CAST(CAST(l_shipdate AS DATE) AS STRING) AS invoice_date",
        "floor(l_extendedprice * 100D / l_quantity) / 100D AS unit_price",
        "o.o_custkey AS customer_id",
        "o.n_name AS country",
    )
    numbers = keys.key_counts(table(spark, sf, "lineitem").selectExpr(number), ["invoice_no"])
    repeated = key_filter.key_filter(numbers.where("copies > 1"), ["invoice_no"])
    marked = key_filter.with_membership(bronze, repeated, ["invoice_no"])
    rest = [c for c in bronze.columns if c != "invoice_no"]
    least = marked.where("_maybe").groupBy("invoice_no").agg(F.min(F.struct(*rest)).alias("row"))
    return marked.where("NOT _maybe").drop("_maybe").unionByName(least.select("invoice_no", "row.*"))


_healthy: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _healthy_layers(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _healthy:
        folder = new_folder(spark, "healthy")
        bronze = etl.land_layers({"bronze_orders": _clean(spark, sf)}, folder)["bronze_orders"]
        _healthy[key] = {"bronze_orders": bronze, "silver_orders": etl.build_silver(bronze, SPEC)}
    return _healthy[key]


def _healthy_silver(spark, sf):
    """Silver of the healthy layers, stored once per session and data set."""
    healthy = _healthy_layers(spark, sf)
    if "landed" not in healthy:
        folder = new_folder(spark, "healthy-silver")
        healthy["landed"] = etl.land_layers({"silver_orders": healthy["silver_orders"]}, folder)["silver_orders"]
    return healthy["landed"]


def _silver_sums(df):
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("invoice_no").alias("documents"),
        F.sum("quantity").alias("quantity"),
        F.round(F.sum("net_revenue"), 2).alias("revenue"),
    )


@query
def inject_row_drop(spark, sf):
    """Exactly a quarter of the rows is gone, and nothing else has changed."""
    silver = _healthy_layers(spark, sf)["silver_orders"]
    kept = faults.inject_row_drop(silver, 0.25)
    tagged = silver.select("invoice_no", F.lit(0).alias("k")).unionByName(
        kept.select("invoice_no", F.lit(1).alias("k"))
    )
    per_row = tagged.groupBy("invoice_no").agg(F.sum("k").alias("kept"), F.count(F.lit(1)).alias("n"))
    return per_row.agg(
        F.sum("kept").alias("kept_rows"),
        F.sum(F.col("n") - F.col("kept")).alias("all_rows"),
        F.count_if(F.col("kept") > F.col("n") - F.col("kept")).alias("foreign_rows"),
    )


@query
def inject_duplicates(spark, sf):
    silver = _healthy_layers(spark, sf)["silver_orders"]
    return _silver_sums(faults.inject_duplicates(silver, ["invoice_no"], 10))


@query
def inject_orphans(spark, sf):
    bronze = _healthy_layers(spark, sf)["bronze_orders"]
    payments = faults.inject_orphans(None, bronze, key="-1")
    paid = bronze.selectExpr("concat('PAY', invoice_no) AS payment_id", "invoice_no", "unit_price AS amount")
    return keys.fk_orphans(paid.unionByName(payments), "invoice_no", bronze, "invoice_no")


@query
def inject_price_inflation(spark, sf):
    return _silver_sums(faults.inject_price_inflation(_healthy_layers(spark, sf)["silver_orders"], 2.0))


@query
def inject_scale_quantity(spark, sf):
    return _silver_sums(faults.inject_scale_quantity(_healthy_layers(spark, sf)["silver_orders"], 1.5))


@query
def inject_null_keys(spark, sf):
    silver = _healthy_layers(spark, sf)["silver_orders"]
    return _silver_sums(faults.inject_null_keys(silver, ["invoice_no"], 5))


@query
def detection_matrix(spark, sf):
    """All faults validated together, as changes of one healthy Silver: who noticed which."""
    bronze = _healthy_layers(spark, sf)["bronze_orders"]
    # Landed once: choosing rows and every branch of the validation read the stored table.
    silver = _healthy_silver(spark, sf)
    paid = bronze.selectExpr("concat('PAY', invoice_no) AS payment_id", "invoice_no", "unit_price AS amount")
    first = ["invoice_no"]
    changes = {
        "healthy": faults.Change(),
        "row_drop": faults.row_drop_change(silver, 0.3),
        "duplicates": faults.duplicates_change(silver, first, 10),
        "price_inflation": faults.price_change(2.0),
        "null_keys": faults.null_keys_change(silver, first, 5),
        "scale_quantity": faults.quantity_change(silver, 2.0),
    }
    cases = {case: Scenario({"silver_orders": change}) for case, change in changes.items()}
    cases["orphans"] = Scenario({"order_payments": faults.orphans_change(bronze, paid, key="-1")})
    # Prices were inflated after Gold was built: that case keeps the healthy Gold.
    cases["price_inflation"] = Scenario({"silver_orders": changes["price_inflation"]}, gold_of="healthy")
    past = _silver_sums(silver).withColumn("i", F.explode(F.sequence(F.lit(-7), F.lit(7)))).selectExpr(
        "CAST(i AS STRING) AS run_id", "row_count + i AS bronze_count", "row_count + i AS silver_count",
        "i * 0.05D AS drop_pct", "revenue * (1D + i * 0.001D) AS gold_revenue",
    )
    landed = etl.land_layers({"historical_runs": past}, new_folder(spark, "cases"))
    tables = {"bronze_orders": bronze, "silver_orders": silver, "order_payments": paid, **landed}
    found = validate_scenarios(tables, cases, SPEC, run_date=RUN_DATE).results
    return faults.detection_matrix(found).select(PIPELINE, "detection_layer", "flagged")


# --- release gate ---------------------------------------------------------------


@query
def gate_profile(spark, sf):
    tables = gate_tables(spark, sf)
    return gate.gate_profile(tables["bronze_orders"], tables["silver_orders_buggy"])


@query
def gate_quality(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS pipeline", "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS order_id"
    )
    return gate.gate_quality(lines)


@query
def gate_baseline(spark, sf):
    return gate.gate_baseline(gate_tables(spark, sf)["historical_runs"])


def _gate_anomaly(tables):
    profile_ = gate.gate_profile(tables["bronze_orders"], tables["silver_orders_buggy"])
    return gate.gate_anomaly(profile_, gate.gate_baseline(tables["historical_runs"]))


@query
def gate_anomaly(spark, sf):
    return _gate_anomaly(gate_tables(spark, sf))


@query
def gate_root_cause(spark, sf):
    tables = gate_tables(spark, sf)
    return gate.gate_root_cause(tables["silver_orders_correct"], tables["silver_orders_buggy"])


@query
def gate_crosscheck(spark, sf):
    tables = gate_tables(spark, sf)
    return gate.gate_crosscheck(tables["silver_orders_correct"], tables["silver_orders_buggy"])


@query
def gate_impact(spark, sf):
    tables = gate_tables(spark, sf)
    return gate.gate_impact(tables["silver_orders_correct"], tables["silver_orders_buggy"])


@query
def gate_evidence(spark, sf):
    tables = gate_tables(spark, sf)
    profile_ = gate.gate_profile(tables["bronze_orders"], tables["silver_orders_buggy"])
    impact = gate.gate_impact(tables["silver_orders_correct"], tables["silver_orders_buggy"])
    return gate.gate_evidence(profile_, impact).select(PIPELINE, "name", "result")


@query
def gate_report(spark, sf):
    whole = gate.gate_report(gate_tables(spark, sf))
    return whole.selectExpr(
        PIPELINE, "verdict.decision AS decision", "array_join(verdict.reasons, '; ') AS reasons",
        "anomaly.severity AS severity", "impact.risk_level AS risk_level", "size(evidence) AS evidence_rows", "verdict.suggested_action AS suggested_action",
    )


# --- text -----------------------------------------------------------------------


@query
def redact_documents(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", redact(F.col("text")).alias("clean")).selectExpr(
        "doc_id", "length(clean) AS clean_chars", "md5(clean) AS digest"
    )


@query
def redact_conversations(spark, sf):
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", redact(F.col("text")).alias("clean"))


