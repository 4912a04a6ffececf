"""One JSON report document per pipeline and run, assembled as Columns."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import (
    BRONZE,
    CROSS_LAYER,
    DETECTION_LAYERS,
    GOLD,
    PIPELINE,
    SILVER,
)
from plumbline.operators.rollup import RUN, summarize

# Constant text of the report contract.
DESCRIPTION = "Cross-layer data quality validation framework"
FLOW = "Raw → Bronze → Silver → Gold"
IMPACT_NOTE = (
    "Expected revenue is the revenue of all valid Bronze records; actual is current Gold "
    "revenue. The gap is the value lost to dropped valid records."
)
IMPACT_MISSING = "Expected baseline not available."

_KEEP_NULLS = {"ignoreNullFields": "false"}


def _check_json(status: str, detail: str) -> Column:
    """A check as JSON text; observed and expected keep their own JSON types."""
    tags = F.map_from_arrays(
        F.array(F.lit("dimension"), F.lit("detection_layer"), F.lit("table")),
        F.array("dimension", "detection_layer", "table_name"),
    )
    merged = F.map_concat(tags, F.coalesce("extra", F.create_map().cast("map<string,string>")))
    merged = F.map_filter(merged, lambda _, v: v.isNotNull())
    typed = F.transform_values(
        merged, lambda _, v: F.coalesce(F.try_parse_json(v), v.cast("variant"))
    )
    fields = F.struct(
        "check_id",
        "check_name",
        "layer",
        F.col(status).alias("status"),
        F.try_parse_json("observed").alias("observed"),
        F.try_parse_json("expected").alias("expected"),
        F.col(detail).alias("detail"),
        "evidence_query",
        typed.alias("extra"),
    )
    return F.to_json(fields, _KEEP_NULLS)


def _section(condition: Column, text: str) -> Column:
    """Aggregate: JSON array text of the checks meeting a condition, in order."""
    rows = F.array_sort(F.collect_list(F.when(condition, F.struct("seq", text))))
    return F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r[text]), ","), F.lit("]"))


def _sections(results: DataFrame) -> DataFrame:
    rows = results.withColumns(
        {
            "_final": _check_json("status", "detail"),
            "_detected": _check_json("detected_status", "detected_detail"),
        }
    )
    names = {BRONZE: "bronze", SILVER: "silver", GOLD: "gold", CROSS_LAYER: "cross_layer"}
    checks = [
        _section(F.col("layer") == layer, "_final").alias(f"_checks_{name}")
        for layer, name in names.items()
    ]
    detection = [
        _section(F.col("detection_layer") == d, "_detected").alias(f"_{d}") for d in DETECTION_LAYERS
    ]
    grouped = rows.groupBy(*RUN).agg(*checks, *detection)
    return grouped.select(
        *RUN,
        F.struct(
            *[F.parse_json(f"_checks_{n}").alias(n) for n in names.values()]
        ).alias("checks"),
        F.struct(*[F.parse_json(f"_{d}").alias(d) for d in DETECTION_LAYERS]).alias(
            "detection_layers"
        ),
    )


def report_documents(
    results: DataFrame,
    impact: DataFrame,
    project: str = "plumbline",
    dataset: str = "Retail Orders",
) -> DataFrame:
    """(pipeline, run_id, final_verdict, report JSON text) per run."""
    joined = (
        summarize(results)
        .join(_sections(results), list(RUN))
        .join(impact.withColumnRenamed("status", "_impact"), PIPELINE, "left")
    )
    known = F.col("_impact") == "AVAILABLE"
    amounts = ("expected_revenue", "actual_revenue", "estimated_loss", "loss_percent")
    money = F.struct(*amounts, F.lit(IMPACT_NOTE).alias("detail"))
    missing = F.struct(
        F.lit("NOT_AVAILABLE").alias("status"), F.lit(IMPACT_MISSING).alias("detail")
    )
    counts = ("total_checks", "passed", "warned", "failed", "impacted", "skipped")
    covered = F.struct(*counts, "skipped_details", "full_coverage")
    caveated = F.struct(*counts, "skipped_details", "full_coverage", "verdict_caveat")
    document = F.struct(
        F.lit(project).alias("project"),
        F.lit(DESCRIPTION).alias("description"),
        F.lit(FLOW).alias("pipeline"),
        F.lit(dataset).alias("dataset"),
        "run_id",
        F.struct("bronze", "silver", "gold").alias("layer_status"),
        "final_verdict",
        "severity",
        "first_failed_layer",
        F.struct("summary", "failed_check_ids", "suspected_filter", "evidence").alias("root_cause"),
        F.parse_json(
            F.when(known, F.to_json(money, _KEEP_NULLS)).otherwise(F.to_json(missing))
        ).alias("business_impact"),
        "suggested_action",
        F.parse_json(
            F.when(F.col("verdict_caveat").isNull(), F.to_json(covered)).otherwise(F.to_json(caveated))
        ).alias("coverage"),
        "detection_layers",
        "checks",
    )
    return joined.select(
        *RUN, "final_verdict", F.to_json(document, _KEEP_NULLS).alias("report")
    )


def report_dict(reports: DataFrame, run_id: str, pipeline: str | None = None) -> dict[str, Any]:
    """One report document as a Python dict."""
    wanted = reports.filter(F.col("run_id") == run_id)
    if pipeline is not None:
        wanted = wanted.filter(F.col(PIPELINE) == pipeline)
    row = wanted.select("report").head()
    if row is None:
        raise LookupError(f"no report for run '{run_id}'")
    return json.loads(row["report"])
