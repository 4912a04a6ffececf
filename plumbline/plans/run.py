"""A whole validation: layers in, result table, summary and report out."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.sql import case, text, worst_in
from plumbline.model import (
    ANOMALY,
    BRONZE,
    CROSS_LAYER,
    DEFAULT_PIPELINE,
    GOLD,
    PIPELINE,
    RESULT_SCHEMA,
    SILVER,
)
from plumbline.operators.anomaly import run_robust_anomaly_layer
from plumbline.operators.bronze import validate_bronze
from plumbline.operators.check import Check, Rule, run_checks
from plumbline.operators.gold import validate_gold
from plumbline.operators.reconciliation import run_reconciliation_layer
from plumbline.operators.rollup import cross_layer_checks, downstream_impact, impact_columns
from plumbline.operators.rules import run_rule_library
from plumbline.operators.silver import validate_silver
from plumbline.plans.lineage import cut_lineage
from plumbline.plans.metrics import MetricSheet, collect_metrics
from plumbline.specs import PipelineSpec

log = logging.getLogger("plumbline.run")

# Detection results follow the catalogue results of their layer.
DETECTION_SEQ = 1000


def detection_stack(sheet: MetricSheet, run_date: dt.date) -> list[tuple[int, Check]]:
    """Rules, reconciliation and anomaly checks with their report position."""
    checks = [
        *run_rule_library(sheet, run_date),
        *run_reconciliation_layer(sheet),
        *run_robust_anomaly_layer(sheet),
    ]
    return list(enumerate(checks, start=DETECTION_SEQ))


def detect(
    layers: Mapping[str, DataFrame],
    spec: PipelineSpec | None = None,
    *,
    run_id: str = "run",
    run_date: dt.date | None = None,
    pipeline: str = DEFAULT_PIPELINE,
) -> DataFrame:
    """The detection stack alone, as a lazy result table."""
    sheet = collect_metrics(layers, spec or PipelineSpec(), pipeline)
    found = detection_stack(sheet, run_date or dt.date.today())
    return _rows(sheet.wide(), run_id, f"array({', '.join(c.row(seq) for seq, c in found)})")


def _rows(wide: DataFrame, run_id: str, checks: str) -> DataFrame:
    """One result row per element of a check array."""
    rows = wide.selectExpr(PIPELINE, f"{text(run_id)} AS run_id", f"inline({checks})")
    return rows.select(*[f.name for f in RESULT_SCHEMA.fields])


def check_results(
    layers: Mapping[str, DataFrame],
    spec: PipelineSpec | None = None,
    *,
    run_id: str = "run",
    run_date: dt.date | None = None,
    pipeline: str = DEFAULT_PIPELINE,
    extra_rules: Sequence[Rule] = (),
    sheet: MetricSheet | None = None,
) -> DataFrame:
    """Bronze, Silver and Gold results (catalogue and detection stack), lazily.

    The Silver status is derived inside the same row, so the Gold checks that depend
    on it need neither a second job nor a join.
    """
    sheet = sheet or collect_metrics(layers, spec or PipelineSpec(), pipeline)
    detected = detection_stack(sheet, run_date or dt.date.today())

    upstream = "_silver_status"
    own = run_checks(sheet, extra_rules)

    def checks(layer: str, catalogue: list[Check]) -> Column:
        listed = [*enumerate([*catalogue, *(c for c in own if c.layer == layer)])]
        listed += [(seq, _impacted(c, upstream)) for seq, c in detected if c.layer == layer]
        return F.expr(f"array({', '.join(c.row(seq) for seq, c in listed)})")

    bronze, silver = validate_bronze(sheet), validate_silver(sheet)
    gold = validate_gold(sheet, upstream)
    staged = sheet.wide().withColumns(
        {"_bronze": checks(BRONZE, bronze), "_silver": checks(SILVER, silver)}
    )
    staged = staged.withColumn(upstream, F.expr(worst_in("_silver.status")))
    staged = staged.withColumn("_gold", checks(GOLD, gold))
    sections = ["_bronze", "_silver", "_gold"]
    if any(c.layer == CROSS_LAYER for c in own):
        staged = staged.withColumn("_cross", checks(CROSS_LAYER, []))
        sections.append("_cross")
    return _rows(staged, run_id, f"concat({', '.join(sections)})")


def _impacted(check: Check, upstream: str) -> Check:
    """Gold anomalies follow the upstream layer; the detected status is kept beside."""
    if check.layer != GOLD or check.detection_layer != ANOMALY:
        return check
    status, detail, hit = downstream_impact(check.status, check.detail, upstream)
    return replace(
        check,
        status=status,
        detail=detail,
        detected_status=check.status,
        detected_detail=check.detail,
        extra={**check.extra, "upstream_adjusted": case((hit, text("true")))},
    )


def business_impact(
    layers: Mapping[str, DataFrame],
    spec: PipelineSpec | None = None,
    pipeline: str = DEFAULT_PIPELINE,
    sheet: MetricSheet | None = None,
) -> DataFrame:
    """Expected against actual revenue per pipeline, with an availability status."""
    sheet = sheet or collect_metrics(layers, spec or PipelineSpec(), pipeline)
    spec = sheet.spec
    known = sheet.offers(spec.bronze, "expected_revenue") and sheet.offers(spec.gold, "total_revenue")
    if not known:
        amounts = [f"CAST(NULL AS DOUBLE) AS {n}" for n in impact_columns("NULL", "NULL")]
        return replace(sheet, derived={}).wide().selectExpr(PIPELINE, *amounts, "'NOT_AVAILABLE' AS status")
    picked = [f"{spec.bronze}__expected_revenue", f"{spec.gold}__total_revenue"]
    frames = {name: f for name, f in sheet.frames.items() if set(picked) & set(f.columns)}
    slim = replace(sheet, frames=frames, shared=sheet.shared & set(frames), derived={})
    # A Gold table without a row says nothing, whatever its columns are.
    held = f"coalesce({spec.gold}__rows, 0) > 0"
    amounts = [f"CASE WHEN {held} THEN {sql} END AS {n}" for n, sql in impact_columns(*picked).items()]
    state = f"CASE WHEN {held} THEN 'AVAILABLE' ELSE 'NOT_AVAILABLE' END AS status"
    return slim.wide().selectExpr(PIPELINE, *amounts, state)


@dataclass
class ValidationRun:
    """Results of one validation of one or many pipelines.

    ``results`` is checkpointed: everything derived from it is cheap and never
    touches the layer tables again.
    """

    run_id: str
    results: DataFrame
    impact: DataFrame

    @cached_property
    def summary(self) -> DataFrame:
        from plumbline.operators.rollup import summarize

        return summarize(self.results)

    @cached_property
    def report(self) -> DataFrame:
        from plumbline.plans.report import report_documents

        return report_documents(self.results, self.impact)


def validate(
    layers: Mapping[str, DataFrame],
    spec: PipelineSpec | None = None,
    *,
    run_id: str = "run",
    run_date: dt.date | None = None,
    pipeline: str = DEFAULT_PIPELINE,
    extra_rules: Sequence[Rule] = (),
    two_pass_rows: bool = False,
) -> ValidationRun:
    """Run every check and return the run.

    With ``two_pass_rows``, full-row duplicates are counted from row hashes first, so that
    whole rows are shuffled only where a hash repeats; the count is the same.

    The metric sheet is computed once, in one job, and checkpointed. A job that fails is run
    once more, for it may have lost its executors. If an input makes it fail again, its frames
    run side by side, those that finish are kept, and halving finds the metrics at fault: their
    checks are reported as SKIPPED with the (redacted) reason.
    """
    sheet = collect_metrics(layers, spec or PipelineSpec(), pipeline, two_pass_rows)
    return run_of(sheet, run_id=run_id, run_date=run_date, extra_rules=extra_rules)


def run_of(
    sheet: MetricSheet, *, run_id: str = "run", run_date: dt.date | None = None, extra_rules: Sequence[Rule] = ()
) -> ValidationRun:
    """The run that a planned metric sheet amounts to."""
    sheet = _settled(sheet)
    core = check_results(
        sheet.layers, run_id=run_id, run_date=run_date or dt.date.today(), extra_rules=extra_rules, sheet=sheet
    )
    core = cut_lineage(core)
    results = core.unionByName(cross_layer_checks(core))
    return ValidationRun(run_id, results, business_impact(sheet.layers, sheet=sheet))


def _settled(sheet: MetricSheet) -> MetricSheet:
    """The sheet computed as a whole, at the second attempt, or without what can't be computed."""
    for again in (True, False):
        try:
            return _computed(sheet)
        except Exception as error:  # whatever one input did, the others still count
            log.warning("fused metrics failed (%s)%s", type(error).__name__, "; once more" if again else "; isolating")
    sheet.probe()
    return _computed(sheet)


def _computed(sheet: MetricSheet) -> MetricSheet:
    """The same sheet backed by its checkpointed wide row."""
    wide = cut_lineage(sheet.wide())
    return replace(sheet, frames={"sheet": wide}, fused={}, shared=set(), derived={})

