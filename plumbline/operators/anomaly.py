"""Robust anomaly detection: current metrics against their own run history."""

from __future__ import annotations

from dataclasses import dataclass

from plumbline.functions.sql import case, concat, drop_percent, fixed, json_object, json_string, text
from plumbline.functions.stats import classify_robust_anomaly, modified_z_score, robust_iqr_band
from plumbline.model import (
    ACCURACY,
    ANOMALY,
    BRONZE,
    COMPLETENESS,
    FAIL,
    GOLD,
    PASS,
    SILVER,
    SKIPPED,
)
from plumbline.operators.check import NOT_EVALUATED, Check, Rule, run_checks, skipped
from plumbline.operators.silver import drop_sql
from plumbline.plans.metrics import MetricSheet


@dataclass(frozen=True)
class Monitored:
    metric: str
    title: str
    layer: str
    dimension: str

    @property
    def check_id(self) -> str:
        return f"L3-ANO-{self.metric.upper()[:6]}"

    @property
    def check_name(self) -> str:
        return f"Robust Anomaly: {self.title}"


# The monitored metrics, in report order.
MONITORED = (
    Monitored("bronze_count", "Bronze Row Count", BRONZE, COMPLETENESS),
    Monitored("silver_count", "Silver Row Count", SILVER, COMPLETENESS),
    Monitored("drop_pct", "Bronze-to-Silver Drop %", SILVER, COMPLETENESS),
    Monitored("gold_revenue", "Gold Revenue", GOLD, ACCURACY),
)
BAND_METHOD = "median + IQR (Q1 - 1.5*IQR, Q3 + 1.5*IQR)"
WITHIN_BAND = "within robust IQR band"
SCORE_METHOD = "median + IQR; modified Z (MAD)"


def current_value(sheet: MetricSheet, metric: str) -> tuple[str, str]:
    """Today's value and the SQL that yields it; NULL when it cannot be scored."""
    spec = sheet.spec
    if metric == "bronze_count":
        return sheet.number(spec.bronze, "rows"), f"SELECT COUNT(*) FROM {spec.bronze}"
    if metric == "silver_count":
        return sheet.number(spec.silver, "rows"), f"SELECT COUNT(*) FROM {spec.silver}"
    if metric == "drop_pct":
        before, after = sheet.number(spec.bronze, "rows"), sheet.number(spec.silver, "rows")
        return drop_percent(before, after, empty="NULL"), drop_sql(spec)
    sheet.need(spec.gold, "total_revenue")
    return sheet.metric(spec.gold, "total_revenue"), f"SELECT total_revenue FROM {spec.gold}"


def _score(item: Monitored):
    def build(sheet: MetricSheet) -> Check | None:
        if not sheet.offers("history", f"{item.metric}_median"):
            return None
        limits = sheet.spec.thresholds
        raw, sql = current_value(sheet, item.metric)
        name = item.metric
        value = sheet.derive(f"{name}_value", f"CAST({raw} AS DOUBLE)")
        q1, median, q3, mad = (
            sheet.metric("history", f"{name}_{s}") for s in ("q1", "median", "q3", "mad")
        )
        n = sheet.number("history", f"{name}_n")
        iqr, low, high = (
            sheet.derive(f"{name}_{part}", sql)
            for part, sql in zip(("iqr", "low", "high"), robust_iqr_band(q1, q3, limits), strict=True)
        )
        z = sheet.derive(f"{name}_z", modified_z_score(value, median, mad, limits))
        status = sheet.derive(
            f"{name}_status", classify_robust_anomaly(value, n, q1, median, q3, mad, limits)
        )
        flat = f"({iqr} = 0 OR {mad} = 0)"
        band = concat(text("["), f"format_string('%.4g, %.4g', {low}, {high})", text("]"))
        detail = case(
            (f"{n} < {limits.min_history}",
             concat(text("no baseline yet: "), f"CAST({n} AS STRING)",
                    text(f" past runs, {limits.min_history} needed"))),
            (f"{value} IS NULL", text(f"current {item.metric} is NULL (empty upstream), nothing to score")),
            (f"{flat} AND {value} = {median}", text("Value equals a constant baseline (IQR or MAD is 0).")),
            (flat, text("Value left a constant baseline (IQR or MAD is 0); the change cannot be scored.")),
            (f"{status} = '{PASS}'", text("Inside the robust band.")),
            (f"{status} = '{FAIL}'",
             concat(text("Extreme outlier: modified Z "), fixed(z), text(", outside "), band, text("."))),
            otherwise=concat(text("Mild outlier: outside "), band, text(", modified Z "), fixed(z), text(".")),
        )
        detail = sheet.derive(f"{name}_detail", detail)
        scored = json_object(
            value=value, median=median, iqr_lower=low, iqr_upper=high, modified_z=f"round({z}, 2)",
            history_count=n, method=text(BAND_METHOD), detail=detail,
        )
        constant = json_object(
            value=value, median=median, iqr=iqr, mad=mad, history_count=n,
            method=text(BAND_METHOD), detail=detail,
        )
        skip = f"{status} = '{SKIPPED}'"
        goal = case((skip, text(NOT_EVALUATED)), otherwise=text(WITHIN_BAND))
        return Check(
            item.check_id, item.check_name, item.layer, status, detail,
            observed=case((skip, "NULL"), (flat, constant), otherwise=scored),
            expected=json_string(goal),
            value=value, evidence=sql, dimension=item.dimension, detection_layer=ANOMALY,
            extra={
                "metric": text(item.metric),
                "method": text(SCORE_METHOD),
                "modified_z": case((f"NOT {flat}", f"round({z}, 2)")),
            },
        )

    return build


def run_robust_anomaly_layer(sheet: MetricSheet) -> list[Check]:
    """Four metrics scored from one grouped pass over the history."""
    if not sheet.has_table(sheet.spec.history):
        need = sheet.spec.thresholds.min_history
        reason = f"no baseline yet: 0 past runs, {need} needed"
        return [skipped(m.check_id, m.check_name, m.layer, reason, ANOMALY) for m in MONITORED]
    return run_checks(
        sheet, [Rule(m.check_id, m.check_name, m.layer, _score(m), ANOMALY) for m in MONITORED]
    )
