"""Silver catalogue: drop rate, cleanliness, wrongly lost records (S1-S10)."""

from __future__ import annotations

from plumbline.functions.sql import (
    between,
    case,
    concat,
    drop_percent,
    fixed,
    grouped,
    json_number,
    json_object,
    json_string,
    ladder,
    pass_or,
    percent,
    ratio,
    text,
)
from plumbline.functions.stats import tolerance_band
from plumbline.model import FAIL, SILVER, WARN
from plumbline.operators.bronze import (
    amount,
    band_place,
    bronze_key_excess,
    duplicate_sql,
    learned,
    null_report,
    null_sql,
)
from plumbline.operators.check import Check, Rule, run_checks
from plumbline.plans.metrics import MetricSheet
from plumbline.specs import PipelineSpec

# Ids and names of the Silver catalogue.
NAMES = {
    "S1": "Bronze to Silver Drop Percentage",
    "S2": "Expected Drop Check",
    "S3": "Deduplication Count Check",
    "S4": "Mandatory Columns Not Null",
    "S5": "Quantity > 0",
    "S6": "Unit Price > 0",
    "S7": "Revenue Not Negative",
    "S8": "Valid Record Wrongly Removed",
    "S9": "Record-Loss by Segment",
    "S10": "Wrong Filter Detection",
}
# Texts of observed and expected in the report contract.
HIGH_FILTER = " records are being filtered out"
UNCLEAR_FILTER = "unclear filter (missing records span multiple quantity ranges)"
NONE_MISSING = "no missing valid records"
NO_SUSPECT = "no suspect filter"
SEGMENT_GOAL = "< 5% loss per segment"
NO_ROWS = "n/a (bronze empty)"

EMPTY_BRONZE = "Bronze is empty, so no drop percentage exists."


def drop_sql(spec: PipelineSpec) -> str:
    return (
        f"SELECT (1 - CAST((SELECT COUNT(*) FROM {spec.silver}) AS DOUBLE) "
        f"/ NULLIF((SELECT COUNT(*) FROM {spec.bronze}), 0)) * 100 AS drop_pct"
    )


def window_status(drop: str, spec: PipelineSpec) -> str:
    """Status of a drop percentage against the configured window."""
    limits = spec.thresholds
    return ladder(
        between(drop, limits.min_drop, limits.max_drop),
        f"{drop} <= {limits.max_drop * limits.drop_slack}",
    )


def learned_status(drop: str, mean: str, std: str, spec: PipelineSpec) -> str:
    """Status of a value against its learned sigma bands."""
    limits = spec.thresholds
    return ladder(
        between(drop, *tolerance_band(mean, std, limits.sigma_pass)),
        between(drop, *tolerance_band(mean, std, limits.sigma_warn)),
    )


def _pct(value: str) -> str:
    return concat(fixed(value), text("%"))


def _s1(sheet: MetricSheet) -> Check:
    spec, limits = sheet.spec, sheet.spec.thresholds
    before, after = sheet.number(spec.bronze, "rows"), sheet.number(spec.silver, "rows")
    drop = sheet.derive("drop", drop_percent(before, after))
    status = window_status(drop, spec)
    expected = text(f"{limits.min_drop:.1f}%-{limits.max_drop:.1f}% (configured)")
    basis = text("configured")
    history = learned(sheet, "drop_pct")
    if history:
        mean, std, usable = history
        low, high = tolerance_band(mean, std, limits.sigma_pass)
        status = case((usable, learned_status(drop, mean, std, spec)), otherwise=status)
        basis = case((usable, text("learned")), otherwise=basis)
        shown = concat(_pct(low), text("-"), _pct(high), text(f" (mean +/- {limits.sigma_pass:g} std)"))
        expected = case((usable, shown), otherwise=expected)
    status = sheet.derive("drop_status", status)
    empty = f"{before} = 0"
    detail = concat(text("Drop is "), band_place(status), text(" the "), basis, text(" range."))
    return Check(
        "S1", NAMES["S1"], SILVER,
        case((empty, text(FAIL)), otherwise=status),
        case((empty, text(EMPTY_BRONZE)), otherwise=detail),
        json_string(case((empty, text(NO_ROWS)), otherwise=_pct(drop))),
        json_string(case((empty, text(f"non-empty {spec.bronze}")), otherwise=expected)),
        drop, drop_sql(spec),
        extra={"bronze": before, "silver": after, "drop_pct": f"round({drop}, 2)"},
    )


def _s2(sheet: MetricSheet) -> Check:
    spec, limits = sheet.spec, sheet.spec.thresholds
    before, after = sheet.number(spec.bronze, "rows"), sheet.number(spec.silver, "rows")
    drop = sheet.derive("drop", drop_percent(before, after))
    empty = f"{before} = 0"
    window = f"{limits.min_drop:.1f}%-{limits.max_drop:.1f}%"
    status = sheet.derive("window_status", window_status(drop, spec))
    detail = concat(
        text("Drop "), _pct(drop), text(" is "), band_place(status, "just outside"),
        text(f" the expected window {window}."),
    )
    return Check(
        "S2", NAMES["S2"], SILVER,
        case((empty, text(FAIL)), otherwise=status),
        case((empty, text(EMPTY_BRONZE)), otherwise=detail),
        json_string(case((empty, text(NO_ROWS)), otherwise=_pct(drop))),
        json_string(text(window)), drop, drop_sql(spec),
    )


def _s3(sheet: MetricSheet) -> Check:
    spec = sheet.spec
    sheet.need(spec.silver, *spec.business_key)
    bronze = bronze_key_excess(sheet)
    silver = sheet.number("keys", "silver_key_excess")
    detail = concat(
        grouped(bronze), text(" surplus rows on the business key in Bronze, "),
        case((f"{silver} = 0", text("none")), otherwise=grouped(silver)), text(" in Silver."),
    )
    return Check(
        "S3", NAMES["S3"], SILVER, pass_or(f"{silver} = 0", WARN), detail,
        json_object(bronze_duplicates=bronze, silver_duplicates=silver),
        text('{"silver_duplicates":0}'), silver, duplicate_sql(spec.silver, spec.business_key),
    )


def _s4(sheet: MetricSheet) -> Check:
    spec = sheet.spec
    observed, zeros, nulls = null_report(sheet, spec.silver, spec.silver_mandatory)
    found = concat(text("Nulls in mandatory Silver columns: "), observed, text("."))
    return Check(
        "S4", NAMES["S4"], SILVER, pass_or(f"{nulls} = 0"),
        case((f"{nulls} = 0", text("Mandatory Silver columns hold no nulls.")), otherwise=found),
        observed, zeros, nulls, null_sql(sheet, spec.silver, spec.silver_mandatory),
    )


def _violation(check_id: str, metric: str, column: str, condition: str):
    def build(sheet: MetricSheet) -> Check:
        name = getattr(sheet.spec, column)
        sheet.need(sheet.spec.silver, name)
        bad = sheet.number(sheet.spec.silver, metric)
        return Check(
            check_id, NAMES[check_id], SILVER, pass_or(f"{bad} = 0"),
            amount(bad, f"No Silver row has {name} {condition}.", f" Silver rows have {name} {condition}."),
            json_number(bad), "'0'", bad,
            f"SELECT COUNT(*) FROM {sheet.spec.silver} WHERE {name} {condition}",
        )

    return build


def lost_rows_sql(spec: PipelineSpec, select: str) -> str:
    match = " AND ".join(f"s.{k} IS NOT DISTINCT FROM b.{k}" for k in spec.business_key)
    return (
        f"SELECT {select} FROM {spec.bronze} b WHERE {spec.valid_row()} "
        f"AND NOT EXISTS (SELECT 1 FROM {spec.silver} s WHERE {match})"
    )


def _lost(sheet: MetricSheet) -> str:
    sheet.need(sheet.spec.bronze, *sheet.spec.business_key, sheet.spec.quantity, sheet.spec.price)
    sheet.need(sheet.spec.silver, *sheet.spec.business_key)
    return sheet.number("keys", "lost_rows")


def loss_status(lost: str, valid: str, spec: PipelineSpec) -> str:
    return ladder(f"{lost} = 0", f"{percent(lost, valid)} < {spec.thresholds.loss_pct_fail}D")


def _s8(sheet: MetricSheet) -> Check:
    spec = sheet.spec
    lost = _lost(sheet)
    valid = sheet.number(spec.bronze, "valid_rows")
    share = sheet.derive("loss_pct", percent(lost, valid))
    found = concat(
        grouped(lost), text(" valid Bronze rows are missing from Silver ("), fixed(share),
        text("% of the valid rows)."),
    )
    return Check(
        "S8", NAMES["S8"], SILVER, loss_status(lost, valid, spec),
        case((f"{lost} = 0", text("Every valid Bronze row is present in Silver.")), otherwise=found),
        json_number(lost), "'0'", lost, lost_rows_sql(spec, "COUNT(*)"),
        extra={"valid_bronze": valid, "missing": lost, "loss_pct": f"round({share}, 2)"},
    )


def segment_status(loss: str, spec: PipelineSpec) -> str:
    limits = spec.thresholds
    return ladder(f"{loss} < {limits.segment_pct_warn}D", f"{loss} < {limits.segment_pct_fail}D")


def _segment(sheet: MetricSheet, label: str, tag: str) -> str:
    valid = f"CAST({sheet.number(sheet.spec.bronze, f'valid_{tag}')} AS BIGINT)"
    kept = f"CAST({sheet.number(sheet.spec.silver, f'{tag}_rows')} AS BIGINT)"
    loss = f"round((1D - {ratio(kept, valid)}) * 100, 2)"
    return (
        f"named_struct('segment', {text(label)}, 'bronze_valid', {valid}, "
        f"'silver_count', {kept}, 'loss_pct', {loss})"
    )


def _s9(sheet: MetricSheet) -> Check:
    spec = sheet.spec
    sheet.need(spec.silver, spec.quantity)
    both = (_segment(sheet, spec.high_segment, "high"), _segment(sheet, spec.low_segment, "low"))
    # Worst loss first; the label breaks ties.
    segments = (
        f"array_sort(filter(array({', '.join(both)}), s -> s.bronze_valid > 0), (a, b) -> CASE "
        "WHEN a.loss_pct > b.loss_pct THEN -1 WHEN a.loss_pct < b.loss_pct THEN 1 "
        "WHEN a.segment < b.segment THEN -1 ELSE 1 END)"
    )
    segments = sheet.derive("segments", segments)
    loss = f"coalesce(get({segments}, 0).loss_pct, 0D)"
    label = f"coalesce(get({segments}, 0).segment, 'n/a')"
    calm = f"{loss} < {spec.thresholds.segment_pct_warn}D"
    found = concat(text("Segment '"), label, text("' lost "), fixed(loss), text("% of its valid rows."))
    split = f"CASE WHEN {spec.high_segment} THEN '{spec.high_segment}' ELSE '{spec.low_segment}' END"
    sql = (
        "SELECT segment, SUM(valid) AS bronze_valid, SUM(kept) AS silver_count FROM ("
        f"SELECT {split} AS segment, 1 AS valid, 0 AS kept FROM {spec.bronze} WHERE {spec.valid_row()} "
        f"UNION ALL SELECT {split}, 0, 1 FROM {spec.silver}) GROUP BY segment"
    )
    return Check(
        "S9", NAMES["S9"], SILVER, segment_status(loss, spec),
        case((calm, text("No segment lost a notable share of its rows.")), otherwise=found),
        f"to_json({segments})", json_string(text(SEGMENT_GOAL)), loss, sql,
        extra={"segments": f"to_json({segments})", "worst_segment": label},
    )


def suspected_filter(lowest: str, spec: PipelineSpec) -> str:
    """What the smallest lost quantity says about the filter that lost the rows."""
    return case(
        (f"{lowest} > {spec.segment_quantity}", text(spec.high_segment + HIGH_FILTER)),
        otherwise=text(UNCLEAR_FILTER),
    )


def _s10(sheet: MetricSheet) -> Check:
    spec = sheet.spec
    lost = _lost(sheet)
    lowest = sheet.metric("keys", "lost_min_quantity")
    none = f"{lost} = 0"
    suspect = suspected_filter(lowest, spec)
    found = concat(
        grouped(lost), text(f" valid rows missing, smallest {spec.quantity} "), fixed(lowest, 0),
        text("; suspected cause: "), suspect, text("."),
    )
    return Check(
        "S10", NAMES["S10"], SILVER, pass_or(none),
        case((none, text("No valid record is missing, so no filter is suspected.")), otherwise=found),
        json_string(case((none, text(NONE_MISSING)), otherwise=suspect)),
        json_string(text(NO_SUSPECT)), lost,
        lost_rows_sql(spec, f"MIN({spec.quantity}), MAX({spec.quantity}), COUNT(*)"),
        extra={
            "suspected_filter": case((none, "NULL"), otherwise=suspect),
            "missing": lost,
            "min_quantity": lowest,
            "max_quantity": sheet.metric("keys", "lost_max_quantity"),
        },
    )


def validate_silver(sheet: MetricSheet) -> list[Check]:
    """S1-S10 in catalogue order."""
    builders = {
        "S1": _s1,
        "S2": _s2,
        "S3": _s3,
        "S4": _s4,
        "S5": _violation("S5", "nonpositive_quantity", "quantity", "<= 0"),
        "S6": _violation("S6", "nonpositive_price", "price", "<= 0"),
        "S7": _violation("S7", "negative_revenue", "revenue", "< 0"),
        "S8": _s8,
        "S9": _s9,
        "S10": _s10,
    }
    return run_checks(sheet, [Rule(i, NAMES[i], SILVER, b) for i, b in builders.items()])
