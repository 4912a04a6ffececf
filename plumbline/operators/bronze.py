"""Bronze catalogue: ingestion completeness, structure, profiling (B1-B8)."""

from __future__ import annotations

import json

from plumbline.functions.sql import (
    between,
    case,
    concat,
    fixed,
    grouped,
    json_list,
    json_number,
    json_object,
    json_string,
    ladder,
    pass_or,
    percent,
    text,
    total,
)
from plumbline.functions.stats import tolerance_band
from plumbline.model import BRONZE, FAIL, PASS, WARN
from plumbline.operators.check import Check, Rule, run_checks
from plumbline.plans.metrics import MetricSheet
from plumbline.specs import quoted

# Ids and names of the Bronze catalogue.
NAMES = {
    "B1": "Source to Bronze Row Count",
    "B2": "Low / High / Normal Count",
    "B3": "Empty Table Check",
    "B4": "Required Columns Present",
    "B5": "Extra / Missing Columns",
    "B6": "Null Count per Mandatory Column",
    "B7": "Negative Value Profiling",
    "B8": "Duplicate Check",
}


def learned(sheet: MetricSheet, metric: str) -> tuple[str, str, str] | None:
    """Mean, standard deviation and usability of a history metric, if there is one.

    Without any spread there is no learned band.
    """
    if not sheet.offers("history", f"{metric}_mean"):
        return None
    mean = sheet.metric("history", f"{metric}_mean")
    std = sheet.metric("history", f"{metric}_std")
    return mean, std, f"coalesce({std} > 0, false)"


def band_place(status: str, middle: str = "slightly outside") -> str:
    return case(
        (f"{status} = '{PASS}'", text("inside")),
        (f"{status} = '{WARN}'", text(middle)),
        otherwise=text("far outside"),
    )


def null_report(sheet: MetricSheet, table: str, columns: tuple[str, ...]) -> tuple[str, str, str]:
    """Null counts of the columns present as JSON, the zero target and their sum."""
    present = [c for c in columns if c in sheet.columns(table)]
    if not present:
        return text("{}"), text("{}"), "0"
    counts = {c: sheet.number(table, f"null_{c}") for c in present}
    zeros = text(json.dumps(dict.fromkeys(counts, 0), separators=(",", ":"), ensure_ascii=False))
    label = f"{table}_nulls_of_{'_'.join(present)}"
    observed = sheet.derive(f"{label}_json", json_object(**counts))
    return observed, zeros, sheet.derive(label, total(list(counts.values())))


def null_sql(sheet: MetricSheet, table: str, columns: tuple[str, ...]) -> str:
    present = [c for c in columns if c in sheet.columns(table)]
    where = " OR ".join(f"{quoted(c)} IS NULL" for c in present) or "FALSE"
    return f"SELECT COUNT(*) FROM {table} WHERE {where}"


def amount(count: str, clean: str, dirty: str) -> str:
    """``clean`` when the count is zero, else the count followed by ``dirty``."""
    return case((f"{count} = 0", text(clean)), otherwise=concat(grouped(count), text(dirty)))


def _b1(sheet: MetricSheet) -> Check:
    spec = sheet.spec
    rows = sheet.number(spec.bronze, "rows")
    sql = f"SELECT COUNT(*) FROM {spec.bronze}"
    if not sheet.has_table(spec.source):
        return Check(
            "B1", NAMES["B1"], BRONZE, text(WARN),
            text(f"Nothing to compare with: no {spec.source} table."),
            json_number(rows), None, rows, sql,
        )
    source = sheet.number(spec.source, "rows")
    differ = concat(text("Source holds "), grouped(source), text(" rows, Bronze "), grouped(rows), text("."))
    detail = case((f"{source} = {rows}", text("Source and Bronze hold the same number of rows.")), otherwise=differ)
    return Check(
        "B1", NAMES["B1"], BRONZE, pass_or(f"{source} = {rows}"), detail,
        json_number(rows), json_number(source), rows, sql,
    )


def _b2(sheet: MetricSheet) -> Check:
    spec, limits = sheet.spec, sheet.spec.thresholds
    rows = sheet.number(spec.bronze, "rows")
    status = pass_or(between(rows, limits.min_rows, limits.max_rows))
    expected = text(f"{limits.min_rows:,}-{limits.max_rows:,} (configured)")
    basis = text("configured")
    history = learned(sheet, "bronze_count")
    if history:
        mean, std, usable = history
        low, high = tolerance_band(mean, std, limits.sigma_pass)
        wide = tolerance_band(mean, std, limits.sigma_warn)
        status = case((usable, ladder(between(rows, low, high), between(rows, *wide))), otherwise=status)
        basis = case((usable, text("learned")), otherwise=basis)
        shown = concat(fixed(low, 0), text("-"), fixed(high, 0), text(f" (mean +/- {limits.sigma_pass:g} std)"))
        expected = case((usable, shown), otherwise=expected)
    status = sheet.derive("count_status", status)
    detail = concat(text("Bronze row count is "), band_place(status), text(" the "), basis, text(" range."))
    return Check(
        "B2", NAMES["B2"], BRONZE, status, detail, json_number(rows), json_string(expected), rows,
        f"SELECT COUNT(*) FROM {spec.bronze}",
    )


def _b3(sheet: MetricSheet) -> Check:
    rows = sheet.number(sheet.spec.bronze, "rows")
    return Check(
        "B3", NAMES["B3"], BRONZE, pass_or(f"{rows} > 0"),
        case((f"{rows} > 0", text("Bronze holds rows.")), otherwise=text("Bronze is empty.")),
        json_number(rows), json_string(text("> 0")), rows,
        f"SELECT COUNT(*) FROM {sheet.spec.bronze}",
    )


def missing_columns(sheet: MetricSheet) -> list[str]:
    """Required Bronze columns that are absent; known without a job."""
    present = sheet.columns(sheet.spec.bronze)
    return [c for c in sheet.spec.required_columns if c not in present]


def _b4(sheet: MetricSheet) -> Check:
    missing = missing_columns(sheet)
    detail = f"Required columns missing: {missing}." if missing else "Every required column is present."
    return Check(
        "B4", NAMES["B4"], BRONZE, text(FAIL if missing else PASS), text(detail),
        text(json_list(sheet.columns(sheet.spec.bronze))), text(json_list(sheet.spec.required_columns)),
        str(len(missing)), f"SELECT * FROM {sheet.spec.bronze} LIMIT 0",
    )


def _b5(sheet: MetricSheet) -> Check:
    missing = missing_columns(sheet)
    surplus = [c for c in sheet.columns(sheet.spec.bronze) if c not in sheet.spec.required_columns]
    observed = f'{{"missing_columns": {json_list(missing)}, "extra_columns": {json_list(surplus)}}}'
    return Check(
        "B5", NAMES["B5"], BRONZE, text(WARN if missing else PASS),
        text(f"missing_columns={missing}, extra_columns={surplus}"),
        text(observed), text('{"missing_columns": [], "extra_columns": []}'),
        str(len(missing)), f"SELECT * FROM {sheet.spec.bronze} LIMIT 0",
        extra={"missing_columns": text(json_list(missing)), "extra_columns": text(json_list(surplus))},
    )


def _b6(sheet: MetricSheet) -> Check:
    spec = sheet.spec
    observed, zeros, nulls = null_report(sheet, spec.bronze, spec.bronze_mandatory)
    found = concat(text("Nulls in mandatory columns: "), observed, text("."))
    return Check(
        "B6", NAMES["B6"], BRONZE, pass_or(f"{nulls} = 0"),
        case((f"{nulls} = 0", text("Mandatory columns hold no nulls.")), otherwise=found),
        observed, zeros, nulls, null_sql(sheet, spec.bronze, spec.bronze_mandatory),
    )


def _b7(sheet: MetricSheet) -> Check:
    spec = sheet.spec
    sheet.need(spec.bronze, spec.quantity, spec.price)
    quantity = sheet.number(spec.bronze, "negative_quantity")
    price = sheet.number(spec.bronze, "negative_price")
    both = total([quantity, price])
    found = concat(
        grouped(quantity), text(" rows with negative quantity and "), grouped(price),
        text(" with negative price; Silver should remove them."),
    )
    return Check(
        "B7", NAMES["B7"], BRONZE, pass_or(f"{both} = 0", WARN),
        case((f"{both} = 0", text("No negative quantity or price.")), otherwise=found),
        json_object(negative_quantity=quantity, negative_unit_price=price),
        json_string(text("profiled (not blocking at Bronze)")), both,
        f"SELECT COUNT(*) FROM {spec.bronze} WHERE {spec.quantity} < 0 OR {spec.price} < 0",
    )


def bronze_key_excess(sheet: MetricSheet) -> str:
    sheet.need(sheet.spec.bronze, *sheet.spec.business_key)
    source = "bronze_keys" if sheet.offers("bronze_keys", "bronze_key_excess") else "keys"
    return sheet.number(source, "bronze_key_excess")


def duplicate_sql(table: str, key: tuple[str, ...]) -> str:
    cols = ", ".join(key)
    return f"SELECT {cols}, COUNT(*) FROM {table} GROUP BY {cols} HAVING COUNT(*) > 1"


def _b8(sheet: MetricSheet) -> Check:
    spec = sheet.spec
    excess = bronze_key_excess(sheet)
    share = sheet.derive("duplicate_pct", percent(excess, sheet.number(spec.bronze, "rows")))
    mild = f"{share} < {spec.thresholds.duplicate_pct_fail}D"
    found = concat(
        grouped(excess), text(" surplus rows on the business key ("), fixed(share),
        case((mild, text("%); Silver should remove them.")), otherwise=text("%): extreme duplicate load.")),
    )
    return Check(
        "B8", NAMES["B8"], BRONZE, ladder(f"{excess} = 0", mild),
        case((f"{excess} = 0", text("Business keys are unique in Bronze.")), otherwise=found),
        json_number(excess), "'0'", excess, duplicate_sql(spec.bronze, spec.business_key),
    )


def _rule(check_id: str, build) -> Rule:
    return Rule(check_id, NAMES[check_id], BRONZE, build)


def validate_bronze(sheet: MetricSheet) -> list[Check]:
    """B1-B8; a failed column check makes the deeper profile meaningless, so it ends there."""
    core = run_checks(sheet, [_rule("B1", _b1), _rule("B2", _b2), _rule("B3", _b3), _rule("B4", _b4)])
    if sheet.has_table(sheet.spec.bronze) and missing_columns(sheet):
        return core
    return core + run_checks(
        sheet, [_rule("B5", _b5), _rule("B6", _b6), _rule("B7", _b7), _rule("B8", _b8)]
    )
