"""Gold catalogue: every metric reconciled with Silver, revenue against history (G1-G6)."""

from __future__ import annotations

from dataclasses import replace

from plumbline.functions.sql import (
    between,
    case,
    concat,
    grouped,
    json_number,
    json_object,
    json_string,
    pass_or,
    ratio,
    text,
)
from plumbline.functions.stats import tolerance_band
from plumbline.model import FAIL, GOLD, IMPACTED, PASS, WARN
from plumbline.operators.bronze import amount, learned
from plumbline.operators.check import Check, Rule, guarded, run_checks
from plumbline.plans.metrics import MetricSheet
from plumbline.specs import PipelineSpec

# Ids and names of the Gold catalogue.
NAMES = {
    "G1": "Revenue Reconciliation (within rounding tolerance)",
    "G2": "Order Count Reconciliation",
    "G3": "Customer Count Reconciliation",
    "G4": "Average Order Value Check",
    "G5": "Revenue vs Expected Baseline",
    "G6": "Country-wise Revenue Reconciliation",
}
EMPTY_GOLD = "the Gold table holds no row"


def no_gold_row(sheet: MetricSheet) -> str:
    return f"{sheet.number(sheet.spec.gold, 'rows')} = 0"


def one_gold_row(sheet: MetricSheet, check: Check) -> Check:
    """FAIL where Gold holds several rows: its values would be those of no row in particular."""
    rows = sheet.number(sheet.spec.gold, "rows")
    found = concat(text("Gold holds "), grouped(rows), text(" rows where one is expected; its values are ambiguous."))
    return replace(
        check,
        status=case((f"{rows} > 1", text(FAIL)), otherwise=check.status),
        detail=case((f"{rows} > 1", found), otherwise=check.detail),
    )


def gold_value(sheet: MetricSheet, name: str) -> str:
    sheet.need(sheet.spec.gold, name)
    return sheet.number(sheet.spec.gold, name)


def silver_documents(sheet: MetricSheet) -> str:
    """Distinct documents in Silver, from whichever frame counted them."""
    sheet.need(sheet.spec.silver, sheet.spec.document)
    source = "keys" if sheet.offers("keys", "silver_documents") else "documents"
    return sheet.number(source, "silver_documents")


def silver_customers(sheet: MetricSheet) -> str:
    sheet.need(sheet.spec.silver, sheet.spec.customer)
    return sheet.number("customers", "silver_customers")


def revenue_gap(sheet: MetricSheet) -> tuple[str, str, str]:
    """Silver revenue, Gold revenue and their distance; NULL counts as nothing."""
    sheet.need(sheet.spec.silver, sheet.spec.revenue)
    silver = f"CAST({sheet.number(sheet.spec.silver, 'revenue')} AS DOUBLE)"
    gold = f"CAST({gold_value(sheet, 'total_revenue')} AS DOUBLE)"
    silver, gold = sheet.derive("silver_sum", silver), sheet.derive("gold_sum", gold)
    return silver, gold, sheet.derive("revenue_gap", f"abs({silver} - {gold})")


def average_order_value(revenue: str, orders: str) -> str:
    """Revenue per order, 0 without orders."""
    return case((f"{orders} = 0", "0D"), otherwise=ratio(revenue, orders))


def _g1(sheet: MetricSheet) -> Check:
    tolerance = sheet.spec.thresholds.revenue_tolerance
    silver, gold, gap = revenue_gap(sheet)
    ok = f"{gap} <= {tolerance}D"
    found = concat(
        text("Gold revenue "), grouped(gold, 2), text(" differs from the Silver sum "),
        grouped(silver, 2), text(" by "), grouped(gap, 2), text("."),
    )
    check = Check(
        "G1", NAMES["G1"], GOLD, pass_or(ok),
        case((ok, text(f"Gold revenue equals the Silver sum within {tolerance} (float drift).")), otherwise=found),
        json_object(gold_revenue=gold, difference=gap, revenue_rounding_tolerance=f"{tolerance}D"),
        json_object(silver_revenue=silver), gap,
        f"SELECT SUM({sheet.spec.revenue}) FROM {sheet.spec.silver}",
        extra={"revenue_rounding_tolerance": f"{tolerance}D"},
    )
    return guarded(one_gold_row(sheet, check), no_gold_row(sheet), EMPTY_GOLD)


def _count_check(check_id: str, gold_column: str, fresh, column: str, what: str):
    def build(sheet: MetricSheet) -> Check:
        expected = f"CAST({fresh(sheet)} AS BIGINT)"
        stored = f"CAST({gold_value(sheet, gold_column)} AS BIGINT)"
        ok = f"{stored} = {expected}"
        found = concat(
            text(f"Gold {gold_column} is "), grouped(stored), text(", Silver has "),
            grouped(expected), text(f" distinct {what}."),
        )
        check = Check(
            check_id, NAMES[check_id], GOLD, pass_or(ok),
            case((ok, text(f"Gold {gold_column} equals the distinct {what} of Silver.")), otherwise=found),
            json_number(stored), json_number(expected), stored,
            f"SELECT COUNT(DISTINCT {getattr(sheet.spec, column)}) FROM {sheet.spec.silver}",
        )
        return guarded(one_gold_row(sheet, check), no_gold_row(sheet), EMPTY_GOLD)

    return build


def _g4(sheet: MetricSheet) -> Check:
    spec = sheet.spec
    stored = f"CAST({gold_value(sheet, 'average_order_value')} AS DOUBLE)"
    orders = f"CAST({gold_value(sheet, 'total_orders')} AS DOUBLE)"
    sheet.need(spec.gold, "total_revenue")
    revenue = sheet.metric(spec.gold, "total_revenue")
    fresh = sheet.derive("order_value", average_order_value(revenue, orders))
    ok = f"coalesce(abs({fresh} - {stored}) <= {spec.thresholds.order_value_tolerance}D, false)"
    good = concat(text("Average order value agrees with revenue per order, "), grouped(fresh, 2), text("."))
    found = concat(
        text("Average order value "), grouped(stored, 2), text(" should be "), grouped(fresh, 2), text(".")
    )
    check = Check(
        "G4", NAMES["G4"], GOLD, pass_or(ok), case((ok, good), otherwise=found),
        json_number(stored), json_number(f"round({fresh}, 2)"), stored,
        f"SELECT total_revenue / total_orders FROM {spec.gold}",
    )
    # Revenue without a value cannot be divided: the check has no answer then.
    unusable = f"({no_gold_row(sheet)}) OR ({fresh}) IS NULL"
    return guarded(one_gold_row(sheet, check), unusable, "Gold revenue is NULL or the Gold table holds no row")


def revenue_status(
    gold: str, gap: str, mean: str, std: str, upstream: str, spec: PipelineSpec
) -> str:
    """Status of revenue against its learned band, given the upstream layer status."""
    low, high = tolerance_band(mean, std, spec.thresholds.sigma_pass)
    blamed = f"{gold} < {low} AND {upstream} IN ('{FAIL}', '{IMPACTED}', '{WARN}')"
    return case(
        (f"NOT coalesce({std} > 0, false)", text(WARN)),
        (between(gold, low, high), text(PASS)),
        (f"{gap} > {spec.thresholds.revenue_tolerance}D", text(FAIL)),
        (blamed, text(IMPACTED)),
        otherwise=text(WARN),
    )


def _g5(upstream: str):
    def build(sheet: MetricSheet) -> Check:
        spec = sheet.spec
        _, gold, gap = revenue_gap(sheet)
        sql = f"SELECT total_revenue FROM {spec.gold}"
        unknown = text("There is no revenue history to compare with.")
        no_baseline = json_string(text("no baseline available"))
        history = learned(sheet, "gold_revenue")
        if not history:
            check = Check("G5", NAMES["G5"], GOLD, text(WARN), unknown, json_number(gold), no_baseline, gold, sql)
            return guarded(one_gold_row(sheet, check), no_gold_row(sheet), EMPTY_GOLD)
        mean, std, usable = history
        low, _ = tolerance_band(mean, std, spec.thresholds.sigma_pass)
        status = revenue_status(gold, gap, mean, std, upstream, spec)
        shortfall = f"({mean} - {gold})"
        detail = case(
            (f"NOT {usable}", unknown),
            (f"{status} = '{PASS}'", text("Gold revenue is inside the learned range.")),
            (f"{status} = '{FAIL}'", text("Gold revenue is off its baseline and does not agree with Silver.")),
            (f"{status} = '{IMPACTED}'",
             concat(text("Gold agrees with Silver but revenue is "), grouped(shortfall),
                    text(" below baseline because of an upstream layer."))),
            (f"{gold} < {low}",
             concat(text("Revenue is "), grouped(shortfall),
                    text(" below baseline with healthy upstream layers; review the business."))),
            otherwise=text("Gold revenue is above its learned range."),
        )
        check = Check(
            "G5", NAMES["G5"], GOLD, status, detail, json_number(gold),
            case((usable, json_number(f"round({mean}, 0)")), otherwise=no_baseline), gold, sql,
            extra={
                "expected_revenue": f"round({mean}, 0)",
                "actual_revenue": gold,
                "impact": f"round({shortfall}, 0)",
                "gold_math_correct": f"{gap} <= {spec.thresholds.revenue_tolerance}D",
            },
        )
        return guarded(one_gold_row(sheet, check), no_gold_row(sheet), EMPTY_GOLD)

    return build


def _g6(sheet: MetricSheet) -> Check:
    spec = sheet.spec
    if not sheet.has_table(spec.gold_country):
        absent = json_string(text("n/a"))
        return Check(
            "G6", NAMES["G6"], GOLD, text(WARN), text(f"No {spec.gold_country} table to reconcile."),
            absent, absent,
        )
    off = sheet.number("country", "country_mismatches")
    return Check(
        "G6", NAMES["G6"], GOLD, pass_or(f"{off} = 0"),
        amount(off, "Revenue agrees with Silver in every country.", " countries have a different revenue in Silver."),
        json_number(off), "'0'", off,
        f"SELECT {spec.country}, SUM({spec.revenue}) FROM {spec.silver} GROUP BY {spec.country}",
    )


def validate_gold(sheet: MetricSheet, upstream: str) -> list[Check]:
    """G1-G6; ``upstream`` is SQL text of the Silver layer status of the same pipeline."""
    builders = {
        "G1": _g1,
        "G2": _count_check("G2", "total_orders", silver_documents, "document", "documents"),
        "G3": _count_check("G3", "total_customers", silver_customers, "customer", "customers"),
        "G4": _g4,
        "G5": _g5(upstream),
        "G6": _g6,
    }
    return run_checks(sheet, [Rule(i, NAMES[i], GOLD, b) for i, b in builders.items()])
