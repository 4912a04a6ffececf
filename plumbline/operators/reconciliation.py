"""Reconciliation between layers: lost rows, key sets, revenue, all aggregates."""

from __future__ import annotations

from plumbline.functions.sql import case, concat, grouped, json_object, pass_or, text, total
from plumbline.model import ACCURACY, COMPLETENESS, CONSISTENCY, GOLD, RECONCILIATION, SILVER
from plumbline.operators.check import Check, Rule, guarded, run_checks
from plumbline.operators.gold import (
    EMPTY_GOLD,
    gold_value,
    no_gold_row,
    one_gold_row,
    revenue_gap,
    silver_customers,
    silver_documents,
)
from plumbline.plans.metrics import MetricSheet

# Ids and names of the reconciliation checks.
COUNT_ID, COUNT_NAME = "L2-REC-COUNT", "Count Reconciliation: Unexplained Valid Row Loss"
KEY_ID, KEY_NAME = "L2-REC-KEY", "Key-Set Reconciliation: Bronze ⊇ Silver, Silver ⊇ Gold keys"
REVENUE_ID = "L2-REC-REV"
REVENUE_NAME = "Revenue Reconciliation: Silver SUM vs Gold (within rounding tolerance)"
AGGREGATE_ID, AGGREGATE_NAME = "L2-REC-AGG", "Aggregate Cross-Check: Recompute Gold from Silver"


def _count(sheet: MetricSheet) -> Check:
    spec = sheet.spec
    missing = sheet.number("keys", "lost_document_rows")
    explained = sheet.number(spec.bronze, "explained")
    found = concat(
        grouped(missing), text(" valid Bronze rows have no document in Silver; "),
        grouped(explained), text(" further rows were invalid and rightly removed."),
    )
    return Check(
        COUNT_ID, COUNT_NAME, SILVER, pass_or(f"{missing} = 0"),
        case((f"{missing} = 0", text("Every valid Bronze row is accounted for in Silver.")), otherwise=found),
        json_object(
            bronze_total=sheet.number(spec.bronze, "rows"),
            bronze_valid=sheet.number(spec.bronze, "valid_rows"),
            silver_count=sheet.number(spec.silver, "rows"),
            missing_valid=missing,
            explained_removals=explained,
            unexplained_loss=missing,
        ),
        text('{"unexplained_loss":0}'), missing,
        f"SELECT COUNT(*) FROM {spec.bronze} b WHERE {spec.valid_row()} AND NOT EXISTS "
        f"(SELECT 1 FROM {spec.silver} s WHERE s.{spec.document} = b.{spec.document})",
        COMPLETENESS, RECONCILIATION,
    )


def _keys(sheet: MetricSheet) -> Check:
    spec = sheet.spec
    unknown = sheet.number("keys", "silver_rows_unknown")
    distinct = silver_documents(sheet)
    orders = f"CAST({gold_value(sheet, 'total_orders')} AS BIGINT)"
    surplus = f"greatest(0L, {orders} - {distinct})"
    violations = total([unknown, surplus])
    found = concat(
        grouped(unknown), text(" Silver rows have no Bronze document; Gold counts "),
        grouped(surplus), text(" orders more than Silver holds."),
    )
    check = Check(
        KEY_ID, KEY_NAME, SILVER, pass_or(f"{violations} = 0"),
        case((f"{violations} = 0", text("Each layer's keys are contained in the layer before.")), otherwise=found),
        json_object(
            silver_keys_not_in_bronze=unknown,
            silver_distinct_invoices=distinct,
            gold_total_orders=orders,
            gold_excess_over_silver=surplus,
        ),
        text('{"violations":0}'), violations,
        f"SELECT COUNT(*) FROM {spec.silver} s WHERE NOT EXISTS "
        f"(SELECT 1 FROM {spec.bronze} b WHERE b.{spec.document} = s.{spec.document})",
        CONSISTENCY, RECONCILIATION,
    )
    return guarded(check, no_gold_row(sheet), EMPTY_GOLD)


def _revenue(sheet: MetricSheet) -> Check:
    spec, tolerance = sheet.spec, sheet.spec.thresholds.revenue_tolerance
    silver, gold, gap = revenue_gap(sheet)
    ok = f"{gap} <= {tolerance}D"
    found = concat(
        text("Silver revenue "), grouped(silver, 2), text(" and Gold revenue "), grouped(gold, 2),
        text(" differ by "), grouped(gap, 2), text("."),
    )
    check = Check(
        REVENUE_ID, REVENUE_NAME, GOLD, pass_or(ok),
        case((ok, text(f"Silver revenue equals Gold within {tolerance} (float drift).")), otherwise=found),
        json_object(
            silver_revenue=silver, gold_revenue=gold, difference=gap,
            revenue_rounding_tolerance=f"{tolerance}D",
        ),
        json_object(difference=text(f"<= {tolerance}")), gap,
        f"SELECT SUM({spec.revenue}) FROM {spec.silver}",
        ACCURACY, RECONCILIATION, spec.gold,
        extra={"revenue_rounding_tolerance": f"{tolerance}D"},
    )
    return guarded(one_gold_row(sheet, check), no_gold_row(sheet), EMPTY_GOLD)


def mismatched_fields(
    revenue: str, orders: str, customers: str, gold: tuple[str, str, str], tolerance: float
) -> str:
    """Array of the Gold fields that differ from their recomputation."""
    conditions = {
        "total_revenue": f"abs({revenue} - {gold[0]}) > {tolerance}D",
        "total_orders": f"{orders} <> {gold[1]}",
        "total_customers": f"{customers} <> {gold[2]}",
    }
    items = (case((condition, text(name))) for name, condition in conditions.items())
    return f"array_compact(array({', '.join(items)}))"


def _aggregates(sheet: MetricSheet) -> Check:
    spec, tolerance = sheet.spec, sheet.spec.thresholds.revenue_tolerance
    names = ("total_revenue", "total_orders", "total_customers")
    sheet.need(spec.gold, *names)
    fresh = sheet.metric(spec.silver, "revenue")
    orders, customers = silver_documents(sheet), silver_customers(sheet)
    stored = tuple(sheet.metric(spec.gold, n) for n in names)
    wrong = sheet.derive(
        "mismatched", mismatched_fields(fresh, orders, customers, stored, tolerance)
    )
    ok = f"size({wrong}) = 0"
    found = concat(text("Gold differs from Silver in: "), f"array_join({wrong}, ', ')", text("."))
    check = Check(
        AGGREGATE_ID, AGGREGATE_NAME, GOLD, pass_or(ok),
        case((ok, text("All Gold aggregates equal their recomputation from Silver.")), otherwise=found),
        json_object(
            silver=f"named_struct('revenue', {fresh}, 'orders', {orders}, 'customers', {customers})",
            gold=(
                f"named_struct('total_revenue', {stored[0]}, 'total_orders', CAST({stored[1]} AS BIGINT), "
                f"'total_customers', CAST({stored[2]} AS BIGINT))"
            ),
            mismatched_fields=wrong,
        ),
        text('{"mismatched_fields":[]}'), f"size({wrong})",
        f"SELECT SUM({spec.revenue}), COUNT(DISTINCT {spec.document}), "
        f"COUNT(DISTINCT {spec.customer}) FROM {spec.silver}",
        ACCURACY, RECONCILIATION, spec.gold,
    )
    # Unlike the revenue check, a missing sum has no meaning here.
    unusable = " OR ".join(f"{v} IS NULL" for v in (fresh, *stored))
    return guarded(one_gold_row(sheet, check), unusable, "Silver or Gold has no value to compare")


def run_reconciliation_layer(sheet: MetricSheet) -> list[Check]:
    """Only the checks whose two tables exist."""
    rules: list[Rule] = []
    if sheet.has_table(sheet.spec.bronze) and sheet.has_table(sheet.spec.silver):
        rules += [
            Rule(COUNT_ID, COUNT_NAME, SILVER, _count, RECONCILIATION),
            Rule(KEY_ID, KEY_NAME, SILVER, _keys, RECONCILIATION),
        ]
    if sheet.has_table(sheet.spec.silver) and sheet.has_table(sheet.spec.gold):
        rules += [
            Rule(REVENUE_ID, REVENUE_NAME, GOLD, _revenue, RECONCILIATION),
            Rule(AGGREGATE_ID, AGGREGATE_NAME, GOLD, _aggregates, RECONCILIATION),
        ]
    return run_checks(sheet, rules)
