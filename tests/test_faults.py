"""Fault matrix: every planted fault is noticed by the layer meant to notice it."""

import pytest

from fixtures import GOLDEN_DATE, healthy
from plumbline.operators import analytics, faults
from plumbline.plans.run import validate
from plumbline.sources.layers import build_gold_metrics


@pytest.fixture(scope="module")
def results(spark):
    base = healthy(spark, 100)
    silver = base["silver_orders"]

    def case(changed, rebuilt=True, **more):
        gold = build_gold_metrics(changed) if rebuilt else base["gold_metrics"]
        return {**base, "silver_orders": changed, "gold_metrics": gold, **more}

    cases = {
        "healthy": case(silver),
        "row_drop": case(faults.inject_row_drop(silver, 0.3)),
        "duplicates": case(faults.inject_duplicates(silver, ["invoice_no"], 10)),
        "orphans": case(silver, order_payments=faults.inject_orphans(None, base["bronze_orders"])),
        "price": case(faults.inject_price_inflation(silver), rebuilt=False),
        "null_keys": case(faults.inject_null_keys(silver, ["invoice_no"])),
        "quantity": case(faults.inject_scale_quantity(silver)),
    }
    return validate(faults.stack_cases(cases), run_date=GOLDEN_DATE).results


@pytest.mark.parametrize(
    "fault, detection_layer, prefix",
    [
        ("row_drop", "layer_2_reconciliation", "L2-REC-COUNT"),
        ("duplicates", "layer_1_rules", "L1-SIL-UNIQ"),
        ("orphans", "layer_1_rules", "L1-ORD-CONS-FK-BRON"),
        ("price", "layer_2_reconciliation", "L2-REC-REV"),
        ("null_keys", "layer_1_rules", "L1-SIL-COMP-NULL"),
        ("quantity", "layer_3_robust_anomaly", "L3-ANO-GOLD_R"),
    ],
)
def test_fault_is_noticed(results, fault, detection_layer, prefix):
    hits = analytics.flagged_checks(results, detection_layer, check_id_prefix=prefix)
    found = {r["pipeline"] for r in hits.collect()}
    assert fault in found and "healthy" not in found


def test_matrix(results):
    rows = {(r["pipeline"], r["detection_layer"]): r["flagged"] for r in faults.detection_matrix(results).collect()}
    assert len(rows) == 21
    assert rows["healthy", "layer_2_reconciliation"] == 0 and rows["healthy", "layer_3_robust_anomaly"] == 0
    assert rows["row_drop", "layer_2_reconciliation"] >= 1
