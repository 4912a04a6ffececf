"""End to end on the demo data: every published number of the demo run."""

import json

import pytest

from plumbline.plans.report import report_dict
from plumbline.plans.run import validate

from fixtures import GOLDEN_DATE, by_id, demo

# Check ids of the demo report, by section.
BRONZE_IDS = (
    "B1 B2 B3 B4 B5 B6 B7 B8 L1-RAW-COMP-EMPTY L1-RAW-COMP-NULL L1-RAW-VAL-UNIT L1-RAW-VAL-DATE "
    "L1-RAW-UNIQ-PK L1-RAW-UNIQ-FULL L1-RAW-TIME-FRESH L1-RAW-TIME L1-BRO-COMP-EMPTY "
    "L1-BRO-COMP-NULL L1-BRO-COMP-SRC L1-BRO-VAL-UNIT L1-BRO-VAL-DATE L1-BRO-UNIQ-PK "
    "L1-BRO-UNIQ-FULL L1-BRO-TIME-FRESH L1-BRO-TIME L3-ANO-BRONZE"
).split()
SILVER_IDS = (
    "S1 S2 S3 S4 S5 S6 S7 S8 S9 S10 L1-SIL-COMP-EMPTY L1-SIL-COMP-NULL L1-SIL-VAL-QUAN "
    "L1-SIL-VAL-UNIT L1-SIL-VAL-DATE L1-SIL-UNIQ-PK L1-SIL-UNIQ-FULL L1-SIL-CONS-FK-CUST "
    "L1-SIL-TIME-FRESH L1-SIL-TIME L2-REC-COUNT L2-REC-KEY L3-ANO-SILVER L3-ANO-DROP_P"
).split()
GOLD_IDS = (
    "G1 G2 G3 G4 G5 G6 L1-GOL-COMP-EMPTY L1-GOL-COMP-NULL L1-GOL-VAL-TOTA L1-GOL-VAL-TOTA "
    "L1-GOL-VAL-TOTA L1-GOL-UNIQ-FULL L2-REC-REV L2-REC-AGG L3-ANO-GOLD_R"
).split()


@pytest.fixture(scope="module")
def run(spark):
    return validate(demo(spark), run_id="demo", run_date=GOLDEN_DATE)


@pytest.fixture(scope="module")
def report(run):
    return report_dict(run.report, "demo")


def test_verdict_and_layers(report):
    assert report["layer_status"] == {"bronze": "PASS", "silver": "FAIL", "gold": "IMPACTED"}
    assert report["final_verdict"] == "NOT TRUSTED"
    assert report["severity"] == "HIGH"
    assert report["first_failed_layer"] == "Bronze → Silver"


def test_report_has_the_fifteen_keys_in_order(report):
    assert list(report) == [
        "project", "description", "pipeline", "dataset", "run_id", "layer_status", "final_verdict",
        "severity", "first_failed_layer", "root_cause", "business_impact", "suggested_action",
        "coverage", "detection_layers", "checks",
    ]


def test_checks_and_their_order(report):
    found = {k: [c["check_id"] for c in v] for k, v in report["checks"].items()}
    assert found["bronze"] == BRONZE_IDS
    assert found["silver"] == SILVER_IDS
    assert found["gold"] == GOLD_IDS
    assert found["cross_layer"] == ["X1", "X2", "X3", "X4"]
    assert [len(v) for v in report["detection_layers"].values()] == [33, 4, 4]


def test_coverage(report):
    cover = report["coverage"]
    counts = [cover[k] for k in ("total_checks", "passed", "warned", "failed", "impacted", "skipped")]
    assert counts == [69, 56, 0, 10, 2, 1]
    assert [s["check_id"] for s in cover["skipped_details"]] == ["L1-SIL-CONS-FK-CUST"]
    assert cover["full_coverage"] is False and "verdict_caveat" not in cover


def test_root_cause(report):
    cause = report["root_cause"]
    assert cause["failed_check_ids"] == [
        "S1", "S2", "S8", "S9", "S10", "L2-REC-COUNT", "L3-ANO-SILVER", "L3-ANO-DROP_P",
    ]
    assert cause["suspected_filter"] == "quantity > 20 records are being filtered out"
    assert "high-quantity" in cause["summary"]
    assert cause["suspected_filter"] in report["suggested_action"]
    assert [e["check_id"] for e in cause["evidence"]] == cause["failed_check_ids"]


def test_impact(report):
    impact = report["business_impact"]
    assert impact["expected_revenue"] == 101_800_000.0
    assert impact["actual_revenue"] == 97_000_000.0
    assert impact["estimated_loss"] == 4_800_000.0
    assert impact["loss_percent"] == 4.72


def test_observed_values(run):
    rows = by_id(run.results)
    observed = {k: json.loads(v["observed"]) for k, v in rows.items() if v["observed"] is not None}
    assert list(observed["L2-REC-COUNT"].values()) == [100000, 96000, 72000, 24000, 4000, 24000]
    assert observed["S1"] == "28.00%"
    assert json.loads(rows["S1"]["expected"]) == "3.72%-6.80% (mean +/- 3 std)"
    assert json.loads(rows["B2"]["expected"]) == "99775-100225 (mean +/- 3 std)"
    assert observed["S8"] == 24000 and rows["S8"]["extra"]["loss_pct"] == "25.0"
    assert observed["S9"] == [
        {"segment": "quantity > 20", "bronze_valid": 24000, "silver_count": 0, "loss_pct": 100.0},
        {"segment": "quantity <= 20", "bronze_valid": 72000, "silver_count": 72000, "loss_pct": 0.0},
    ]
    assert round(observed["G4"], 4) == 1347.2222
    assert observed["G5"] == 97_000_000.0 and rows["G5"]["status"] == "IMPACTED"
    assert observed["L2-REC-AGG"]["silver"] == {"revenue": 97000000.0, "orders": 72000, "customers": 5000}
    assert observed["L2-REC-AGG"]["mismatched_fields"] == []


@pytest.mark.parametrize(
    "check, z, low, high",
    [
        ("L3-ANO-BRONZE", 0.0, 99840.0, 100160.0),
        ("L3-ANO-SILVER", -38.77, 93267.5, 96279.5),
        ("L3-ANO-DROP_P", 38.45, 3.65, 6.85),
        ("L3-ANO-GOLD_R", -32.38, 1.015e8, 1.021e8),
    ],
)
def test_robust_scores(run, check, z, low, high):
    observed = json.loads(by_id(run.results)[check]["observed"])
    assert observed["modified_z"] == z
    assert observed["iqr_lower"] == pytest.approx(low)
    assert observed["iqr_upper"] == pytest.approx(high)
    assert observed["history_count"] == 15


def test_impacted_gold_stays_failed_in_the_detection_section(report):
    detected = report["detection_layers"]["layer_3_robust_anomaly"][3]
    final = report["checks"]["gold"][-1]
    assert detected["check_id"] == final["check_id"] == "L3-ANO-GOLD_R"
    assert (detected["status"], final["status"]) == ("FAIL", "IMPACTED")
