"""Scalar logic, evaluated by Spark from its SQL text."""

import math

import pytest

from plumbline.functions import sql
from plumbline.functions.stats import (
    classify_robust_anomaly,
    column_stats,
    modified_z_score,
    series_profile,
    tolerance_band,
    unpivot_history,
)
from plumbline.functions.text import sanitize_reason
from plumbline.functions.values import as_date, redact
from plumbline.model import FAIL, IMPACTED, PASS, SKIPPED, WARN
from plumbline.operators.analytics import caught_by
from plumbline.operators.gate import gate_tolerance
from plumbline.operators.gold import average_order_value, revenue_status
from plumbline.operators.rollup import action_for, downgrade, first_failed_of, verdict_of
from plumbline.operators.rules import freshness_status, span_status
from plumbline.operators.silver import segment_status, suspected_filter, window_status
from plumbline.specs import PipelineSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPEC = PipelineSpec()


def values(spark, *expressions):
    return list(spark.range(1).selectExpr(*[f"{e} AS c{i}" for i, e in enumerate(expressions)]).head())


def test_severity_ignores_skipped(spark):
    def worst(*statuses):
        return sql.worst_in("array(" + ", ".join(f"'{s}'" for s in statuses) + ")")

    assert values(
        spark, worst(PASS, WARN, SKIPPED), worst(WARN, IMPACTED), worst(IMPACTED, FAIL, PASS), worst(SKIPPED)
    ) == [WARN, IMPACTED, FAIL, PASS]


def test_guarded_arithmetic(spark):
    assert values(
        spark, sql.ratio("1", "0"), sql.percent("1", "0"), sql.drop_percent("0", "5"),
        sql.drop_percent("0", "5", "NULL"), sql.drop_percent("100", "72"),
    ) == [None, 0.0, 0.0, None, pytest.approx(28.0)]


def test_text_escaping(spark):
    odd = 'a "quoted" \\ it\'s'
    assert values(spark, sql.text(odd), f"from_json({sql.json_object(v=sql.text(odd))}, 'v STRING').v") == [odd, odd]
    assert values(spark, sql.json_string(sql.text('say "x" \\ y'))) == ['"say \\"x\\" \\\\ y"']


def test_fallback_window_has_no_pass_at_zero_drop(spark):
    drops = ("0D", "2D", "10D", "-3D", "15D", "15.1D")
    assert values(spark, *[window_status(d, SPEC) for d in drops]) == [WARN, PASS, PASS, WARN, WARN, FAIL]


def test_segment_and_filter(spark):
    assert values(spark, *[segment_status(v, SPEC) for v in ("4.99D", "5D", "50D", "-20D")]) == [PASS, WARN, FAIL, PASS]
    assert "being filtered out" in values(spark, suspected_filter("21D", SPEC))[0]
    assert "unclear" in values(spark, suspected_filter("20D", SPEC))[0]


def test_freshness_limits_are_inclusive(spark):
    def status(day, ahead=0, back=3):
        return freshness_status(f"CAST({day} AS DATE)", "DATE '2026-07-10'", ahead, back)

    assert values(
        spark, status("'2026-07-10'"), status("'2026-07-11'"), status("'2026-07-07'"), status("'2026-07-06'"),
        status("NULL"), status("'2026-07-12'", ahead=2),
    ) == [PASS, FAIL, PASS, WARN, WARN, PASS]
    dates = ("DATE '2026-01-01'", "DATE '2026-01-31'")
    assert values(spark, span_status(*dates, 30), span_status(*dates, 29), span_status("CAST(NULL AS DATE)", "CAST(NULL AS DATE)", 1)) == [PASS, WARN, WARN]


@pytest.mark.parametrize(
    "gold, gap, upstream, expected",
    [
        (1000, 0, FAIL, PASS), (100, 0, FAIL, IMPACTED), (100, 0, WARN, IMPACTED), (100, 0, IMPACTED, IMPACTED),
        (100, 0, PASS, WARN), (100, 5, FAIL, FAIL), (2000, 0, FAIL, WARN),
    ],
)
def test_revenue_against_baseline(spark, gold, gap, upstream, expected):
    status = revenue_status(f"{gold}D", f"{gap}D", "1000D", "7D", f"'{upstream}'", SPEC)
    assert values(spark, status) == [expected]


def test_revenue_without_spread_warns(spark):
    assert values(spark, revenue_status("5D", "0D", "5D", "0D", "'PASS'", SPEC)) == [WARN]


def test_average_order_value(spark):
    assert values(spark, average_order_value("10D", "0"), average_order_value("10D", "4")) == [0.0, 2.5]


@pytest.mark.parametrize(
    "bronze, silver, gold, blame, verdict",
    [
        (PASS, FAIL, IMPACTED, "Bronze → Silver", ("NOT TRUSTED", "HIGH")),
        (FAIL, PASS, PASS, "Source → Bronze", ("NOT TRUSTED", "HIGH")),
        (PASS, PASS, FAIL, "Silver → Gold", ("NOT TRUSTED", "HIGH")),
        (PASS, WARN, IMPACTED, "Bronze → Silver", ("WARNING", "MEDIUM")),
        (PASS, PASS, IMPACTED, None, ("WARNING", "MEDIUM")),
        (PASS, WARN, PASS, None, ("WARNING", "MEDIUM")),
        (PASS, PASS, PASS, None, ("TRUSTED", "LOW")),
    ],
)
def test_blame_and_verdict(spark, bronze, silver, gold, blame, verdict):
    layers = [f"'{s}'" for s in (bronze, silver, gold)]
    assert values(spark, first_failed_of(*layers), *verdict_of(*layers)) == [blame, *verdict]


def test_downgrade_only_touches_trusted(spark):
    assert values(spark, *downgrade("'TRUSTED'", "'LOW'", "2"))[:2] == ["WARNING", "MEDIUM"]
    assert "2 check(s) skipped" in values(spark, *downgrade("'TRUSTED'", "'LOW'", "2"))[2]
    assert values(spark, *downgrade("'TRUSTED'", "'LOW'", "0")) == ["TRUSTED", "LOW", None]
    assert values(spark, *downgrade("'NOT TRUSTED'", "'HIGH'", "2")) == ["NOT TRUSTED", "HIGH", None]


def test_actions(spark):
    def action(verdict, *layers, suspect="CAST(NULL AS STRING)"):
        return action_for(f"'{verdict}'", *[f"'{s}'" for s in layers], suspect)

    found = values(
        spark, action("TRUSTED", PASS, PASS, PASS), action("NOT TRUSTED", FAIL, FAIL, PASS, suspect="'x > 1'"),
        action("NOT TRUSTED", FAIL, PASS, PASS), action("NOT TRUSTED", PASS, PASS, FAIL),
        action("WARNING", PASS, WARN, PASS), action("NOT TRUSTED", PASS, FAIL, PASS),
    )
    for text, word in zip(found, ("No action", "(x > 1)", "Bronze", "Gold aggregation", "Review", "rule and"), strict=True):
        assert word in text


# --- history -------------------------------------------------------------------


def _profile(spark, xs):
    series = spark.createDataFrame([("m", float(x)) for x in xs], "metric string, x double")
    return series_profile(series).head()


def _classify(spark, value, xs):
    p = _profile(spark, xs)
    stats = [f"CAST({v!r} AS DOUBLE)" for v in (p.q1, p.median, p.q3, p.mad)]
    return values(spark, classify_robust_anomaly(f"CAST({value} AS DOUBLE)", str(p.n), *stats))[0]


def test_quartiles_are_interpolated(spark):
    p = _profile(spark, [1, 2, 3, 4])
    assert (p.q1, p.median, p.q3, p.mad, p.mean) == (1.75, 2.5, 3.25, 1.0, 2.5)
    assert p.std == pytest.approx(math.sqrt(1.25))


def test_anomaly_outcomes(spark):
    assert _classify(spark, 100, [100, 100, 100]) == SKIPPED
    assert _classify(spark, 50, [50] * 4) == PASS
    assert _classify(spark, 999, [50] * 4) == WARN
    assert _classify(spark, "NULL", [1, 2, 3, 4]) == SKIPPED
    spread = [10, 11, 12, 13, 14, 15, 16, 17]
    assert _classify(spark, 12, spread) == PASS
    assert _classify(spark, 500, spread) == FAIL
    assert _classify(spark, 22, spread) == WARN


def test_modified_z_at_zero_mad(spark):
    assert values(spark, modified_z_score("7D", "7D", "0D"), modified_z_score("8D", "7D", "0D")) == [0.0, math.inf]


def test_history_drops_nulls_and_nans(spark):
    rows = [(1, 1.0), (2, None), (3, float("nan")), (4, 5.0)]
    frame = spark.createDataFrame(rows, "bronze_count int, drop_pct double")
    stats = {r.metric: r for r in column_stats(unpivot_history(frame, ["bronze_count", "drop_pct"])).collect()}
    assert (stats["drop_pct"].n, stats["drop_pct"].mean, stats["drop_pct"].std) == (2, 3.0, 2.0)
    assert stats["bronze_count"].n == 4
    assert values(spark, *tolerance_band("10D", "2D", 3.0)) == [4.0, 16.0]


# --- dates and text ----------------------------------------------------------------


def test_dates_need_iso_text(spark):
    rows = ["2026-06-17", "2026-6-7", " 2026-06-17 ", "2026", "2026-06-17 xyz", "2026-02-30", "bad", None]
    frame = spark.createDataFrame([(r,) for r in rows], "d string")
    parsed = [r[0] is not None for r in frame.selectExpr(as_date("d", T.StringType())).collect()]
    assert parsed == [True, True, True, False, False, False, False, False]


def test_redaction(spark):
    dirty = "connect  failed Password = hunter2\n token=abc see jdbc://h/db?x now key=1"
    clean = spark.range(1).select(redact(F.lit(dirty))).head()[0]
    assert clean == "connect failed Password=*** token=*** see *** now key=***"
    reason = sanitize_reason(RuntimeError("login refused pwd=abc123\n host=db9"))
    assert reason == "RuntimeError: login refused pwd=*** host=db9"


def test_labels(spark):
    cases = [("'layer_3_robust_anomaly'", "'X'"), ("NULL", "'L1-A'"), ("NULL", "'L2-A'"), ("NULL", "'L3-A'"),
             ("NULL", "'X1'"), ("NULL", "'S8'"), ("NULL", "'Z'")]
    assert values(spark, *[caught_by(f"CAST({d} AS STRING)", c) for d, c in cases]) == [
        "Robust Anomaly", "Rule Library", "Reconciliation", "Robust Anomaly", "Reconciliation", "Rule Library", None,
    ]


def test_gate_tolerance_uses_rounded_sigma(spark):
    assert values(spark, *gate_tolerance("28.0D", "3.81D", "0.032D", "3.71D", "3.91D")) == [False, 755.9]
    assert values(spark, *gate_tolerance("3.91D", "3.81D", "0D", "3.71D", "3.91D")) == [True, 0.0]
