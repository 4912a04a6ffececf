"""Rollups over the result table, grouped by (pipeline, run_id).

A result table may hold any number of pipelines and runs; every function here is one
grouped aggregation over it. A group holds one row per check, so lists collected per
group are bounded by the number of checks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.sql import (
    case,
    concat,
    json_string,
    pass_or,
    percent,
    severity,
    status_of,
    text,
    worst_status,
)
from plumbline.model import (
    BRONZE_TO_SILVER,
    CROSS_LAYER,
    FAIL,
    IMPACTED,
    NOT_TRUSTED,
    PASS,
    PIPELINE,
    PIPELINE_LAYERS,
    CHECK_TYPE,
    SILVER,
    SILVER_TO_GOLD,
    SKIPPED,
    SOURCE_TO_BRONZE,
    TRUSTED,
    WARN,
    WARNING,
)

RUN = (PIPELINE, "run_id")

# Members, ids and names of the cross-layer checks.
SOURCE_CHECKS = ("B1", "B3")
TRANSFORM_CHECKS = ("S1", "S8", "S9", "S10")
METRIC_CHECKS = ("G1", "G2", "G3", "G4", "G6")
CROSS_NAMES = {
    "X1": "Source to Bronze Completeness",
    "X2": "Bronze to Silver Transformation Quality",
    "X3": "Silver to Gold Metric Correctness",
    "X4": "First Failed Layer Locator",
}
# Sentences of the report contract.
HIGH_QUANTITY_LOSS = "Valid high-quantity orders were wrongly removed during the Silver transformation."
IMPACT_SUFFIX = " (Gold impacted by upstream Silver failure.)"
RECORD_LOSS = "Valid business records were wrongly removed during the Silver transformation."
NO_FAILURE = "No failing transformation detected."
ACTION_NONE = "No action required. Pipeline output is trustworthy."
ACTION_BRONZE = "Fix ingestion into Bronze and rerun the pipeline."
ACTION_GOLD = "Fix the Gold aggregation logic and recompute metrics."
CAVEAT_START = "Coverage incomplete: "
CAVEAT_END = " check(s) skipped; verdict downgraded from TRUSTED."
ACTION_REVIEW = "Review flagged layers before publishing Gold outputs."


def _list(ids: Sequence[str]) -> str:
    return ", ".join(text(i) for i in ids)


def rollup(ids: Sequence[str]) -> str:
    """Aggregate: worst status among the given check ids; none of them is PASS."""
    return worst_status(case((f"check_id IN ({_list(ids)})", "status")))


def _ordered(condition: str, *fields: str) -> str:
    """Aggregate: rows meeting a condition as structs in report order."""
    row = f"struct(seq, {', '.join(fields)})"
    return f"array_sort(collect_list({row}) FILTER (WHERE {condition}))"


def _only(check_id: str, value: str) -> str:
    """Aggregate: a value of one check."""
    return f"max({value}) FILTER (WHERE check_id = {text(check_id)})"


def _layer(layer: str) -> str:
    """Aggregate: worst status of a layer."""
    return worst_status(case((f"layer = {text(layer)}", "status")))


def _aggregate(results: DataFrame, **columns: str) -> DataFrame:
    return results.groupBy(*RUN).agg(*[F.expr(sql).alias(n) for n, sql in columns.items()])


LAYER_COLUMNS = {layer.lower(): _layer(layer) for layer in PIPELINE_LAYERS}


def layer_statuses(results: DataFrame) -> DataFrame:
    """One row per run with a status column per pipeline layer."""
    return _aggregate(results, **LAYER_COLUMNS)


def layer_status(results: DataFrame) -> DataFrame:
    """One row per run and layer; a layer without results is PASS."""
    return layer_statuses(results).unpivot(list(RUN), list(LAYER_COLUMNS), "layer", "status")


def verdict_of(bronze: str, silver: str, gold: str) -> tuple[str, str]:
    """SQL text: verdict and severity of three layer statuses."""
    worst = status_of(f"greatest({', '.join(severity(s) for s in (bronze, silver, gold))})")
    failed, clean = f"{worst} = '{FAIL}'", f"{worst} = '{PASS}'"
    verdict = case((failed, text(NOT_TRUSTED)), (clean, text(TRUSTED)), otherwise=text(WARNING))
    level = case((failed, "'HIGH'"), (clean, "'LOW'"), otherwise="'MEDIUM'")
    return verdict, level


def first_failed_of(bronze: str, silver: str, gold: str) -> str:
    """SQL text: the transition to blame; a merely impacted Gold points upstream."""
    return case(
        (f"{bronze} = '{FAIL}'", text(SOURCE_TO_BRONZE)),
        (f"{silver} = '{FAIL}'", text(BRONZE_TO_SILVER)),
        (f"{gold} = '{FAIL}'", text(SILVER_TO_GOLD)),
        (f"{gold} = '{IMPACTED}' AND {silver} <> '{PASS}'", text(BRONZE_TO_SILVER)),
    )


def final_verdict(results: DataFrame) -> DataFrame:
    """Verdict from the three layers alone, before any coverage downgrade."""
    verdict, level = verdict_of("bronze", "silver", "gold")
    return layer_statuses(results).selectExpr(
        "*", f"{verdict} AS final_verdict", f"{level} AS severity"
    )


def first_failed_layer(results: DataFrame) -> DataFrame:
    blame = first_failed_of("bronze", "silver", "gold")
    return layer_statuses(results).selectExpr("*", f"{blame} AS first_failed_layer")


def cross_layer_checks(results: DataFrame) -> DataFrame:
    """X1-X4 as result rows."""
    failed = f"check_id IN ({_list(TRANSFORM_CHECKS)}) AND status = '{FAIL}'"
    wide = _aggregate(
        results,
        x1=rollup(SOURCE_CHECKS),
        x2=rollup(TRANSFORM_CHECKS),
        x3=rollup(METRIC_CHECKS),
        b1_detail=_only("B1", "detail"),
        failing=_ordered(failed, "check_id"),
        **LAYER_COLUMNS,
    )
    blame = first_failed_of("bronze", "silver", "gold")
    wide = wide.selectExpr("*", f"{blame} AS blame", "array_join(failing.check_id, ', ') AS listing")
    statuses = {"X1": "x1", "X2": "x2", "X3": "x3", "X4": pass_or("blame IS NULL")}
    details = {
        "X1": f"coalesce(b1_detail, {text('No source comparison was made.')})",
        "X2": case(
            (f"x2 = '{PASS}'", text("The Silver transformation is sound.")),
            otherwise=concat(text("The Silver transformation fails: "), "listing", text(".")),
        ),
        "X3": case(
            (f"x3 = '{PASS}'", text("Gold metrics agree with Silver.")),
            otherwise=text("Gold metrics do not agree with Silver."),
        ),
        "X4": f"coalesce(concat('First failed transition: ', blame, '.'), {text('No layer failed.')})",
    }
    rows = []
    for seq, (check_id, name) in enumerate(CROSS_NAMES.items()):
        status, detail = statuses[check_id], details[check_id]
        observed = json_string("blame" if check_id == "X4" else status)
        known = {
            "check_id": text(check_id),
            "check_name": text(name),
            "layer": text(CROSS_LAYER),
            "status": status,
            "observed": observed,
            "expected": "NULL" if check_id == "X4" else json_string(text(PASS)),
            "detail": detail,
            "evidence_query": "''",
            "detected_status": status,
            "detected_detail": detail,
            "seq": str(seq),
        }
        fields = (
            f"{text(f.name)}, CAST({known.get(f.name, 'NULL')} AS {f.dataType.simpleString()})"
            for f in CHECK_TYPE.fields
        )
        rows.append(f"named_struct({', '.join(fields)})")
    return wide.selectExpr(*RUN, f"inline(array({', '.join(rows)}))")


def coverage(results: DataFrame) -> DataFrame:
    """Counts per status, the skipped checks with reasons, full-coverage flag."""
    skips = _ordered(f"status = '{SKIPPED}'", "layer", "check_id", "detail")
    counts = {
        name: f"count_if(status = '{status}')"
        for name, status in (
            ("passed", PASS),
            ("warned", WARN),
            ("failed", FAIL),
            ("impacted", IMPACTED),
            ("skipped", SKIPPED),
        )
    }
    return _aggregate(
        results,
        total_checks="count(1)",
        **counts,
        skipped_details=(
            f"transform({skips}, r -> named_struct('check_id', r.check_id, 'reason', r.detail))"
        ),
        full_coverage=f"count_if(status = '{SKIPPED}') = 0",
    )


def downgrade(verdict: str, level: str, skipped: str) -> tuple[str, str, str]:
    """SQL text: TRUSTED with skipped checks becomes WARNING; third is the caveat."""
    hit = f"{verdict} = '{TRUSTED}' AND {skipped} > 0"
    caveat = concat(
        text(CAVEAT_START),
        f"CAST({skipped} AS STRING)",
        text(CAVEAT_END),
    )
    return (
        case((hit, text(WARNING)), otherwise=verdict),
        case((hit, "'MEDIUM'"), otherwise=level),
        case((hit, caveat)),
    )


_CAUSE = {
    "_failing": _ordered(f"layer = '{SILVER}' AND status = '{FAIL}'", "check_id", "detail", "evidence_query"),
    "_s8": _only("S8", "status"),
    "_segment": _only("S9", "extra['worst_segment']"),
    "suspected_filter": _only("S10", "extra['suspected_filter']"),
}
_CAUSE_COLUMNS = {
    "summary": case(
        (f"_s8 = '{FAIL}' AND coalesce(contains(_segment, ' > '), false)", text(HIGH_QUANTITY_LOSS)),
        (f"_s8 = '{FAIL}'", text(RECORD_LOSS)),
        ("size(_failing) > 0",
         concat(text("Silver transformation failed checks "), "array_join(_failing.check_id, ', ')", text("."))),
        otherwise=text(NO_FAILURE),
    ),
    "failed_check_ids": "_failing.check_id",
    "suspected_filter": "suspected_filter",
    "evidence": (
        "transform(_failing, r -> named_struct('check_id', r.check_id, 'detail', r.detail, "
        "'evidence_query', r.evidence_query))"
    ),
}


def root_cause(results: DataFrame) -> DataFrame:
    """What failed in Silver (catalogue and detection stack alike) and why."""
    return _aggregate(results, **_CAUSE).selectExpr(
        *RUN, *[f"{sql} AS {name}" for name, sql in _CAUSE_COLUMNS.items()]
    )


def impact_columns(expected: str, actual: str) -> dict[str, str]:
    """SQL text: revenue of valid Bronze rows against Gold; NULL counts as nothing."""
    expected = f"coalesce(CAST({expected} AS DOUBLE), 0D)"
    actual = f"coalesce(CAST({actual} AS DOUBLE), 0D)"
    loss = f"({expected} - {actual})"
    return {
        "expected_revenue": f"round({expected}, 2)",
        "actual_revenue": f"round({actual}, 2)",
        "estimated_loss": f"round({loss}, 2)",
        "loss_percent": f"round({percent(loss, expected)}, 2)",
    }


def action_for(verdict: str, bronze: str, silver: str, gold: str, suspected: str) -> str:
    """SQL text: what to do next, from the downgraded verdict and the layer statuses."""
    fix = concat(
        text("Fix the Silver transformation rule"),
        f"coalesce(concat(' (', {suspected}, ')'), '')",
        text(" and rerun the ETL."),
    )
    return case(
        (f"{verdict} = '{TRUSTED}'", text(ACTION_NONE)),
        (f"{silver} = '{FAIL}'", fix),
        (f"{bronze} = '{FAIL}'", text(ACTION_BRONZE)),
        (f"{gold} = '{FAIL}'", text(ACTION_GOLD)),
        otherwise=text(ACTION_REVIEW),
    )


def downstream_impact(status: str, detail: str, upstream: str) -> tuple[str, str, str]:
    """SQL text: a failed Gold anomaly under a failed Silver layer is impacted, not at fault."""
    hit = f"({upstream} = '{FAIL}' AND {status} = '{FAIL}')"
    note = concat(detail, text(IMPACT_SUFFIX))
    return case((hit, text(IMPACTED)), otherwise=status), case((hit, note), otherwise=detail), hit


def summarize(results: DataFrame) -> DataFrame:
    """Layer statuses, verdict, coverage, blame, cause and action per run.

    Expects the cross-layer rows to be part of ``results``; they count for coverage
    but never for the verdict. The three inputs are grouped alike, so the joins
    between them need no further shuffle.
    """
    layers = layer_statuses(results)
    whole = layers.join(coverage(results), list(RUN)).join(root_cause(results), list(RUN))
    verdict, level = verdict_of("bronze", "silver", "gold")
    whole = whole.selectExpr("*", f"{verdict} AS _verdict", f"{level} AS _level")
    verdict, level, caveat = downgrade("_verdict", "_level", "skipped")
    whole = whole.selectExpr(
        "*",
        f"{verdict} AS final_verdict",
        f"{level} AS severity",
        f"{caveat} AS verdict_caveat",
        f"{first_failed_of('bronze', 'silver', 'gold')} AS first_failed_layer",
    )
    action = action_for("final_verdict", "bronze", "silver", "gold", "suspected_filter")
    return whole.selectExpr("*", f"{action} AS suggested_action").drop("_verdict", "_level")
