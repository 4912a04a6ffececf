"""Questions asked of the result store, for any number of pipelines and runs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.sql import case, percent, text
from plumbline.model import (
    ANOMALY,
    BRONZE,
    CROSS_LAYER,
    FAIL,
    GOLD,
    IMPACTED,
    RECONCILIATION,
    RULES,
    SILVER,
    WARN,
)
from plumbline.operators.rollup import RUN, root_cause

# What tells a check from all others of its run.
CHECK = ("table_name", "check_id", "check_name")

FLAGGED = (FAIL, WARN, IMPACTED)

# Section order of a report and labels of the detection layers.
SECTION_ORDER = (BRONZE, SILVER, GOLD, CROSS_LAYER)
LABELS = {RULES: "Rule Library", RECONCILIATION: "Reconciliation", ANOMALY: "Robust Anomaly"}


def _position():
    """Report order of a row: its section, then its place in it."""
    sections = F.array(*map(F.lit, SECTION_ORDER))
    return F.struct(F.array_position(sections, F.col("layer")).alias("section"), F.col("seq"))


def failed_checks(results: DataFrame) -> DataFrame:
    """Flagged checks of each run, each once.

    The short id is for display: its table and column are cut, so it can stand for several
    checks. Table, id and name together tell a check from all others.
    """
    flagged = results.filter(F.col("status").isin(*FLAGGED)).withColumn("position", _position())
    first = Window.partitionBy(*RUN, *CHECK).orderBy("position")
    ranked = flagged.withColumn("_rank", F.row_number().over(first))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def hard_failures(results: DataFrame) -> DataFrame:
    """FAIL and IMPACTED rows, repeated ids included."""
    return results.filter(F.col("status").isin(FAIL, IMPACTED))


def top_failures(results: DataFrame, n: int | None = 12) -> DataFrame:
    """The first n failed checks of each run, in report order; None means all."""
    order = Window.partitionBy(*RUN).orderBy("position")
    ranked = failed_checks(results).withColumn("rank", F.row_number().over(order))
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def caught_by(detection_layer: str = "detection_layer", check_id: str = "check_id") -> str:
    """SQL text: who caught a check, from its detection layer or else its id prefix."""
    rules, reconciliation, anomaly = (text(LABELS[k]) for k in (RULES, RECONCILIATION, ANOMALY))
    by_layer = [(f"{detection_layer} = {text(k)}", text(v)) for k, v in LABELS.items()]
    by_prefix = [
        (f"{check_id} LIKE 'L1-%'", rules),
        (f"{check_id} LIKE 'L2-%' OR {check_id} LIKE 'X%'", reconciliation),
        (f"{check_id} LIKE 'L3-%'", anomaly),
        (f"substring({check_id}, 1, 1) IN ('B', 'S', 'G')", rules),
    ]
    return case(*by_layer, *by_prefix)


def with_caught_by(results: DataFrame) -> DataFrame:
    return results.withColumn("caught_by", F.expr(caught_by()))


def evidence_for_check(results: DataFrame) -> DataFrame:
    """Evidence SQL of every failed check: its own, else that of the root cause."""
    failed = failed_checks(results)
    cause = root_cause(results).select(*RUN, F.inline("evidence"))
    # The first entry of an id, as a cause carries no table.
    cause = cause.groupBy(*RUN, "check_id").agg(
        F.first("evidence_query").alias("_sql"), F.first("detail").alias("_detail")
    )
    own = F.nullif(F.col("evidence_query"), F.lit(""))
    return (
        failed.join(cause, [*RUN, "check_id"], "left")
        .withColumn("detail", F.when(own.isNotNull(), F.col("detail")).otherwise(F.coalesce("_detail", "detail")))
        .withColumn("evidence_query", F.coalesce(own, F.col("_sql"), F.lit("")))
        .drop("_sql", "_detail")
    )


def layer_metrics(results: DataFrame) -> DataFrame:
    """Row count and drop per layer, read off the stored checks.

    The Gold drop compares its orders with the rows of Silver; Bronze is the baseline.
    """

    def value(check_id: str) -> str:
        return f"max(observed_value) FILTER (WHERE check_id = '{check_id}')"

    reconciled = (
        "max(CAST(get_json_object(observed, '$.gold.total_orders') AS DOUBLE)) "
        "FILTER (WHERE check_id LIKE 'L2-REC-AGG%')"
    )
    wide = results.groupBy(*RUN).agg(
        F.expr(f"coalesce({value('B1')}, {value('L1-BRO-COMP-EMPTY')})").alias("bronze"),
        F.expr(value("L1-SIL-COMP-EMPTY")).alias("silver"),
        # Without its own check the orders of Gold are read off the aggregate reconciliation.
        F.expr(f"coalesce({value('G2')}, {reconciled})").alias("gold"),
        F.expr(value("S1")).alias("silver_drop"),
    )
    gold_drop = case(
        ("silver = 0", "0D"), ("gold IS NOT NULL AND silver IS NOT NULL", f"100D - {percent('gold', 'silver')}")
    )
    rows = ", ".join(
        f"named_struct('layer', '{name}', 'row_count', CAST({name} AS BIGINT), 'drop_pct', {drop})"
        for name, drop in (
            ("bronze", "CAST(NULL AS DOUBLE)"), ("silver", "silver_drop"), ("gold", gold_drop)
        )
    )
    return wide.selectExpr(*RUN, f"inline(array({rows}))")


def flagged_checks(
    results: DataFrame,
    detection_layer: str | None = None,
    dimension: str | None = None,
    check_id_prefix: str | None = None,
) -> DataFrame:
    """Flagged detection results that agree with everything that is asked for."""
    asked = {
        "detected_status IN ('" + "', '".join(FLAGGED) + "')": True,
        "detection_layer IS NOT NULL": True,
        f"detection_layer = {text(detection_layer)}": detection_layer,
        f"dimension = {text(dimension)}": dimension,
        f"startswith(check_id, {text(check_id_prefix)})": check_id_prefix,
    }
    return results.where(" AND ".join(f"({condition})" for condition, given in asked.items() if given))
