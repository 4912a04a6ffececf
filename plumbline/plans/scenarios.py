"""Validation of many versions of Silver, Gold and other tables against one Bronze, as one run.

What only differs by a change is counted together (``operators/versions.py``); tables that are the same
in every scenario are scanned once and serve all of them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.sql import text
from plumbline.model import PIPELINE
from plumbline.operators import versions as v
from plumbline.operators.gold import average_order_value
from plumbline.operators.versions import Change, Versions
from plumbline.plans.lineage import cut_lineage
from plumbline.plans.metrics import MetricSheet, collect_metrics, fk_state
from plumbline.plans.run import ValidationRun, run_of
from plumbline.specs import PipelineSpec, ticked


@dataclass(frozen=True)
class Scenario:
    """Changes by table; ``gold_of`` names the scenario whose Gold this one shows, if not its own."""

    changes: Mapping[str, Change] = field(default_factory=dict)
    gold_of: str | None = None


def _stored(scenarios: Mapping[str, Scenario]) -> dict[str, Scenario]:
    """The scenarios with their added rows stored, so that every count reads those rows, not what chose them."""
    kept: dict[int, DataFrame] = {}

    def stored(change: Change) -> Change:
        if change.added is None:
            return change
        if id(change.added) not in kept:
            kept[id(change.added)] = cut_lineage(change.added)
        return replace(change, added=kept[id(change.added)])

    return {
        case: replace(s, changes={name: stored(change) for name, change in s.changes.items()})
        for case, s in scenarios.items()
    }


def _versioned(layers: Mapping[str, DataFrame], scenarios: Mapping[str, Scenario], name: str) -> Versions:
    return Versions(layers[name], {case: s.changes.get(name, Change()) for case, s in scenarios.items()})


def scenario_sheet(
    layers: Mapping[str, DataFrame], scenarios: Mapping[str, Scenario], spec: PipelineSpec | None = None
) -> MetricSheet:
    """The metric sheet with one row per scenario. Stores added rows and Silver's totals, from which Gold is made.

    ``layers`` are the stored tables without a ``pipeline`` column; Gold is built anew for every scenario.
    Bronze and the source can't be changed, and Gold by country isn't built. A scenario that leaves no row
    of a table keeps its row of metrics, with zero rows.
    """
    spec = spec or PipelineSpec()
    tables = dict.fromkeys([spec.silver, *(t for s in scenarios.values() for t in s.changes)])
    fixed = {spec.bronze, spec.source, spec.gold, spec.history} & set(tables)
    if fixed:
        raise ValueError(f"scenarios can't change {sorted(fixed)}")
    grouped = [name for name, df in layers.items() if PIPELINE in df.columns]
    if grouped:
        raise ValueError(f"scenarios take the place of pipelines, which {grouped} already have")
    scenarios = _stored(scenarios)
    changed = {name: _versioned(layers, scenarios, name) for name in tables if name in layers}
    # Only the columns of these count: their frames are replaced below.
    gold = layers[spec.silver].selectExpr(
        "'' AS pipeline", "0D AS total_revenue", "0L AS total_orders", "0L AS total_customers", "0D AS average_order_value"
    )
    planned = {n: df for n, df in layers.items() if n not in (spec.gold, spec.gold_country)} | {spec.gold: gold}
    planned |= {name: df.base.withColumn(PIPELINE, F.lit("")) for name, df in changed.items()}
    sheet = collect_metrics(planned, spec, two_pass_rows=True)

    def put(name: str, build) -> None:
        sheet.frames.pop(name, None)
        sheet.shared.discard(name)
        sheet.add(name, build)

    for name, table in changed.items():
        # Fused metrics carry the name of their table already, and are planned as such.
        metrics = sheet.fused[name][1]
        put(name, lambda t=table, m=metrics: v.profile(t, m))
        del sheet.fused[name]
        put(f"{name}_row", lambda t=table: v.full_row_duplicates(t))
        if f"{name}_pk" in sheet.frames:
            key = next(t.primary_key for t in spec.tables if t.name == name)
            put(f"{name}_pk", lambda t=table, k=key: v.duplicate_excess(t, k))
    for child in spec.tables:
        for fk in child.foreign_keys:
            both = {child.name, fk.ref_table}
            if not both & set(changed) or not both <= set(layers) or fk_state(layers, child.name, fk):
                continue
            sides = [changed.get(t) or _versioned(layers, scenarios, t) for t in (child.name, fk.ref_table)]
            put(fk.frame(child.name), lambda f=fk, s=sides: v.fk_orphans(s[0], f.column, s[1], f.ref_column))
    silver = changed[spec.silver]
    put("keys", lambda: v.key_census(layers[spec.bronze], silver, spec))
    put("customers", lambda: v.distinct_count(silver, spec.customer, "silver_customers"))

    # Gold needs Silver's totals; they are stored so that they are counted once.
    names = [spec.silver, "keys", "customers"]
    stored = cut_lineage(sheet._folded([sheet.frames.pop(n) for n in names], PIPELINE))
    sheet.frames["silver_totals"] = stored
    metrics = sheet.fused[spec.gold][1]
    put(spec.gold, lambda: _gold(stored, scenarios, spec).groupBy(PIPELINE).agg(
        *[F.expr(f"{sql} AS {ticked(n)}") for n, sql in metrics.items()]
    ))
    del sheet.fused[spec.gold]
    put(f"{spec.gold}_row", lambda: stored.select(PIPELINE, F.lit(0).cast("long").alias("excess")))
    return sheet


def _gold(totals: DataFrame, scenarios: Mapping[str, Scenario], spec: PipelineSpec) -> DataFrame:
    """Gold of every scenario: what ``build_gold_metrics`` makes of its Silver, from totals already counted."""
    pairs = [f"struct({text(c)} AS _shown, {text(s.gold_of or c)} AS {PIPELINE})" for c, s in scenarios.items()]
    shown = totals.sparkSession.range(1).selectExpr(f"inline(array({', '.join(pairs)}))")
    built = totals.selectExpr(
        PIPELINE, f"`{spec.silver}__revenue` AS total_revenue", "coalesce(keys__silver_documents, 0L) AS total_orders",
        "coalesce(customers__silver_customers, 0L) AS total_customers",
    )
    rows = built.join(F.broadcast(shown), PIPELINE).withColumn(PIPELINE, F.col("_shown")).drop("_shown")
    return rows.withColumn("average_order_value", F.expr(average_order_value("total_revenue", "total_orders")))


def validate_scenarios(
    layers: Mapping[str, DataFrame],
    scenarios: Mapping[str, Scenario],
    spec: PipelineSpec | None = None,
    *,
    run_id: str = "run",
    run_date: dt.date | None = None,
) -> ValidationRun:
    """Run every check for every scenario, whose name takes the place of the pipeline."""
    return run_of(scenario_sheet(layers, scenarios, spec), run_id=run_id, run_date=run_date)
