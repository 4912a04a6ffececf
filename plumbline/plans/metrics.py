"""The metric sheet: everything the checks need to know, one row per pipeline.

Row-touching work is a handful of aggregations over the layer tables. Their one-row
(per pipeline) outputs are unioned and folded into one wide row, so a full validation
is a single Spark job whose branches run side by side, with no join between them.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import series_profile, unpivot_history
from plumbline.functions.text import sanitize_reason
from plumbline.model import DEFAULT_PIPELINE, PIPELINE
from plumbline.operators import keys, profile
from plumbline.operators.isolation import isolate, outcomes
from plumbline.plans.lineage import cut_lineage
from plumbline.specs import PipelineSpec, TableSpec, ticked

log = logging.getLogger("plumbline.metrics")

# Metrics scored against run history: fixed values, in report order.
HISTORY_METRICS = ("bronze_count", "silver_count", "drop_pct", "gold_revenue")


class MissingInput(LookupError):
    """A check needs a table, column or metric that is not available."""


@dataclass
class MetricSheet:
    """Wide metric row per pipeline, plus what is known about its origin."""

    layers: Mapping[str, DataFrame]
    spec: PipelineSpec
    by: tuple[str, ...]
    pipeline: str
    # Frame name -> one-row-per-pipeline DataFrame with columns "<source>__<metric>".
    frames: dict[str, DataFrame] = field(default_factory=dict)
    # Table -> census metric that already counts its primary-key duplicates.
    document_excess: dict[str, str] = field(default_factory=dict)
    # Source -> source with the same input, whose metrics stand for both.
    twins: dict[str, str] = field(default_factory=dict)
    # Fused profiles by frame name, kept apart so that one bad metric can be left out.
    fused: dict[str, tuple[DataFrame, dict[str, str]]] = field(default_factory=dict)
    # Intermediate columns shared by checks, in dependency order: name -> SQL text.
    derived: dict[str, str] = field(default_factory=dict)
    # Frames of tables without the group column: their one row holds for every pipeline.
    shared: set[str] = field(default_factory=set)
    # Frame or qualified metric -> reason it could not be computed.
    failures: dict[str, str] = field(default_factory=dict)

    def has_table(self, table: str) -> bool:
        return table in self.layers

    def columns(self, table: str) -> list[str]:
        if table not in self.layers:
            raise MissingInput(f"table '{table}' not present")
        return [c for c in self.layers[table].columns if c not in self.by]

    def need(self, table: str, *columns: str) -> None:
        absent = [c for c in columns if c not in self.columns(table)]
        if absent:
            raise MissingInput(f"column(s) {absent} of '{table}' not present")

    def offers(self, source: str, name: str) -> bool:
        wanted = self._qualified(source, name)
        return any(wanted in frame.columns for frame in self.frames.values())

    def metric(self, source: str, name: str) -> str:
        """SQL text of a metric as it stands, NULL when the group has no rows."""
        if not self.offers(source, name):
            origin = self.twins.get(source, source)
            reason = self.failures.get(self._qualified(source, name))
            reason = reason or self.failures.get(origin)
            if reason is None and source in self._roles() and source not in self.layers:
                reason = f"table '{source}' not present"
            raise MissingInput(reason or f"metric '{name}' of '{source}' not available")
        return ticked(self._qualified(source, name))

    def number(self, source: str, name: str) -> str:
        """SQL text of a count or sum; groups without rows read as zero."""
        metric = self.metric(source, name)
        return self.derive(self._qualified(source, name), f"coalesce({metric}, 0)")

    def derive(self, name: str, sql: str) -> str:
        """Name an intermediate result, so that checks repeat a column, not its SQL."""
        known = self.derived.get(f"_{name}", sql)
        if known != sql:
            raise ValueError(f"intermediate result '{name}' is already defined otherwise")
        self.derived[f"_{name}"] = sql
        return ticked(f"_{name}")

    def _roles(self) -> set[str]:
        s = self.spec
        return {s.source, s.bronze, s.silver, s.gold, *(t.name for t in s.tables)}

    def _qualified(self, source: str, name: str) -> str:
        return f"{self.twins.get(source, source)}__{name}"

    def wide(self) -> DataFrame:
        """The folded sheet and its derived columns. Each metric has exactly one frame."""
        own = [frame for name, frame in self.frames.items() if name not in self.shared]
        general = [frame for name, frame in self.frames.items() if name in self.shared]
        if not general:
            folded = self._folded(own, PIPELINE)
        elif not own:
            folded = self._folded(general).withColumn(PIPELINE, F.lit(self.pipeline))
        else:
            # One row, which holds for every pipeline.
            folded = self._folded(own, PIPELINE).join(F.broadcast(self._folded(general)), F.lit(True))
        if not self.derived:
            return folded
        return folded.selectExpr("*", *[f"{sql} AS {ticked(n)}" for n, sql in self.derived.items()])

    @staticmethod
    def _folded(frames: Sequence[DataFrame], *by: str) -> DataFrame:
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        names = [c for c in stacked.columns if c not in by]
        return stacked.groupBy(*by).agg(*[F.expr(f"max({ticked(c)}) AS {ticked(c)}") for c in names])

    def scope(self, *tables: DataFrame) -> tuple[str, ...]:
        """How a frame of these tables is grouped: a table without the group column serves all groups."""
        return tuple(c for c in self.by if all(c in df.columns for df in tables))

    def add(self, name: str, build: Callable[[], DataFrame]) -> None:
        """Plan a frame; if it cannot be resolved its checks become SKIPPED."""
        try:
            frame = build()
            if not set(self.by) <= set(frame.columns):
                self.shared.add(name)
            prefix = "" if name in self.fused else f"{name}__"
            frame = frame.withColumnsRenamed(
                {c: prefix + c for c in frame.columns if c not in self.by}
            )
            self.frames[name] = self._tagged(frame)
        except Exception as error:  # isolation boundary of one frame
            self.failures[name] = sanitize_reason(error)
            log.warning("metrics of %s not planned: %s", name, self.failures[name])
            if name in self.fused:
                self._narrow(name, lambda df: df)

    def _tagged(self, frame: DataFrame) -> DataFrame:
        return frame if self.by else frame.withColumn(PIPELINE, F.lit(self.pipeline))

    def _profiled(self, df: DataFrame, metrics: Mapping[str, str]) -> DataFrame:
        return self._tagged(profile.profile(df, metrics, self.scope(df)))

    def probe(self) -> None:
        """Run the frames side by side and keep what finishes.

        Of a fused profile that fails, halving finds the metrics at fault; the reasons stay known.
        """
        names = list(self.frames)
        tried = outcomes(lambda one: cut_lineage(self.frames[one["frame"]]), [{"frame": n} for n in names])
        for name, (done, error) in zip(names, tried, strict=True):
            if error is None:
                self.frames[name] = done
                continue
            self.failures[name] = error
            log.warning("metrics of %s left out: %s", name, error)
            del self.frames[name]
            if name in self.fused:
                self._narrow(name, cut_lineage)

    def _narrow(self, name: str, run: Callable[[DataFrame], DataFrame]) -> None:
        """Replace a fused profile that fails by the groups of its metrics that work."""
        df, metrics = self.fused.pop(name)
        basic = next((m for m, expr in metrics.items() if expr == profile.ROWS), None)
        found = isolate(metrics, lambda part: run(self._profiled(df, part)), basic)
        self.failures.update(found.failures)
        for k, frame in enumerate(found.results):
            part = f"{name}#{k}"
            self.frames[part] = frame
            if name in self.shared:
                self.shared.add(part)
            # What is only planned may still fail when it runs.
            self.fused[part] = (df, {m: metrics[m] for m in frame.columns if m in metrics})


def collect_metrics(
    layers: Mapping[str, DataFrame],
    spec: PipelineSpec,
    pipeline: str = DEFAULT_PIPELINE,
    two_pass_rows: bool = False,
) -> MetricSheet:
    """Plan all metric frames that the given tables allow.

    Starts no job. ``two_pass_rows`` asks for the hash-first count of full-row duplicates.
    """
    grouped = any(PIPELINE in df.columns for df in layers.values())
    by: tuple[str, ...] = (PIPELINE,) if grouped else ()
    sheet = MetricSheet(layers, spec, by, pipeline)
    twin_of = _twin_tables(layers)

    for name, metrics in _fused_metrics(layers, spec, twin_of).items():
        df = layers[name]
        sheet.fused[name] = (df, metrics)
        sheet.add(name, lambda d=df, m=metrics: profile.profile(d, m, sheet.scope(d)))
    for name, build in _key_builders(sheet, twin_of, two_pass_rows).items():
        sheet.add(name, build)
    for table, twin in twin_of.items():
        if table != twin:
            sheet.twins[f"{table}_row"] = f"{twin}_row"
    # Document duplicates of Bronze, Silver and an identical source: see key_census.
    if "keys" in sheet.frames or "keys" in sheet.failures:
        for table in spec.tables:
            if table.primary_key != (spec.document,) or table.name not in layers:
                continue
            if twin_of[table.name] == twin_of[spec.bronze]:
                sheet.document_excess[table.name] = "bronze_document_excess"
            elif twin_of[table.name] == twin_of[spec.silver]:
                sheet.document_excess[table.name] = "silver_document_excess"
    return sheet


def _fused_metrics(
    layers: Mapping[str, DataFrame], spec: PipelineSpec, twin_of: Mapping[str, str]
) -> dict[str, dict[str, str]]:
    """Metrics of one fused aggregation per distinct table; twins share the scan."""
    specs = {t.name: t for t in spec.tables}
    roles = dict.fromkeys([*specs, spec.source, spec.bronze, spec.silver, spec.gold])
    fused: dict[str, dict[str, str]] = {}
    for table in roles:
        if table not in layers:
            continue
        found = _table_metrics(layers[table], specs.get(table), spec, table)
        shared = fused.setdefault(twin_of[table], {})
        shared.update({f"{table}__{name}": expr for name, expr in found.items()})
    return fused


def _key_builders(
    sheet: MetricSheet, twin_of: Mapping[str, str], two_pass_rows: bool
) -> dict[str, Callable[[], DataFrame]]:
    """The aggregations that shuffle on keys, each grouped as far as its tables allow."""
    layers, spec, scope = sheet.layers, sheet.spec, sheet.scope
    out: dict[str, Callable[[], DataFrame]] = {}

    def row_duplicates(df: DataFrame, by: Sequence[str]) -> DataFrame:
        count = keys.full_row_duplicates_two_pass if two_pass_rows else keys.full_row_duplicates
        return count(df, by)

    bronze, silver = layers.get(spec.bronze), layers.get(spec.silver)
    census = bronze is not None and silver is not None

    for table in spec.tables:
        df = layers.get(table.name)
        if df is None:
            continue
        # Document duplicates of these tables come with the key census.
        counted = census and table.primary_key == (spec.document,)
        counted = counted and twin_of[table.name] in (
            twin_of[spec.bronze],
            twin_of[spec.silver],
        )
        if table.primary_key and not counted:
            out[f"{table.name}_pk"] = lambda d=df, k=table.primary_key: (
                keys.duplicate_excess(d, k, scope(d))
            )
        if twin_of[table.name] == table.name:
            out[f"{table.name}_row"] = lambda d=df: row_duplicates(d, scope(d))
        for fk in table.foreign_keys:
            if fk_state(layers, table.name, fk) is None:
                out[fk.frame(table.name)] = lambda d=df, f=fk: keys.fk_orphans(
                    d, f.column, layers[f.ref_table], f.ref_column, scope(d)
                )

    if census:
        out["keys"] = lambda: keys.key_census(bronze, silver, spec, scope(bronze, silver))
    elif bronze is not None:
        out["bronze_keys"] = lambda: keys.duplicate_excess(
            bronze, spec.business_key, scope(bronze), "bronze_key_excess"
        )
    if silver is not None:
        out["customers"] = lambda: keys.distinct_count(
            silver, spec.customer, scope(silver), "silver_customers"
        )
        if not census:
            out["documents"] = lambda: keys.distinct_count(
                silver, spec.document, scope(silver), "silver_documents"
            )
        if spec.gold_country in layers:
            out["country"] = lambda: keys.country_mismatches(
                layers[spec.gold_country], silver, spec, scope(silver, layers[spec.gold_country])
            )
    if spec.history in layers:
        out["history"] = lambda: _history_profile(layers[spec.history], scope(layers[spec.history]))
    return out


def fk_state(layers: Mapping[str, DataFrame], table: str, fk) -> str | None:
    """Why a foreign key cannot be checked, or None."""
    if not fk.ref_table:
        return f"no target configured for column '{fk.column}'; FK check not applicable"
    if fk.ref_table not in layers:
        return f"table '{fk.ref_table}' not present; FK check not applicable"
    if fk.column not in layers[table].columns or fk.ref_column not in layers[fk.ref_table].columns:
        return (
            f"column '{fk.column}' or '{fk.ref_table}.{fk.ref_column}' not present; "
            "FK check not applicable"
        )
    return None


def _table_metrics(
    df: DataFrame, table: TableSpec | None, spec: PipelineSpec, name: str
) -> dict[str, str]:
    metrics = profile.row_count()
    if table is not None:
        metrics.update(profile.rule_metrics(df, table))
    if name == spec.bronze:
        metrics.update(profile.null_counts(df, spec.bronze_mandatory))
        needed = (spec.quantity, spec.price, spec.document, spec.item)
        if all(c in df.columns for c in needed):
            metrics.update(profile.bronze_metrics(spec))
    if name == spec.silver:
        metrics.update(profile.null_counts(df, spec.silver_mandatory))
        metrics.update(profile.silver_metrics(df, spec))
    if name == spec.gold:
        metrics.update(profile.gold_metrics(df))
    return metrics


def _history_profile(history: DataFrame, by: Sequence[str]) -> DataFrame:
    """One wide row of baseline statistics per group; run count included."""
    present = [m for m in HISTORY_METRICS if m in history.columns]
    runs = history.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"))
    if not present:
        return runs
    series = series_profile(unpivot_history(history, present, by), [*by, "metric"])
    stats = ("mean", "std", "n", "q1", "median", "q3", "mad")
    names = [f"{m}_{s}" for m in present for s in stats]
    picked = [
        F.expr(f"max({s}) FILTER (WHERE metric = '{m}') AS {m}_{s}") for m in present for s in stats
    ]
    both = runs.unionByName(series.groupBy(*by).agg(*picked), allowMissingColumns=True)
    return both.groupBy(*by).agg(*[F.expr(f"max({c}) AS {c}") for c in ("runs", *names)])


def _twin_tables(layers: Mapping[str, DataFrame]) -> dict[str, str]:
    """Map each table to the first one with the very same plan.

    A Bronze table landed as an identity copy is the same DataFrame as its source;
    the two are then scanned and shuffled once.
    """
    out: dict[str, str] = {}
    for name, df in layers.items():
        out[name] = next(
            (o for o in out if out[o] == o and layers[o].sameSemantics(df)), name
        )
    return out
