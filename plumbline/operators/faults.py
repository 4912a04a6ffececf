"""Fault injection: planted defects that the detection stack must notice.

Each function takes and returns DataFrames. Where rows are chosen, ``selection`` finds out from
counts which; it runs a few small jobs when the function is called, and neither sorts a table nor
collects rows. A ``..._change`` is the same fault as a change of a stored table, so that many faults are
validated together without a copy of the table for each (``plans/scenarios.py``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.model import PIPELINE
from plumbline.operators.selection import Selection, by_columns, first_rows, hash_numbers
from plumbline.operators.versions import Change
from plumbline.specs import PipelineSpec, quoted


def inject_row_drop(df: DataFrame, fraction: float = 0.25, seed: int = 42) -> DataFrame:
    """Keep exactly max(1, int(n * (1 - fraction))) rows, chosen pseudo-randomly by what they hold.

    The same rows stay however they are spread over files and partitions. ``df`` should read a
    stored table, which is scanned three times.
    """
    return first_rows(df, None, hash_numbers(df, seed), share=1 - fraction).rows()


def _first(df: DataFrame, order: Sequence[str], n: int) -> Selection:
    """The first n rows; rows that the order leaves equal are taken by their hash."""
    return first_rows(df, n, by_columns(df, order))


def inject_duplicates(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """Append a copy of the first n rows."""
    return df.unionByName(_first(df, order, n).rows())


def row_drop_change(df: DataFrame, fraction: float = 0.25, seed: int = 42) -> Change:
    """``inject_row_drop`` as a change of the table."""
    kept = first_rows(df, None, hash_numbers(df, seed), share=1 - fraction)
    return Change(kept.condition(), added=kept.some())


def duplicates_change(df: DataFrame, order: Sequence[str], n: int = 10) -> Change:
    """``inject_duplicates`` as a change of the table."""
    return Change(added=_first(df, order, n).rows())


def inject_orphans(
    child: DataFrame | None,
    template: DataFrame,
    document: str = "invoice_no",
    key: str = "INV999999",
) -> DataFrame:
    """A payments table with one row whose reference has no target."""
    spark = template.sparkSession
    dtype = template.schema[document].dataType.simpleString()
    orphan = spark.range(1).select(
        F.lit("PAY000001").alias("payment_id"),
        F.lit(key).cast(dtype).alias(document),
        F.lit(500.0).alias("amount"),
    )
    return orphan if child is None else child.unionByName(orphan, allowMissingColumns=True)


def orphans_change(template: DataFrame, like: DataFrame, key: str = "INV999999") -> Change:
    """``inject_orphans`` as a change of the payments ``like`` whose document is one of ``template``."""
    orphan = inject_orphans(like.limit(0), template, key=key)
    return Change(added=orphan.select(*like.columns))


def _revalued(df: DataFrame, spec: PipelineSpec) -> DataFrame:
    return df.withColumn(spec.revenue, F.col(spec.quantity) * F.col(spec.price))


def inject_price_inflation(
    df: DataFrame, factor: float = 2.0, spec: PipelineSpec | None = None
) -> DataFrame:
    """Scale prices and revenue; leave Gold as it is to model a stale Gold."""
    spec = spec or PipelineSpec()
    return _revalued(df.withColumn(spec.price, F.col(spec.price) * F.lit(factor)), spec)


def inject_scale_quantity(
    df: DataFrame, factor: float = 2.0, spec: PipelineSpec | None = None
) -> DataFrame:
    """Scale quantities, truncated to whole units, and revenue; rebuild Gold after."""
    spec = spec or PipelineSpec()
    scaled = (F.col(spec.quantity) * F.lit(factor)).cast("long")
    dtype = df.schema[spec.quantity].dataType
    return _revalued(df.withColumn(spec.quantity, scaled.cast(dtype)), spec)


def price_change(factor: float = 2.0, spec: PipelineSpec | None = None) -> Change:
    """``inject_price_inflation`` as a change of the table."""
    spec = spec or PipelineSpec()
    price = f"{quoted(spec.price)} * {float(factor)!r}D"
    return Change(values={spec.price: price, spec.revenue: f"{quoted(spec.quantity)} * ({price})"})


def quantity_change(df: DataFrame, factor: float = 2.0, spec: PipelineSpec | None = None) -> Change:
    """``inject_scale_quantity`` as a change of the table."""
    spec = spec or PipelineSpec()
    kind = df.schema[spec.quantity].dataType.simpleString()
    scaled = f"CAST(CAST({quoted(spec.quantity)} * {float(factor)!r}D AS BIGINT) AS {kind})"
    return Change(values={spec.quantity: scaled, spec.revenue: f"{scaled} * {quoted(spec.price)}"})


def null_keys_change(df: DataFrame, order: Sequence[str], n: int = 5, column: str = "invoice_no") -> Change:
    """``inject_null_keys`` as a change of the table."""
    picked = _first(df, order, n)
    touched = f"({picked.inside}) OR ({picked.edge})" if picked.quota else picked.inside
    added = _blanked(picked.rows(), column)
    rest = picked.some(others=True)
    return Change(f"NOT ({touched})", added=added if rest is None else added.unionByName(rest))


def inject_null_keys(
    df: DataFrame, order: Sequence[str], n: int = 5, column: str = "invoice_no"
) -> DataFrame:
    """Blank the key of the first n rows."""
    picked = _first(df, order, n)
    return picked.others().unionByName(_blanked(picked.rows(), column))


def _blanked(df: DataFrame, column: str) -> DataFrame:
    blank = F.lit(None).cast(df.schema[column].dataType).alias(column)
    return df.select(*[blank if c == column else F.col(quoted(c)) for c in df.columns])


def stack(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Versions of one table, by case, as one table with the case as its pipeline."""
    tagged = [df.withColumn(PIPELINE, F.lit(case)) for case, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def spread(df: DataFrame, cases: Sequence[str]) -> DataFrame:
    """The same rows for every case, from one scan."""
    return df.withColumn(PIPELINE, F.explode(F.array(*map(F.lit, cases))))


def stack_cases(cases: Mapping[str, Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """Layer sets of several cases as one set; validated, they are one job."""
    tables = dict.fromkeys(t for layers in cases.values() for t in layers)
    return {
        table: stack({case: layers[table] for case, layers in cases.items() if table in layers})
        for table in tables
    }


def detection_matrix(results: DataFrame) -> DataFrame:
    """How many checks of each detection layer flagged each case.

    With the cases stacked as pipelines, all of them are validated in one job.
    """
    flagged = F.col("detected_status").isin("FAIL", "WARN", "IMPACTED")
    return (
        results.filter(F.col("detection_layer").isNotNull())
        .groupBy(PIPELINE, "detection_layer")
        .agg(F.count_if(flagged).alias("flagged"), F.count(F.lit(1)).alias("checks"))
    )
