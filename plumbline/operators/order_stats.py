"""Exact quartiles and median deviations of series of any length, in pieces.

``percentile`` holds a whole series in one task. Here equal values are counted first; the counts are
dealt out by ranges of (series, value) and stored, so a series, however long, lies in as many pieces as
its share asks for. From the sizes of the pieces follows which one holds the wanted place of each series,
and only those pieces are numbered. Results are those of ``percentile`` to the last digit.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.lineage import cut_lineage
from plumbline.specs import ticked


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows per series and value: ``by``, ``value`` as DOUBLE, ``n``. NULL and NaN are no values."""
    number = F.col(ticked(value)).cast("double")
    picked = df.select(*[F.col(ticked(c)) for c in by], number.alias("value"))
    picked = picked.where("value IS NOT NULL AND NOT isnan(value)")
    return picked.groupBy(*[F.col(ticked(c)) for c in by], "value").agg(F.count(F.lit(1)).alias("n"))


def _joined(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner", more: Column | None = None) -> DataFrame:
    """Join on equal names of series, a NULL name included; those of the right side are left out."""
    # Renamed, for both sides may come from one table.
    renamed = right.select(
        *[F.col(ticked(c)).alias(f"_k{k}") for k, c in enumerate(names)], *[F.col(ticked(c)) for c in right.columns if c not in names]
    )
    same = [F.col(ticked(c)).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(names)]
    condition = reduce(lambda a, b: a & b, [*same, *([] if more is None else [more])], F.lit(True))
    return left.join(renamed, condition, how).drop(*[f"_k{k}" for k in range(len(names))])


def order_statistics(counts: DataFrame, by: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """The value at each share of a series, interpolated between neighbours, and ``n`` values in all.

    ``counts`` as from ``value_counts``; ``shares`` names the result columns.
    """
    keys = [F.col(ticked(c)) for c in by]
    dealt = counts.repartitionByRange(*keys, "value").withColumn("_piece", F.spark_partition_id())
    placed = cut_lineage(dealt)
    sizes = placed.groupBy(*keys, "_piece").agg(F.sum("n").alias("_size"))
    series = Window.partitionBy(*keys)
    so_far = series.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = sizes.select(
        *keys, "_piece", "_size", F.coalesce(F.sum("_size").over(so_far), F.lit(0)).alias("_before"), F.sum("_size").over(series).alias("_total")
    )
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(share).alias("share")) for name, share in shares.items()]))
    place = (F.col("_total") - 1) * F.col("_w.share")
    targets = pieces.withColumn("_w", wanted).withColumn("_place", place)
    targets = targets.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))))
    hits = targets.where("_rank >= _before AND _rank < _before + _size").select(*keys, "_piece", "_before", "_total", "_w.name", "_place", "_rank")

    # Only pieces that hold a wanted place are numbered, each by itself.
    holding = hits.select(*keys, "_piece").distinct()
    mine = [*by, "_piece"]
    read = _joined(placed, holding, mine, "left_semi")
    running = F.sum("n").over(Window.partitionBy(*keys, "_piece").orderBy("value"))
    numbered = read.withColumn("_end", running)
    within = F.col("_rank") - F.col("_before")
    inside = (within < F.col("_end")) & (within >= F.col("_end") - F.col("n"))
    found = _joined(hits, numbered.select(*[F.col(ticked(c)) for c in mine], "value", "n", "_end"), mine, more=inside)
    low, high = F.floor("_place"), F.ceil("_place")
    both = found.groupBy(*keys, "_total", "name", "_place").agg(F.min_by("value", "_rank").alias("_low"), F.max_by("value", "_rank").alias("_high"))
    value = F.when(low == high, F.col("_low")).otherwise((high - F.col("_place")) * F.col("_low") + (F.col("_place") - low) * F.col("_high"))
    picked = [F.max(F.when(F.col("name") == name, value)).alias(name) for name in shares]
    return both.groupBy(*keys).agg(F.max("_total").alias("n"), *picked)


def robust_profile(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per series: n, q1, median, q3 and mad, the median distance from the median."""
    keys = [F.col(ticked(c)) for c in by]
    counts = cut_lineage(value_counts(df, by, value))
    quartiles = cut_lineage(order_statistics(counts, by, {"q1": 0.25, "median": 0.5, "q3": 0.75}))
    # One row per series; what a long series costs here is split by the engine.
    middle = quartiles.select(*keys, F.col("median").alias("_median"))
    away = _joined(counts, middle, by).select(*keys, F.abs(F.col("value") - F.col("_median")).alias("value"), "n")
    away = away.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    mad = order_statistics(away, by, {"mad": 0.5}).drop("n")
    return _joined(quartiles, mad, by).select(*keys, "n", "q1", "median", "q3", "mad")
