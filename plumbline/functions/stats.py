"""Baselines learned from run history: moments, Tukey fences, MAD scores.

A series is one (group, metric) pair and holds one value per past run, so a series
is bounded by the number of runs, not by the size of the checked tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.sql import between, case, pass_or, ratio, text
from plumbline.model import FAIL, PASS, SKIPPED, WARN
from plumbline.specs import Thresholds


def unpivot_history(
    history: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """One row per (group, metric, past run); NULL and NaN values are dropped."""
    wide = history.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics])
    long = wide.unpivot(list(by), list(metrics), "metric", "x")
    return long.filter(F.col("x").isNotNull() & ~F.isnan("x"))


def column_stats(series: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Mean, population standard deviation and count of each series."""
    return series.groupBy(*by).agg(
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("std"),
        F.count("x").alias("n"),
    )


def tolerance_band(mean: str, std: str, k: float = 3.0) -> tuple[str, str]:
    """SQL text of mean - k*std and mean + k*std."""
    return f"({mean} - {k}D * {std})", f"({mean} + {k}D * {std})"


def series_profile(series: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Moments, exact quartiles and MAD of each series in a single shuffle.

    The median is taken over a window partitioned like the following groupBy, so the
    deviation median reuses the same exchange.
    """
    whole = Window.partitionBy(*by)
    centred = series.withColumn("median", F.percentile("x", F.lit(0.5)).over(whole))
    quartiles = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    profile = centred.groupBy(*by).agg(
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("std"),
        F.count("x").alias("n"),
        quartiles.alias("q"),
        F.percentile(F.abs(F.col("x") - F.col("median")), F.lit(0.5)).alias("mad"),
    )
    return profile.select(
        *by,
        "mean",
        "std",
        "n",
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
        "mad",
    )


def robust_iqr_band(
    q1: str, q3: str, limits: Thresholds = Thresholds()
) -> tuple[str, str, str]:
    """SQL text of the interquartile range and the two Tukey fences."""
    iqr = f"({q3} - {q1})"
    reach = f"{iqr} * {limits.fence_factor}D"
    return iqr, f"({q1} - {reach})", f"({q3} + {reach})"


def modified_z_score(
    value: str, median: str, mad: str, limits: Thresholds = Thresholds()
) -> str:
    """SQL text: scaled distance from the median in MADs; 0 or infinity at MAD 0."""
    spread = ratio(f"{limits.z_scale}D * ({value} - {median})", mad)
    flat = case((f"{value} = {median}", "0D"), otherwise="CAST('Infinity' AS DOUBLE)")
    return case((f"{mad} = 0", flat), otherwise=spread)


def classify_robust_anomaly(
    value: str, n: str, q1: str, median: str, q3: str, mad: str, limits: Thresholds = Thresholds()
) -> str:
    """SQL text: status of a value against its history; a constant history never FAILs."""
    iqr, low, high = robust_iqr_band(q1, q3, limits)
    z = modified_z_score(value, median, mad, limits)
    return case(
        (f"{value} IS NULL OR coalesce({n}, 0) < {limits.min_history}", text(SKIPPED)),
        (f"{iqr} = 0 OR {mad} = 0", pass_or(f"{value} = {median}", WARN)),
        (between(value, low, high), text(PASS)),
        (f"abs({z}) > {limits.z_fail}D", text(FAIL)),
        otherwise=text(WARN),
    )
