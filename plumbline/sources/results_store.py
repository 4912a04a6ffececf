"""Result store: check results and report documents as Parquet, published run by run.

A write first stores its rows in a folder of its own and then publishes them with one small manifest
file, which appears as a whole or not at all. Readers start from the manifests, so a write that broke
half-way is never seen, a run that is written again replaces itself at the moment it is published, and
questions about runs never touch the stored rows. Which rows are read is settled before they are read:
only the folders of the runs asked for are listed.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.model import PIPELINE

#: One row per attempt, run and pipeline.
MANIFEST = "attempt string, run_id string, pipeline string, run_ts timestamp, rows long, published_at timestamp"


def _folder(path: str, attempt: str) -> str:
    return f"{path.rstrip('/')}/data/attempt={attempt}"


def stage(df: DataFrame, path: str, run_time: dt.datetime | None = None) -> str:
    """Store the rows of a run, or of several; they stay unseen until ``publish``. Returns the attempt."""
    attempt = f"a-{uuid.uuid4().hex}"
    stamp = F.lit(run_time or dt.datetime.now(dt.UTC)).cast("timestamp")
    df.withColumn("run_ts", stamp).write.parquet(_folder(path, attempt))
    return attempt


def publish(spark: SparkSession, path: str, attempt: str) -> None:
    """Make an attempt the current one of its runs. What is counted is what has been stored."""
    stored = spark.read.parquet(_folder(path, attempt))
    manifest = stored.groupBy("run_id", PIPELINE).agg(F.max("run_ts").alias("run_ts"), F.count(F.lit(1)).alias("rows"))
    manifest = manifest.withColumns(
        {"attempt": F.lit(attempt), "published_at": F.lit(dt.datetime.now(dt.UTC)).cast("timestamp")}
    )
    names = [field.split()[0] for field in MANIFEST.split(", ")]
    # One file: readers see all of the manifest or nothing of it.
    manifest.select(*names).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/manifests")


def write_results(results: DataFrame, path: str, run_time: dt.datetime | None = None) -> None:
    """Store and publish the check rows of a run."""
    publish(results.sparkSession, path, stage(results, path, run_time))


def write_report(reports: DataFrame, path: str, run_time: dt.datetime | None = None) -> None:
    """Store and publish report documents, one JSON text per pipeline and run."""
    publish(reports.sparkSession, path, stage(reports, path, run_time))


def write_report_text(reports: DataFrame, path: str) -> None:
    """Report documents as text files, one JSON document per line."""
    reports.select(F.col("report").alias("value")).write.mode("overwrite").text(path)


def published_runs(spark: SparkSession, path: str) -> DataFrame | None:
    """The current attempt of every run: attempt, run_id, pipeline, run_ts, rows; None while there is none."""
    try:
        manifests = spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifests")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    # The attempt published last replaces the run, with all its pipelines.
    whole = F.struct("published_at", "attempt")
    entries = F.collect_list(F.struct("attempt", PIPELINE, "run_ts", "rows", "published_at"))
    runs = manifests.groupBy("run_id").agg(F.max(whole)["attempt"].alias("current"), entries.alias("entries"))
    current = F.filter("entries", lambda e: e["attempt"] == F.col("current"))
    return runs.select("run_id", F.explode(current).alias("e")).select(
        F.col("e.attempt").alias("attempt"), "run_id", f"e.{PIPELINE}", "e.run_ts", "e.rows"
    )


def _rows(spark: SparkSession, path: str, runs: DataFrame) -> DataFrame | None:
    """The stored rows of the given runs."""
    runs = runs.select("attempt", "run_id", PIPELINE)
    # Control data: at most one attempt per run that is asked for.
    attempts = sorted(r["attempt"] for r in runs.select("attempt").distinct().collect())
    if not attempts:
        return None
    base = f"{path.rstrip('/')}/data"
    stored = spark.read.option("basePath", base).option("mergeSchema", True).parquet(*[_folder(path, a) for a in attempts])
    asked = runs.toDF("_attempt", "_run_id", "_pipeline")
    same = (
        (stored["attempt"] == asked["_attempt"])
        & stored["run_id"].eqNullSafe(asked["_run_id"])
        & stored[PIPELINE].eqNullSafe(asked["_pipeline"])
    )
    return stored.join(asked, same, "left_semi").drop("attempt")


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all published runs, or None while there is none."""
    runs = published_runs(spark, path)
    return None if runs is None else _rows(spark, path, runs)


def latest_rows(stored: DataFrame, by: tuple[str, ...] = (PIPELINE,)) -> DataFrame:
    """The newest row per group: an aggregate, not a sort of every stored run."""
    order = F.struct(F.col("run_ts"), F.col("run_id"))
    newest = F.max_by(F.struct(*stored.columns), order).alias("_row")
    return stored.groupBy(*by).agg(newest).select("_row.*").select(*stored.columns)


def latest_report(spark: SparkSession, path: str) -> DataFrame | None:
    """Newest report of every pipeline, or None when there is no report."""
    runs = published_runs(spark, path)
    return None if runs is None else _rows(spark, path, latest_rows(runs))


def report_by_id(spark: SparkSession, path: str, run_id: str) -> DataFrame | None:
    """Reports of one run; None when nothing is published, no rows when the run is unknown."""
    runs = published_runs(spark, path)
    if runs is None:
        return None
    found = _rows(spark, path, runs.where(F.col("run_id") == run_id))
    if found is not None:
        return found
    known = _rows(spark, path, runs.limit(1))
    return None if known is None else known.where("false")
