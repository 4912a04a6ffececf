"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.lineage import new_folder

#: A fifth of the documents is kept apart for measuring a learned model.
FOLDS = 5


#: The folder that holds the package.
HOME = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's folder. Workers that don't have the package installed look beside it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", HOME)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fold no model learns from; a null id counts as held out."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: no lost executor repeats the work."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most about ``most_bytes`` Arrow bytes, one row at least.

    Arrow batches are cut by rows, so a few long texts could otherwise fill a worker's memory.
    """
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * most_bytes / max(batch.nbytes, 1)))
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def frame_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n, c in columns.items()],
        schema=schema,
    )


def map_texts(docs: DataFrame, change: Callable[[list[str | None]], tuple[list | None, list | None]], column: str = "text") -> DataFrame:
    """The documents with new texts, or without some rows, decided batch by batch in one narrow pass.

    ``change`` gets the texts of a batch and returns the new ones (None: as they were) and which rows
    stay (None: all). All other columns pass through, whatever they are called.
    """
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, keep = change(batch.column(at).to_pylist())
            if texts is not None:
                new = pa.array(texts, batch.schema.field(at).type)
                batch = pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)
            yield batch if keep is None else batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def hash_sample(df: DataFrame, label: str, per_label: int) -> tuple[DataFrame, dict]:
    """About ``per_label`` rows of each label, by a hash of doc_id, and the rows of every label.

    Rows are taken where they lie, so that only the sample is ever shuffled; a label with fewer rows
    keeps all. Hashes that repeat come in together.
    """
    totals = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    spread = 1 << 40
    part = F.pmod(F.xxhash64("doc_id"), F.lit(spread))
    shares = [(F.col(label) == value) & (part < per_label * spread // n) for value, n in totals.items() if n > per_label]
    whole = [value for value, n in totals.items() if n <= per_label]
    keep = F.col(label).isin(whole) if whole else F.lit(False)
    for share in shares:
        keep = keep | share
    return df.where(keep), totals
