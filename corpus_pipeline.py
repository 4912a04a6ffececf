"""A training-corpus pipeline: each stage works on all documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import landed, table
from plumbline.llm.decontamination import contamination
from plumbline.llm.mixing import domain_model, with_rates
from plumbline.llm.neardup import near_duplicates
from plumbline.llm.pii import pii_model, redacted
from plumbline.llm.quality import drop_poor, quality_model
from plumbline.llm.queries import TARGETS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def own_columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null texts are judged as empty ones."""
    docs = own_columns(docs)
    return drop_poor(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def identity() -> Column:
    """The id of a document; one without gets a number above all others, made from its text."""
    made = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 61)
    return F.coalesce(F.col("doc_id").cast("long"), made)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, once.

    A document is an id with a text: rows that repeat an id with another text are judged alone, and of
    rows that repeat both one stays. Documents without words stay, but for repeated rows.
    """
    docs = own_columns(docs).withColumn("_id", identity()).withColumn("_hash", F.xxhash64("text"))
    found = near_duplicates(docs.select(F.col("_id").alias("doc_id"), "text"), by_text=True)
    found = landed(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "component"), "groups")
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("_id", "_hash")).alias("first"))
    stays = first.select("first.*").union(found.where("component IS NULL").select("_id", "_hash")).distinct()
    key = ["_id", "_hash"]
    again = landed(found.groupBy(*key).count().where("count > 1").select(*key), "again")
    # Lists of ids and hashes beside the texts: hashed, so that no text is sorted.
    kept = docs.join(landed(stays, "stays").hint("shuffle_hash"), key, "left_semi")
    once = kept
    if again.limit(1).count():
        once = kept.join(again.hint("shuffle_hash"), key, "left_anti")
        once = once.unionByName(kept.join(again, key, "left_semi").dropDuplicates(key))
    return once.select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words lies in benchmark windows go.

    Judged by id and text together, so a row that repeats an id with another text is judged alone.
    """
    docs = own_columns(docs).withColumn("_key", F.xxhash64("doc_id", "text"))
    found = contamination(docs.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = landed(found.where("contaminated").select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return docs.join(gone.hint("shuffle_hash"), "_key", "left_anti").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets; n_chars follows. No row goes."""
    docs = own_columns(docs)
    out = redacted(docs, pii_model(docs))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds to each document its language as predicted, its rate under the target weights, and copies.

    Every document comes out once; it is the reader who must use it ``copies`` times.
    """
    docs = own_columns(docs)
    return with_rates(docs, domain_model(docs), TARGETS)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("pii", redact),
    ("mixing", mix),
]

#: Trained models and sketches decide; SQL can't express them. tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what one returns is written and reread as the documents of the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
