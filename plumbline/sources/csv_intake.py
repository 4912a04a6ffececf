"""CSV files parted into the lines that fit their schema and the lines that don't.

A line with too few or too many fields, broken quotes or a field of the wrong type goes to quarantine
with its text, its file and the reason. The source table keeps every line, with NULL in the fields that
don't parse, so comparing it with Bronze, which holds the good lines, counts what quarantine holds.
Files are parsed once: what is read is stored, and all three tables read the stored rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.lineage import new_folder
from plumbline.sources.layers import CORRUPT, GATE_FILES, HISTORY_SCHEMA, ORDERS_SCHEMA, build_layers
from plumbline.specs import PipelineSpec, ticked

_FILE = "_source_file"


@dataclass(frozen=True)
class Intake:
    """``source`` has every line, ``rows`` the good ones, ``quarantine`` table_name, file, line and reason of the others."""

    source: DataFrame
    rows: DataFrame
    quarantine: DataFrame


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, name: str, multi_line: bool = False, folder: str | None = None
) -> Intake:
    """Read CSV files with headers; a missing path raises. An empty file gives empty tables.

    ``multi_line`` allows line breaks inside quotes; each file is then parsed by one task, so ask for it
    only where files are many and not large. ``folder`` is where the rows are stored, a new one by default.
    """
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    # Without pruning every field of a line is looked at, whatever is asked of it later.
    reader = spark.read.schema(whole).option("header", True).option("columnPruning", False).option("escape", '"')
    reader = reader.option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", multi_line)
    found = reader.csv(path).select("*", F.col("_metadata.file_name").alias(_FILE))
    target = folder or new_folder(spark, f"intake-{name}")
    found.write.mode("overwrite").parquet(target)
    stored = spark.read.schema(found.schema).parquet(target)
    names = [F.col(ticked(c)) for c in schema.names]
    return Intake(stored.select(*names), stored.where(f"{CORRUPT} IS NULL").select(*names), _quarantine(stored, schema, name))


def _quarantine(stored: DataFrame, schema: T.StructType, name: str) -> DataFrame:
    """Why each bad line is bad: a reason per field of a wrong type, or the fields as a whole."""
    texts = T.StructType([T.StructField(f"f{k}", T.StringType()) for k in range(len(schema))])
    with_rest = T.StructType([*texts.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"'}
    bad = stored.where(f"{CORRUPT} IS NOT NULL")
    bad = bad.withColumn("_texts", F.from_csv(CORRUPT, F.lit(with_rest.simpleString()), options))
    wrong = [
        F.when(F.col(f"_texts.f{k}").isNotNull() & F.col(ticked(c)).isNull(), F.lit(f"{c} is no {schema[c].dataType.simpleString()}"))
        for k, c in enumerate(schema.names)
    ]
    types = F.array_join(F.array_compact(F.array(*wrong)), "; ")
    fields = F.lit(f"not {len(schema)} well-formed fields")
    reason = F.when(F.col(f"_texts.{CORRUPT}").isNotNull() | (types == ""), fields).otherwise(types)
    return bad.select(
        F.lit(name).alias("table_name"), F.col(_FILE).alias("file"), F.col(CORRUPT).alias("line"), reason.alias("reason")
    )


def intake_orders(spark: SparkSession, path: str, multi_line: bool = False) -> Intake:
    """Raw orders; a missing path raises."""
    return read_csv(spark, path, ORDERS_SCHEMA, "raw_orders", multi_line)


def intake_history(spark: SparkSession, path: str) -> Intake | None:
    """Run history, or None when there is none yet."""
    try:
        return read_csv(spark, path, HISTORY_SCHEMA, "historical_runs")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def intake_gate(spark: SparkSession, folder: str) -> dict[str, Intake]:
    """The four tables of the release gate; a missing file raises."""
    return {
        name: read_csv(spark, f"{folder.rstrip('/')}/{name}.csv", schema, name) for name, schema in GATE_FILES.items()
    }


def intake_layers(orders: Intake, history: Intake | None = None, spec: PipelineSpec | None = None) -> dict[str, DataFrame]:
    """All layers from CSV: the source has every line, Bronze and what is built on it the good ones."""
    spec = spec or PipelineSpec()
    layers = build_layers(orders.rows, history.rows if history else None, spec)
    return {**layers, spec.source: orders.source}


def quarantine_counts(intakes: Mapping[str, Intake]) -> DataFrame:
    """Lines and bad lines by table, tables without bad lines included."""
    frames = [
        one.source.agg(F.count(F.lit(1)).alias("lines"))
        .select(F.lit(name).alias("table_name"), "lines")
        .join(one.quarantine.agg(F.count(F.lit(1)).alias("bad_lines")), F.lit(True))
        for name, one in intakes.items()
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
