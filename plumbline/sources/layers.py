"""Layer tables: CSV scans, in-memory frames and the medallion transformations."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import PurePosixPath
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.gold import average_order_value
from plumbline.model import PIPELINE
from plumbline.specs import PipelineSpec


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_TEXT, _LONG, _REAL = T.StringType(), T.LongType(), T.DoubleType()

# File schemas. Dates stay text so that the date checks can fail.
ORDERS_SCHEMA = _schema(
    invoice_no=_TEXT,
    stock_code=_TEXT,
    description=_TEXT,
    quantity=_LONG,
    invoice_date=_TEXT,
    unit_price=_REAL,
    customer_id=_LONG,
    country=_TEXT,
)
HISTORY_SCHEMA = _schema(
    run_id=_TEXT,
    bronze_count=_LONG,
    silver_count=_LONG,
    drop_pct=_REAL,
    gold_revenue=_REAL,
)
GATE_ORDERS_SCHEMA = _schema(
    order_id=_LONG,
    customer_id=_LONG,
    status=_TEXT,
    has_discount=T.BooleanType(),
    net_amount=_LONG,
    order_date=_TEXT,
)
GATE_HISTORY_SCHEMA = _schema(
    run_id=_TEXT, bronze_count=_LONG, silver_count=_LONG, drop_pct=_REAL
)
GATE_FILES = {
    "bronze_orders": GATE_ORDERS_SCHEMA,
    "silver_orders_correct": GATE_ORDERS_SCHEMA,
    "silver_orders_buggy": GATE_ORDERS_SCHEMA,
    "historical_runs": GATE_HISTORY_SCHEMA,
}
CORRUPT = "_corrupt_record"


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_orders_csv(spark: SparkSession, path: str, keep_corrupt: bool = False) -> DataFrame:
    """Raw orders; a missing path raises. Malformed fields read as NULL.

    With ``keep_corrupt`` the text of every malformed line is kept in an extra column.
    """
    if not keep_corrupt:
        return _csv(spark, path, ORDERS_SCHEMA)
    schema = T.StructType([*ORDERS_SCHEMA.fields, T.StructField(CORRUPT, _TEXT)])
    reader = spark.read.schema(schema).option("header", True)
    return reader.option("columnNameOfCorruptRecord", CORRUPT).csv(path)


def read_history_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """Run history, or None when there is none yet."""
    try:
        return _csv(spark, path, HISTORY_SCHEMA)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_gate_csvs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four tables of the release gate; a missing file raises."""
    root = PurePosixPath(folder)
    return {
        name: _csv(spark, f"{folder.rstrip('/')}/{name}.csv" if "://" in folder else str(root / f"{name}.csv"), schema)
        for name, schema in GATE_FILES.items()
    }


def layers_from_frames(
    spark: SparkSession, frames: Mapping[str, Any], schemas: Mapping[str, Any] | None = None
) -> dict[str, DataFrame]:
    """A layer set from DataFrames, pandas frames or lists of rows, without any ETL."""
    schemas = schemas or {}
    return {
        name: data
        if isinstance(data, DataFrame)
        else spark.createDataFrame(data, schema=schemas.get(name))
        for name, data in frames.items()
    }


def land_bronze(raw: DataFrame) -> DataFrame:
    """Bronze is an identity copy of the source."""
    return raw


def build_silver(
    bronze: DataFrame, spec: PipelineSpec | None = None, defect: Column | None = None
) -> DataFrame:
    """Keep sellable rows and derive revenue; ``defect`` is an extra (faulty) filter."""
    spec = spec or PipelineSpec()
    keep = F.expr(spec.sellable_row())
    if defect is not None:
        keep = keep & defect
    names = [c for c in (PIPELINE, *spec.required_columns) if c in bronze.columns]
    revenue = F.col(spec.quantity) * F.col(spec.price)
    return bronze.filter(keep).select(*names, revenue.alias(spec.revenue))


def _group(df: DataFrame) -> list[str]:
    return [PIPELINE] if PIPELINE in df.columns else []


def build_gold_metrics(silver: DataFrame, spec: PipelineSpec | None = None) -> DataFrame:
    """Revenue, distinct orders and customers, and their ratio, one row per pipeline.

    The distinct counts are taken from two narrow groupings instead of one aggregate
    with two DISTINCTs, which would triple every row before its shuffle.
    """
    spec = spec or PipelineSpec()
    by = _group(silver)
    per_document = silver.groupBy(*by, spec.document).agg(
        F.sum(spec.revenue).alias("_revenue")
    )
    sales = per_document.groupBy(*by).agg(
        F.sum("_revenue").alias("total_revenue"),
        F.count(spec.document).alias("total_orders"),
    )
    customers = (
        silver.groupBy(*by, spec.customer)
        .agg(F.lit(1).alias("_seen"))
        .groupBy(*by)
        .agg(F.count(spec.customer).alias("total_customers"))
    )
    both = sales.unionByName(customers, allowMissingColumns=True)
    merged = both.groupBy(*by).agg(
        F.max("total_revenue").alias("total_revenue"),
        F.coalesce(F.max("total_orders"), F.lit(0)).alias("total_orders"),
        F.coalesce(F.max("total_customers"), F.lit(0)).alias("total_customers"),
    )
    average = average_order_value("total_revenue", "total_orders")
    return merged.withColumn("average_order_value", F.expr(average))


def build_gold_country(silver: DataFrame, spec: PipelineSpec | None = None) -> DataFrame:
    spec = spec or PipelineSpec()
    return silver.groupBy(*_group(silver), spec.country).agg(
        F.sum(spec.revenue).alias("revenue")
    )


def build_gold_product(silver: DataFrame, spec: PipelineSpec | None = None) -> DataFrame:
    spec = spec or PipelineSpec()
    return silver.groupBy(*_group(silver), spec.item).agg(
        F.sum(spec.quantity).alias("total_quantity"), F.sum(spec.revenue).alias("revenue")
    )


def build_layers(
    raw: DataFrame,
    history: DataFrame | None = None,
    spec: PipelineSpec | None = None,
    defect: Column | None = None,
) -> dict[str, DataFrame]:
    """All layers from raw orders, lazily. Write Silver and Gold where they are large
    and used more than once: see :func:`land_layers`."""
    spec = spec or PipelineSpec()
    bronze = land_bronze(raw)
    silver = build_silver(bronze, spec, defect)
    layers = {
        spec.source: raw,
        spec.bronze: bronze,
        spec.silver: silver,
        spec.gold: build_gold_metrics(silver, spec),
        spec.gold_country: build_gold_country(silver, spec),
        "gold_product_sales": build_gold_product(silver, spec),
    }
    if history is not None:
        layers[spec.history] = history
    return layers


def land_layers(
    layers: Mapping[str, DataFrame], folder: str, mode: str = "overwrite"
) -> dict[str, DataFrame]:
    """Write each layer as Parquet and read it back, so checks scan tables, not plans.

    Tables with the same plan are written once and stay one DataFrame.
    """
    landed: dict[str, DataFrame] = {}
    for name, df in layers.items():
        twin = next((o for o in landed if layers[o].sameSemantics(df)), None)
        if twin is not None:
            landed[name] = landed[twin]
            continue
        target = f"{folder.rstrip('/')}/{name}"
        df.write.mode(mode).parquet(target)
        landed[name] = df.sparkSession.read.parquet(target)
    return landed
