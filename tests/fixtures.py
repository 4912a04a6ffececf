"""Small layer sets built as DataFrames, and the golden demo data set."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.model import CHECK_TYPE
from plumbline.sources.layers import GATE_ORDERS_SCHEMA, HISTORY_SCHEMA, ORDERS_SCHEMA, build_layers

DAY = dt.date(2026, 6, 17)
GOLDEN_DATE = dt.date(2026, 7, 2)

# Past runs of the demo pipeline.
DEMO_HISTORY = [
    (100000, 95200, 4.8, 101800000.0),
    (99900, 94705, 5.2, 101600000.0),
    (100100, 95596, 4.5, 102000000.0),
    (99950, 94453, 5.5, 101700000.0),
    (100050, 94047, 6.0, 101900000.0),
    (100000, 95100, 4.9, 101800000.0),
    (99850, 94758, 5.1, 101500000.0),
    (100150, 94341, 5.8, 102100000.0),
    (100000, 95300, 4.7, 101800000.0),
    (99920, 93725, 6.2, 101650000.0),
    (100080, 95076, 5.0, 101950000.0),
    (100000, 94700, 5.3, 101800000.0),
    (99970, 95371, 4.6, 101750000.0),
    (100030, 94128, 5.9, 101850000.0),
    (100000, 94600, 5.4, 101800000.0),
]
COUNTRIES = ("United Kingdom", "Germany", "France", "Netherlands", "Spain")


def orders(spark: SparkSession, n: int, start: int = 1, **overrides) -> DataFrame:
    """n order lines, one per invoice; overrides are values or Columns."""
    base = {
        "invoice_no": F.format_string("INV%06d", F.col("id")),
        "stock_code": F.lit("A1"),
        "description": F.lit("ITEM"),
        "quantity": F.lit(1).cast("long"),
        "invoice_date": F.lit(DAY.isoformat()),
        "unit_price": F.lit(10.0),
        "customer_id": F.col("id") % 100 + 1,
        "country": F.lit("United Kingdom"),
    }
    for name, value in overrides.items():
        base[name] = value if hasattr(value, "alias") else F.lit(value)
    return spark.range(start, start + n).select(
        *[base[f.name].cast(f.dataType).alias(f.name) for f in ORDERS_SCHEMA.fields]
    )


def with_revenue(df: DataFrame) -> DataFrame:
    return df.withColumn("net_revenue", F.col("quantity") * F.col("unit_price"))


def gold(spark: SparkSession, revenue, n_orders: int, customers: int, average: float) -> DataFrame:
    schema = (
        "total_revenue double, total_orders long, total_customers long, average_order_value double"
    )
    return spark.createDataFrame([(revenue, n_orders, customers, average)], schema)


def history(spark: SparkSession, runs) -> DataFrame:
    rows = [(f"history_{i:02d}", *run) for i, run in enumerate(runs, 1)]
    return spark.createDataFrame(rows, HISTORY_SCHEMA)


def healthy(spark: SparkSession, n: int = 100) -> dict[str, DataFrame]:
    bronze = orders(spark, n)
    silver = with_revenue(bronze)
    layers = build_layers(bronze)
    del layers["raw_orders"], layers["gold_product_sales"]
    layers["silver_orders"] = silver
    layers["historical_runs"] = history(spark, [(n, n, 0.0, n * 10.0)] * 15)
    return layers


def demo(spark: SparkSession) -> dict[str, DataFrame]:
    """The 100,000-row demo with its planted Silver defect."""
    i = F.col("id")
    raw = spark.range(1, 100_001).select(
        F.format_string("INV%06d", i).alias("invoice_no"),
        F.when(i <= 16000, "85123A").when(i <= 72000, "71053").when(i <= 96000, "22423")
        .otherwise("84029E").alias("stock_code"),
        F.lit("ITEM").alias("description"),
        F.when(i <= 16000, 4).when(i <= 72000, 3).when(i <= 96000, 25).otherwise(0)
        .cast("long").alias("quantity"),
        F.lit(DAY.isoformat()).alias("invoice_date"),
        F.when(i <= 16000, 337.0).when(i <= 72000, 449.0).when(i <= 96000, 8.0)
        .otherwise(5.0).alias("unit_price"),
        (i % 5000 + 1).alias("customer_id"),
        F.element_at(F.array(*map(F.lit, COUNTRIES)), (i % 5 + 1).cast("int")).alias("country"),
    )
    return build_layers(raw, history(spark, DEMO_HISTORY), defect=F.col("quantity") <= 20)


def gate_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The release-gate demo."""
    i = F.col("id")
    bronze = spark.range(1, 100_001).select(
        i.alias("order_id"),
        (i % 10_000 + 1).alias("customer_id"),
        F.when(i > 96_000, "INVALID").otherwise("VALID").alias("status"),
        ((i > 72_000) & (i <= 96_000)).alias("has_discount"),
        F.when(i > 96_000, 100).when(i > 72_000, 200).when(i <= 16_000, 1348).otherwise(1347)
        .cast("long").alias("net_amount"),
        F.lit(DAY.isoformat()).alias("order_date"),
    )
    assert bronze.columns == [f.name for f in GATE_ORDERS_SCHEMA.fields]
    correct = bronze.filter("status = 'VALID'")
    # Past drop percentages of the gate.
    drops = [3.77, 3.85, 3.77, 3.85, 3.77, 3.85, 3.77, 3.85, 3.79, 3.83, 3.78, 3.84, 3.81, 3.81, 3.81]
    past = spark.createDataFrame(
        [(f"history_{n:02d}", 100_000, round(100_000 * (1 - d / 100)), d) for n, d in enumerate(drops, 1)],
        "run_id string, bronze_count long, silver_count long, drop_pct double",
    )
    return {
        "bronze_orders": bronze,
        "silver_orders_correct": correct,
        "silver_orders_buggy": correct.filter(~F.col("has_discount")),
        "historical_runs": past,
    }


def results_table(spark: SparkSession, rows, run_id: str = "r1") -> DataFrame:
    """Result rows from (check_id, layer, status[, detail[, extra]])."""
    records = []
    for seq, row in enumerate(rows):
        check_id, layer, status, *rest = row
        detail = rest[0] if rest else ""
        extra = rest[1] if len(rest) > 1 else None
        records.append(
            ("default", run_id, check_id, check_id, layer, status, None, None, None, detail, "",
             None, None, None, extra, status, detail, seq)
        )
    from plumbline.model import RESULT_SCHEMA

    assert len(RESULT_SCHEMA) == len(CHECK_TYPE) + 2
    return spark.createDataFrame(records, RESULT_SCHEMA)


def by_id(df: DataFrame) -> dict:
    return {r["check_id"]: r for r in df.collect()}
