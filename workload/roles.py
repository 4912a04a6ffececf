"""The driver's tables in the roles of a medallion pipeline.

``lines`` is lineitem joined to its order, customer and nation, with planted dirt so
that every check has something to find: blank keys, wrong signs, bad dates, copies.
All rows take part; the conditions below only choose which of them are soiled.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.values import as_date
from plumbline.model import PIPELINE
from plumbline.operators.rollup import cross_layer_checks
from plumbline.plans.lineage import cut_lineage, new_folder
from plumbline.plans.metrics import collect_metrics
from plumbline.plans.run import check_results
from plumbline.sources.layers import (
    build_gold_country,
    build_gold_metrics,
    build_silver,
    land_layers,
)
from plumbline.specs import PipelineSpec

RUN_DATE = dt.date(2001, 12, 31)
RUN_ID = "r1"
SPEC = PipelineSpec(segment_quantity=40)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ordered(spark: SparkSession, sf: str) -> DataFrame:
    """orders with customer and nation columns."""
    return (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey"))
        .join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"))
    )


def joined(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with order, customer and nation columns.

    Orders meet their customers first, so the lines, which are the most rows, are shuffled once.
    """
    return table(spark, sf, "lineitem").join(ordered(spark, sf), F.expr("l_orderkey = o_orderkey"))


LINE_COLUMNS = (
    "o_orderpriority AS pipeline",
    "CASE WHEN l_linenumber = 7 AND l_partkey % 10 = 0 THEN NULL ELSE l_orderkey END AS invoice_no",
    "l_partkey AS stock_code",
    "concat(l_returnflag, '-', l_linestatus) AS description",
    "CASE WHEN l_linenumber = 6 AND l_suppkey % 20 = 0 THEN -CAST(l_quantity AS BIGINT) "
    "WHEN l_linenumber = 5 AND l_suppkey % 25 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS quantity",
    "CASE WHEN l_linenumber = 7 AND l_suppkey % 3 = 0 THEN 'bad-date' "
    "ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS invoice_date",
    "floor(l_extendedprice * 100D / l_quantity) / 100D AS unit_price",
    "CASE WHEN l_linenumber = 4 AND l_suppkey % 50 = 0 THEN NULL "
    "WHEN l_linenumber = 3 AND l_partkey % 20 = 0 THEN -o_custkey ELSE o_custkey END AS customer_id",
    "n_name AS country",
)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Raw order lines of five pipelines (order priorities), some of them twice."""
    copies = "CASE WHEN l_linenumber = 1 AND l_suppkey % 40 = 0 THEN 2 ELSE 1 END"
    rows = joined(spark, sf).selectExpr(*LINE_COLUMNS, f"explode(sequence(1, {copies})) AS copy")
    return rows.drop("copy")


def silver(bronze: DataFrame) -> DataFrame:
    """Silver with the planted defect: large orders are filtered out."""
    return build_silver(bronze, SPEC, defect=F.col("quantity") <= 40)


def history(bronze: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One past run per pipeline and ship month, scaled to the size of the whole.

    Lines without a date make up the run ``undated``.
    """
    dated = as_date("invoice_date", bronze.schema["invoice_date"].dataType)
    month = F.expr(f"CASE WHEN {dated} IS NULL THEN 'undated' ELSE substring(invoice_date, 1, 7) END AS run_id")
    per_run = (
        bronze.select(PIPELINE, month, F.lit(1).alias("b"), F.lit(0).alias("s"), F.lit(0.0).alias("r"))
        .unionByName(
            cleaned.select(
                PIPELINE, month, F.lit(0).alias("b"), F.lit(1).alias("s"), F.col("net_revenue").alias("r")
            )
        )
        .groupBy(PIPELINE, "run_id")
        .agg(F.sum("b").alias("b"), F.sum("s").alias("s"), F.sum("r").alias("r"))
    )
    return per_run.selectExpr(
        PIPELINE,
        "run_id",
        "b * 84 AS bronze_count",
        "s * 84 AS silver_count",
        "(1D - s / b) * 100 AS drop_pct",
        "r * 84 AS gold_revenue",
    )


def _plans(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Every layer as read from landed Bronze and Silver tables."""
    folder = new_folder(spark, "layers")
    raw = land_layers({"raw_orders": lines(spark, sf)}, folder)["raw_orders"]
    cleaned = land_layers({"silver_orders": silver(raw)}, folder)["silver_orders"]
    gold = build_gold_metrics(cleaned, SPEC).withColumns(
        {
            "total_orders": F.expr("total_orders + CASE WHEN pipeline = '1-URGENT' THEN 5 ELSE 0 END"),
            "total_revenue": F.expr("total_revenue * CASE WHEN pipeline = '2-HIGH' THEN 2D ELSE 1D END"),
        }
    )
    country = build_gold_country(cleaned, SPEC).withColumn(
        "revenue",
        F.expr("revenue + CASE WHEN pipeline = '3-MEDIUM' AND country = 'NATION_6' THEN 100D ELSE 0D END"),
    )
    derived = {
        "gold_metrics": gold,
        "gold_country_revenue": country,
        "historical_runs": history(raw, cleaned),
    }
    return {
        "raw_orders": raw,
        "bronze_orders": raw,
        "silver_orders": cleaned,
        **land_layers(derived, folder),
        "customers": table(spark, sf, "customer").selectExpr("c_custkey AS customer_id"),
    }


_landed: dict[tuple[str, str], dict[str, DataFrame]] = {}
_stored: dict[tuple[str, str], DataFrame] = {}


def layers(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The full layer set, landed once per session and data set.

    Gold carries one planted error per affected pipeline.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _landed:
        _landed[key] = _plans(spark, sf)
    return _landed[key]


def results(spark: SparkSession, sf: str) -> DataFrame:
    """All check results of the five pipelines, written once per session and data set.

    The questions asked of a result table read it as they would read a result store.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stored:
        # Rows are counted by their hashes first: whole rows of large layers would be most of the shuffle.
        sheet = collect_metrics(layers(spark, sf), SPEC, two_pass_rows=True)
        core = check_results(sheet.layers, run_id=RUN_ID, run_date=RUN_DATE, sheet=sheet)
        core = cut_lineage(core)
        _stored[key] = core.unionByName(cross_layer_checks(core))
    return _stored[key]


def gate_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Orders in the roles of the release gate; urgent orders count as discounted."""
    bronze = table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderkey % 3 = 0 THEN 'north' ELSE 'south' END AS pipeline",
        "o_orderkey AS order_id",
        "o_custkey AS customer_id",
        "CASE WHEN o_orderstatus = 'P' THEN 'INVALID' ELSE 'VALID' END AS status",
        "o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0 AS has_discount",
        "o_totalprice AS net_amount",
        "CAST(o_orderdate AS DATE) AS order_date",
    )
    correct = bronze.filter("status = 'VALID'")
    past = (
        bronze.withColumn("run_id", F.expr("date_format(order_date, 'yyyy-MM')"))
        .groupBy(PIPELINE, "run_id")
        .agg(F.count(F.lit(1)).alias("bronze_count"), F.count_if(F.expr("status = 'VALID'")).alias("silver_count"))
    )
    return {
        "bronze_orders": bronze,
        "silver_orders_correct": correct,
        "silver_orders_buggy": correct.filter("NOT has_discount"),
        "historical_runs": past,
    }

