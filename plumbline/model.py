"""Vocabulary shared by every check: statuses, layers, dimensions, result schema."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: the closed vocabularies of a result row and of a verdict. ---
PASS = "PASS"
WARN = "WARN"
FAIL = "FAIL"
IMPACTED = "IMPACTED"
SKIPPED = "SKIPPED"
STATUSES = (PASS, WARN, FAIL, IMPACTED, SKIPPED)

BRONZE = "Bronze"
SILVER = "Silver"
GOLD = "Gold"
CROSS_LAYER = "Cross-Layer"
PIPELINE_LAYERS = (BRONZE, SILVER, GOLD)

TRUSTED = "TRUSTED"
WARNING = "WARNING"
NOT_TRUSTED = "NOT TRUSTED"

COMPLETENESS = "completeness"
VALIDITY = "validity"
UNIQUENESS = "uniqueness"
CONSISTENCY = "consistency"
ACCURACY = "accuracy"
TIMELINESS = "timeliness"

RULES = "layer_1_rules"
RECONCILIATION = "layer_2_reconciliation"
ANOMALY = "layer_3_robust_anomaly"
DETECTION_LAYERS = (RULES, RECONCILIATION, ANOMALY)

SOURCE_TO_BRONZE = "Source → Bronze"
BRONZE_TO_SILVER = "Bronze → Silver"
SILVER_TO_GOLD = "Silver → Gold"
# --- end of fixed values ---

# Worst status wins; SKIPPED has no rank, so aggregates pass over it.
SEVERITY_ORDER = (PASS, WARN, IMPACTED, FAIL)

# Group column: frames that carry it are validated per pipeline, all in one job.
PIPELINE = "pipeline"
DEFAULT_PIPELINE = "default"

CHECK_TYPE = T.StructType(
    [
        T.StructField("check_id", T.StringType()),
        T.StructField("check_name", T.StringType()),
        T.StructField("layer", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("observed_value", T.DoubleType()),
        T.StructField("observed", T.StringType()),
        T.StructField("expected", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("evidence_query", T.StringType()),
        T.StructField("dimension", T.StringType()),
        T.StructField("detection_layer", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
        # Status and detail before downstream-impact adjustment.
        T.StructField("detected_status", T.StringType()),
        T.StructField("detected_detail", T.StringType()),
        T.StructField("seq", T.IntegerType()),
    ]
)

RESULT_SCHEMA = T.StructType(
    [T.StructField(PIPELINE, T.StringType()), T.StructField("run_id", T.StringType())]
    + CHECK_TYPE.fields
)
