from pathlib import Path

import pytest
from edge_cases import DOCS, EDGE
from pyspark.sql import functions as F

@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    """Workers find the package wherever the tests are started."""
    spark.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parents[2])


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns that clash with the operators' own."""
    rows = spark.createDataFrame(EDGE, DOCS)
    for name in ("score", "n", "node", "key", "class", "rate", "place", "bucket", "spans", "row", "n_tokens", "fp", "host"):
        rows = rows.withColumn(name, F.lit("x"))
    return rows.repartition(3)


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")
