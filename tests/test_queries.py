"""Every registered query against its DuckDB oracle."""

import math
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as contract  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def table(names, rows):
    order = sorted(names)
    at = [names.index(n) for n in order]
    return order, sorted(tuple(normal(r[i]) for i in at) for r in rows)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    frame = contract.queries()[name](spark, SF_DIR)
    found = table(frame.columns, frame.collect())
    assert found[1]
    sql = contract.oracle_sql().get(name)
    if sql:
        result = duck.execute(sql)
        assert found == table([d[0] for d in result.description], result.fetchall())


@pytest.fixture(scope="module")
def flagged_lines(spark, tmp_path_factory):
    """Line keys that repeat within one return flag, under two, and not at all."""
    folder = tmp_path_factory.mktemp("lines")
    rows = [(1, 1, "A"), (1, 1, "A"), (1, 1, "A"), (1, 1, "R"), (2, 1, "R"), (2, 1, "R"), (None, 1, "N"), (3, None, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_key_copies_are_counted_per_return_flag(spark, flagged_lines):
    rows = contract.queries()["dup_primary_key"](spark, flagged_lines).collect()
    assert {r["l_returnflag"]: r["excess"] for r in rows} == {"A": 2, "R": 1, "N": 0, None: 0}


def test_repeated_keys_are_counted_per_return_flag(spark, flagged_lines):
    rows = contract.queries()["dup_distinct_keys"](spark, flagged_lines).collect()
    assert {r["l_returnflag"]: r["duplicated"] for r in rows} == {"A": 1, "R": 1, "N": 0, None: 0}


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert {r["pipeline"] for r in rows} and all(r["final_verdict"] == "NOT TRUSTED" for r in rows)
