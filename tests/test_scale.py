"""Plans and results of the steps that large tables go through, on rows of their own."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import keys, versions
from plumbline.sources.layers import ORDERS_SCHEMA
from plumbline.specs import PipelineSpec
from workload import queries, roles

SPEC = PipelineSpec()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Repeated and null keys in every table, and line numbers above nine, so that documents meet."""
    path = str(tmp_path_factory.mktemp("tables"))
    numbers = ((1, 1), (1, 2), (1, 12), (2, 2), (2, 1), (3, 1), (3, None), (9, 1), (None, 1))
    lines = [(o, 10 * (o or 0) + (n or 0), 1, n, 3.0, 12.0, "A", "F", "1995-01-02") for o, n in numbers]
    lines += [(1, 3, 1, 1, 4.0, 8.0, "R", "O", "1995-02-01"), (2, 99, 1, 2, 4.0, 8.0, "R", "O", None), (2, 99, 1, 2, 4.0, 8.0, "R", "O", None)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate string"
    tables = {
        "lineitem": (lines, schema),
        "orders": ([(1, 5, "1-URGENT"), (1, 4, "2-HIGH"), (2, 5, "2-HIGH"), (3, 6, None), (9, 77, "5-LOW"), (None, 5, "x")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "customer": ([(4, 0), (5, 1), (5, 2), (6, 2), (None, 1)], "c_custkey long, c_nationkey int"),
        "nation": ([(0, "Z"), (1, "B"), (2, None), (2, "A")], "n_nationkey int, n_name string"),
    }
    for name, (rows, columns) in tables.items():
        spark.createDataFrame(rows, columns).write.parquet(f"{path}/{name}.parquet")
    return path


def bag(df):
    return sorted(map(repr, df.collect()))


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


@pytest.fixture
def plain(spark):
    """Plans as for tables too large to be broadcast."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


def test_lines_are_shuffled_once(spark, folder, plain):
    found = list(nodes(roles.joined(spark, folder)._jdf.queryExecution().executedPlan()))
    shuffled = [n for n in found if n.nodeName() == "Exchange" and "l_orderkey" in n.output().toString()]
    assert len(shuffled) == 1
    table = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    old = table("lineitem").join(table("orders"), F.expr("l_orderkey = o_orderkey")).join(table("customer"), F.expr("o_custkey = c_custkey"))
    old = old.join(table("nation"), F.expr("c_nationkey = n_nationkey"))
    assert bag(roles.joined(spark, folder).select(*old.columns)) == bag(old) != []


def test_clean_rows_are_the_least_of_each_document(spark, folder):
    whole = roles.joined(spark, folder).selectExpr(
        "l_orderkey * 10 + l_linenumber AS invoice_no", "l_partkey AS stock_code",
        "concat(l_returnflag, '-', l_linestatus) AS description", "CAST(l_quantity AS BIGINT) AS quantity",
        "CAST(CAST(l_shipdate AS DATE) AS STRING) AS invoice_date",
        "floor(l_extendedprice * 100D / l_quantity) / 100D AS unit_price", "o_custkey AS customer_id", "n_name AS country",
    )
    rest = whole.columns[1:]
    old = whole.groupBy("invoice_no").agg(F.min(F.struct(*rest)).alias("row")).select("invoice_no", "row.*")
    clean = queries._clean(spark, folder)
    assert bag(clean) == bag(old) and old.count() > 4
    # Only documents that repeat are grouped whole.
    assert "bit_or" in clean._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("hot", [1, 10_000])
def test_lost_rows_are_counted_once(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(keys, "HOT", hot)
    row = lambda i, k, q: (k, "A", "d", q, "2026-01-01", 2.0, i % 2, "UK")
    bronze = [row(i, key, 3) for i, key in enumerate(["HOT"] * 60 + ["I1", "I2", None, "I3", "I3"])]
    spark.createDataFrame(bronze, ORDERS_SCHEMA).repartition(5).write.parquet(f"{tmp_path}/b")
    spark.createDataFrame([row(1, "HOT", 3), row(0, "I3", 3), row(0, "I9", 1)], ORDERS_SCHEMA).write.parquet(f"{tmp_path}/s")
    b, s = (spark.read.parquet(f"{tmp_path}/{n}") for n in "bs")
    lost = keys.lost_valid_rows_counted(b, s, SPEC)
    assert bag(lost) == bag(keys.lost_valid_rows(b, s, SPEC)) != []
    # The stored keys are read, not counted again for each use.
    assert f"{tmp_path}/s" not in lost._jdf.queryExecution().optimizedPlan().toString() and "Union" not in lost._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_counted_by_hash_without_shuffling_them_all(spark, plain):
    rows = spark.range(60).selectExpr("id % 50 AS a", "CASE WHEN id % 50 < 5 THEN NULL ELSE 'x' END AS b")
    counted = keys.full_row_duplicates_two_pass(rows)
    assert counted.first()[0] == 10
    text = counted._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_versions_group_repeated_rows_only(spark, plain):
    base = spark.range(60).selectExpr("id % 50 AS a", "CAST(id % 50 AS DOUBLE) AS b")
    made = versions.Versions(base, {"same": versions.Change(), "fewer": versions.Change("a > 3"), "double": versions.Change(values={"b": "b * 2"})})
    found = versions.full_row_duplicates(made)
    assert {r["pipeline"]: r["excess"] for r in found.collect()} == {"same": 10, "fewer": 6, "double": 10}
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
