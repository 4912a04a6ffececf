"""Key operators against brute force on small random tables with hot and NULL keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import faults, key_filter, keys
from plumbline.sources.layers import ORDERS_SCHEMA
from plumbline.specs import PipelineSpec

SPEC = PipelineSpec()


def _rows(seed, n):
    """A third of the rows share one key; others repeat at random; some keys are NULL."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if i % 3 == 0:
            key = ("HOT", "A", 1, "2026-01-01")
        else:
            key = (rnd.choice([None, "I1", "I2", f"I{i % 17}"]), rnd.choice([None, "A", "B"]),
                   rnd.choice([None, 1, 2]), rnd.choice(["2026-01-01", None]))
        quantity, price = rnd.choice([None, -1, 0, 3, 25]), rnd.choice([None, 0.0, 2.0])
        out.append((key[0], key[1], "d", quantity, key[3], price, key[2], "UK"))
    return out


@pytest.fixture(scope="module", params=[1, 2])
def pair(request, spark):
    bronze, silver = _rows(request.param, 120), _rows(request.param + 10, 60)
    frames = [spark.createDataFrame(r, ORDERS_SCHEMA) for r in (bronze, silver)]
    return bronze, silver, *frames


def _key(r):
    return (r[0], r[1], r[6], r[4])


def _valid(r):
    return r[3] is not None and r[3] > 0 and r[5] is not None and r[5] > 0 and None not in (r[0], r[1])


def test_census_equals_brute_force(pair):
    bronze, silver, b, s = pair
    got = keys.key_census(b, s, SPEC).head()
    silver_keys, silver_docs = {_key(r) for r in silver}, {r[0] for r in silver} - {None}
    bronze_docs = {r[0] for r in bronze} - {None}
    lost = [r for r in bronze if _valid(r) and _key(r) not in silver_keys]
    excess = lambda rows, f: sum(c - 1 for c in Counter(map(f, rows)).values())
    assert got["lost_rows"] == len(lost)
    assert got["lost_min_quantity"] == (min((r[3] for r in lost), default=None))
    assert got["lost_max_quantity"] == (max((r[3] for r in lost), default=None))
    assert got["bronze_key_excess"] == excess(bronze, _key)
    assert got["silver_key_excess"] == excess(silver, _key)
    assert got["bronze_document_excess"] == excess(bronze, lambda r: r[0])
    assert got["silver_document_excess"] == excess(silver, lambda r: r[0])
    assert got["lost_document_rows"] == sum(1 for r in bronze if _valid(r) and r[0] not in silver_docs)
    assert got["silver_rows_unknown"] == sum(1 for r in silver if r[0] not in bronze_docs)
    assert got["silver_documents"] == len(silver_docs)
    assert keys.lost_valid_rows(b, s, SPEC).count() == len(lost)


def test_full_row_duplicates_agree(pair):
    bronze, _, b, _ = pair
    expected = len(bronze) - len(set(bronze))
    assert keys.full_row_duplicates(b).head()[0] == expected
    assert keys.full_row_duplicates_two_pass(b).head()[0] == expected


def test_two_pass_agrees_on_collated_text(spark):
    rows = spark.sql("SELECT a COLLATE UTF8_LCASE AS a, n FROM VALUES ('a', 1), ('A', 1), ('b', 2) AS t(a, n)")
    assert keys.full_row_duplicates(rows).head()[0] == 1
    assert keys.full_row_duplicates_two_pass(rows).head()[0] == 1


def test_two_pass_without_duplicates(spark):
    assert keys.full_row_duplicates_two_pass(spark.range(50)).head()[0] == 0
    grouped = spark.range(50).withColumn("pipeline", F.lit("p"))
    assert tuple(keys.full_row_duplicates_two_pass(grouped, ["pipeline"]).head()) == ("p", 0)


def test_maps_can_be_compared(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1) UNION ALL SELECT map('a', 2)")
    assert keys.full_row_duplicates(df).head()[0] == 1


def test_duplicates_and_distincts(pair):
    bronze, _, b, _ = pair
    counts = Counter(r[0] for r in bronze)
    assert keys.duplicated_keys(b, ["invoice_no"]).head()[0] == sum(1 for c in counts.values() if c > 1)
    assert keys.distinct_count(b, "invoice_no").head()[0] == len(set(counts) - {None})
    assert keys.duplicate_excess(b.limit(0), ["invoice_no"]).head()[0] == 0


def test_orphans_ignore_null_references(pair, spark):
    bronze, _, b, _ = pair
    ref = spark.createDataFrame([("HOT",), ("I1",), ("I1",), (None,)], "k string")
    expected = sum(1 for r in bronze if r[0] not in (None, "HOT", "I1"))
    assert keys.fk_orphans(b, "invoice_no", ref, "k").head()[0] == expected
    clean = keys.fk_orphans(b.filter("invoice_no = 'HOT'"), "invoice_no", ref, "k")
    assert clean.head()[0] == 0


def test_segment_loss_keeps_negative_loss_and_order(spark, pair):
    bronze, silver, b, s = pair
    segment = F.when(F.col("quantity") > 20, "high").otherwise("low")
    got = {r["segment"]: r for r in keys.segment_loss(b, s, segment, SPEC).collect()}
    for name, test in (("high", lambda q: q is not None and q > 20), ("low", lambda q: q is None or q <= 20)):
        valid = sum(1 for r in bronze if _valid(r) and test(r[3]))
        kept = sum(1 for r in silver if test(r[3]))
        if valid:
            assert (got[name]["bronze_valid"], got[name]["silver_count"]) == (valid, kept)
            assert got[name]["loss_pct"] == pytest.approx(round((1 - kept / valid) * 100, 2), abs=0.011)
        else:
            assert name not in got


# --- fault injection --------------------------------------------------------------


@pytest.mark.parametrize("n, fraction, kept", [(100, 0.3, 70), (101, 0.25, 75), (3, 0.99, 1), (50, 0.0, 50)])
def test_row_drop_keeps_an_exact_share(spark, n, fraction, kept):
    df = spark.range(0, n, 1, 5).withColumn("x", F.col("id") * 2)
    out = faults.inject_row_drop(df, fraction)
    assert out.count() == kept
    assert out.join(df, ["id", "x"], "left_anti").count() == 0
    assert out.distinct().count() == kept


def test_row_drop_with_a_hot_row(spark):
    df = spark.range(0, 300, 1, 6).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("v"))
    assert faults.inject_row_drop(df, 0.5).count() == 150
    same = spark.range(0, 90, 1, 4).select(F.lit(1).alias("v"))
    assert faults.inject_row_drop(same, 0.5).count() == 45


def test_other_faults(spark):
    base = spark.createDataFrame(
        [(f"I{i}", 3, 2.0, 6.0) for i in range(6)], "invoice_no string, quantity long, unit_price double, net_revenue double")
    assert faults.inject_duplicates(base, ["invoice_no"], 2).count() == 8
    nulled = faults.inject_null_keys(base, ["invoice_no"], 2)
    assert nulled.filter("invoice_no IS NULL").count() == 2 and nulled.count() == 6
    assert nulled.columns == base.columns
    assert faults.inject_price_inflation(base, 2.0).agg(F.sum("net_revenue")).head()[0] == 72.0
    scaled = faults.inject_scale_quantity(base, 1.5)
    assert scaled.select("quantity").distinct().head()[0] == 4
    assert faults.inject_orphans(None, base).count() == 1
    child = faults.inject_orphans(None, base)
    assert faults.inject_orphans(child, base).count() == 2


def test_filter_never_misses_and_rarely_passes(spark):
    known = spark.range(20_000).select((F.col("id") * 3).alias("k"))
    rows = spark.range(60_000).select(F.col("id").alias("k"))
    table = key_filter.key_filter(known, ["k"], 4096)
    marked = key_filter.with_membership(rows, table, ["k"], 4096)
    assert marked.columns == ["k", "_maybe"] and marked.count() == 60_000
    assert marked.where("k % 3 = 0 AND NOT _maybe").count() == 0
    assert marked.where("k % 3 <> 0 AND _maybe").count() < 0.02 * 40_000
    assert table.count() <= 4096
    empty = key_filter.key_filter(known.where("k < 0"), ["k"], 4096)
    assert key_filter.with_membership(rows, empty, ["k"], 4096).where("_maybe").count() == 0


@pytest.mark.parametrize("blocks", [1, 64, 65_536])
def test_filtered_orphans_equal_plain_ones(pair, spark, blocks):
    """A filter of one block is full and lets everything pass; the result is the same."""
    _, _, b, _ = pair
    refs = {
        "text": spark.createDataFrame([("HOT",), ("I1",), ("I1",), (None,)], "k string"),
        "none": spark.createDataFrame([], "k string"),
        "collated": spark.sql("SELECT 'hot' COLLATE UTF8_LCASE AS k"),
    }
    for ref in refs.values():
        child = b if ref.schema["k"].dataType == b.schema["invoice_no"].dataType else b.selectExpr("invoice_no COLLATE UTF8_LCASE AS invoice_no")
        assert keys.fk_orphans_filtered(child, "invoice_no", ref, "k", blocks=blocks).head() == keys.fk_orphans(child, "invoice_no", ref, "k").head()


def test_filtered_orphans_by_group_and_type(spark):
    child = spark.sql("SELECT IF(id % 2 = 0, 'a', 'b') AS g, IF(id % 7 = 0, NULL, id % 50) AS k FROM range(1000)")
    shared = spark.sql("SELECT CAST(id AS INT) AS k FROM range(20)")  # another type: the join alone decides
    own = spark.sql("SELECT 'a' AS g, id AS k FROM range(20) UNION ALL SELECT 'c', 30")
    for ref in (shared, own):
        got = {tuple(r) for r in keys.fk_orphans_filtered(child, "k", ref, "k", ["g"]).collect()}
        assert got == {tuple(r) for r in keys.fk_orphans(child, "k", ref, "k", ["g"]).collect()} and len(got) == 2


def test_keys_shuffled_fall_with_the_hits(spark):
    child = spark.range(40_000).select(F.col("id").alias("k"))
    passed = {}
    for share in (10, 2):
        ref = spark.range(0, 40_000, share).select(F.col("id").alias("k"))
        table = key_filter.key_filter(ref, ["k"])
        passed[share] = key_filter.with_membership(child, table, ["k"]).where("_maybe").count()
    assert 4_000 <= passed[10] < 4_200 and 20_000 <= passed[2] < 20_500


@pytest.mark.parametrize("blocks", [1, 65_536])
def test_lost_rows_of_a_hot_key(spark, blocks):
    """A third of all rows share one lost key; the rows come whole, and none of a kept key."""
    rows = spark.sql(
        "SELECT IF(id % 3 = 0, 'HOT', concat('I', id)) AS invoice_no, IF(id % 3 = 0, NULL, 'S') AS stock_code, 'd' AS description, 1L AS quantity, "
        "'2011-01-01' AS invoice_date, 1D AS unit_price, CAST(NULL AS LONG) AS customer_id, 'UK' AS country FROM range(6000)"
    ).repartition(7).withColumn("stock_code", F.coalesce("stock_code", F.lit("H")))
    silver = rows.where("invoice_no <> 'HOT' AND invoice_no NOT LIKE '%7'")
    lost = keys.lost_valid_rows_counted(rows, silver, SPEC, blocks=blocks)
    assert lost.columns == rows.columns
    assert sorted(map(tuple, lost.collect()), key=str) == sorted(map(tuple, rows.where("invoice_no = 'HOT' OR invoice_no LIKE '%7'").collect()), key=str)
