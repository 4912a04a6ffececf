"""Exact selection of rows by order or hash, whatever the files look like."""

import datetime as dt
import decimal
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import faults, selection
from plumbline.operators.selection import by_columns, double_order, first_rows, hash_numbers

SCHEMA = "k bigint, s string, x double, d date, m decimal(20,3)"


def rows(n, seed=1):
    rng = random.Random(seed)
    pick = lambda *values: rng.choice(values)
    return [
        (
            pick(None, rng.randint(-5, 5), rng.randint(-(1 << 63), (1 << 63) - 1)),
            pick(None, "", "a", "a\x00", "ab", "prefix shared by many " + str(rng.randint(0, 30)), "é" * rng.randint(1, 9)),
            pick(None, 0.0, 5e-324, -1.5, math.inf, rng.gauss(0, 1), rng.uniform(-1e300, 1e300)),
            pick(None, dt.date(2020, 1, rng.randint(1, 28))),
            pick(None, decimal.Decimal(rng.randint(-(10**19), 10**19)).scaleb(-3)),
        )
        for _ in range(n)
    ]


def counted(df):
    return Counter(map(str, map(tuple, df.collect())))


@pytest.mark.parametrize("order, bins", [(["k"], 4), (["s"], 1 << 16), (["x"], 8), (["m"], 1 << 16), (["d", "s"], 8)])
def test_first_rows_as_a_sort_would_take_them(spark, monkeypatch, order, bins):
    monkeypatch.setattr(selection, "BINS", bins)
    df = spark.createDataFrame(rows(150), SCHEMA).repartition(3)
    ranked = [r[0] for r in df.orderBy(*order).select(F.struct(*order)).collect()]
    for n in (1, 77):
        picked = first_rows(df, n, by_columns(df, order))
        keys = [r[0] for r in picked.rows().orderBy(*order).select(F.struct(*order)).collect()]
        assert str(keys) == str(ranked[:n])
        assert counted(picked.rows()) + counted(picked.others()) == counted(df)


def test_edges_of_n(spark):
    df = spark.createDataFrame(rows(20), SCHEMA)
    for n in (0, 20, 50):
        picked = first_rows(df, n, by_columns(df, ["k"]))
        assert picked.rows().count() == min(n, 20) and picked.others().count() == max(0, 20 - n)
    assert first_rows(df.where("false"), 5, by_columns(df, ["k"])).rows().count() == 0


def test_double_order_is_the_bit_pattern(spark):
    values = [0.0, 5e-324, 2.2250738585072009e-308, 2.2250738585072014e-308, 1.0, 1.9999999999999998, 2.0, math.pi, 1e308]
    values += [math.nextafter(2.0**e, side) for e in (-1000, -3, 0, 5, 52, 1000) for side in (0, math.inf)] + [1.7976931348623157e308, math.inf]
    values += [-v for v in values] + [math.nan]
    found = spark.createDataFrame([(v,) for v in values], "x double").selectExpr("x", f"{double_order('x')} AS n").collect()
    import struct

    for r in found:
        bits = struct.unpack("<q", struct.pack("<d", abs(r["x"])))[0]
        want = (2047 << 52) + 1 if math.isnan(r["x"]) else (bits if r["x"] > 0 else -bits)
        assert r["n"] == want, r


def test_same_rows_from_any_files(spark, tmp_path):
    """The rows that stay depend on what they hold, not on files, partitions or repetition."""
    base = spark.createDataFrame(rows(900, 5) + [(7, "same", 1.0, None, None)] * 500, SCHEMA)
    kept = []
    for files in (2, 5, 1):
        base.repartition(files).write.parquet(str(tmp_path / str(files)))
        df = spark.read.parquet(str(tmp_path / str(files)))
        kept.append(counted(faults.inject_row_drop(df, 0.3)))
    assert kept[0] == kept[1] == kept[2] and sum(kept[0].values()) == 979  # int(1400 * 0.7)


@pytest.mark.parametrize("n", [3, 250, 399])
def test_copies_of_one_row_are_split(spark, monkeypatch, n):
    monkeypatch.setattr(selection, "COPIES", 7)
    df = spark.createDataFrame([(1, "x")] * 400, "k int, s string").repartition(4)
    picked = first_rows(df, n, hash_numbers(df))
    assert picked.rows().count() == n and picked.others().count() == 400 - n
    assert picked.rows().distinct().count() == 1


def test_faults_choose_as_an_order_says(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("invoice_no"), F.lit(1.0).alias("x")).repartition(7)
    doubled = faults.inject_duplicates(df, ["invoice_no"], 300).groupBy("invoice_no").count().where("count = 2")
    assert sorted(r[0] for r in doubled.collect()) == list(range(300))
    blanked = faults.inject_null_keys(df, ["invoice_no"], 300)
    assert blanked.schema == df.schema or blanked.columns == df.columns
    assert sorted(r[0] for r in blanked.where("invoice_no IS NOT NULL").collect()) == list(range(300, 1000))
    assert blanked.count() == 1000


def test_no_sort_and_no_window_in_the_plan(spark):
    df = spark.range(100).select(F.col("id").alias("invoice_no"))
    plan = faults.inject_duplicates(df, ["invoice_no"], 30)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "TakeOrdered" not in plan


def test_types_without_an_order_are_named(spark):
    with pytest.raises(TypeError, match="'m'"):
        first_rows(spark.sql("SELECT explode(array(map('a', 1), map('b', 2))) AS m"), 1, by_columns(spark.sql("SELECT map('a', 1) AS m"), ["m"]))
