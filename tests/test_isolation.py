"""Group testing of metrics that fail, names, scopes and types that checks must survive."""

import decimal

import pytest
from pyspark.sql import functions as F

from fixtures import GOLDEN_DATE, by_id, healthy, orders, with_revenue
from plumbline import PipelineSpec, TableSpec, validate
from plumbline.operators import keys, profile
from plumbline.operators.isolation import isolate
from plumbline.plans import metrics, run
from plumbline.specs import RangeRule, bound

METRICS = {"rows": "count(1)"} | {f"m{k}": str(k) for k in range(29)}


def counting(bad):
    tries = []

    def attempt(part):
        tries.append(sorted(part))
        if bad & set(part):
            raise ValueError("broken, token=abc")
        return dict(part)

    return tries, attempt


@pytest.mark.parametrize("bad, most", [({"m7"}, 10), ({"m28"}, 10), ({"m3", "m20"}, 20)])
def test_halving_finds_what_fails(bad, most):
    tries, attempt = counting(bad)
    found = isolate(METRICS, attempt, "rows")
    assert set(found.failures) == bad and "token=***" in found.failures[min(bad)]
    assert {m for part in found.results for m in part} == set(METRICS) - bad
    assert len(tries) <= most


def test_an_unreadable_table_is_given_up_at_once():
    tries, attempt = counting(set(METRICS))
    assert set(isolate(METRICS, attempt, "rows").failures) == set(METRICS) and len(tries) == 3


def test_interrupts_leave_the_search():
    def attempt(part):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        isolate({"a": "1"}, attempt)


def test_a_lost_executor_costs_one_retry(spark, monkeypatch):
    computed, tries = run._computed, []

    def flaky(sheet):
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError("executor lost")
        return computed(sheet)

    monkeypatch.setattr(run, "_computed", flaky)
    monkeypatch.setattr(metrics.MetricSheet, "probe", lambda self: pytest.fail("no isolation is needed"))
    rows = by_id(validate(healthy(spark, 10), run_date=GOLDEN_DATE).results)
    assert len(tries) == 2 and rows["S5"]["status"] == "PASS"


# --- Gold rows, scopes, names, bounds, types -----------------------------------------


def test_two_gold_rows_fail(spark):
    layers = healthy(spark, 10)
    extra = layers["gold_metrics"].withColumns({"total_revenue": F.lit(0.5), "total_orders": F.lit(1).cast("long")})
    layers["gold_metrics"] = layers["gold_metrics"].unionByName(extra)
    rows = by_id(validate(layers, run_date=GOLDEN_DATE).results)
    reconciled = [i for i in rows if i in ("G1", "G2", "G3", "G4") or i.startswith(("L2-REC-REV", "L2-REC-AGG"))]
    assert len(reconciled) == 6
    assert all(rows[i]["status"] == "FAIL" and "2 rows" in rows[i]["detail"] for i in reconciled)


def test_a_layer_without_pipelines_serves_them_all(spark):
    def both(df, name="pipeline"):
        return df.withColumn(name, F.explode(F.array(F.lit("a"), F.lit("b"))))

    layers = healthy(spark, 10)
    plain = {"gold_metrics", "historical_runs"}
    layers = {n: df if n in plain else both(df) for n, df in layers.items()}
    results = validate(layers, run_date=GOLDEN_DATE).results
    for pipeline in ("a", "b"):
        rows = by_id(results.where(F.col("pipeline") == pipeline))
        assert rows["G1"]["status"] == rows["G2"]["status"] == rows["G4"]["status"] == "PASS"
        assert rows["L1-GOL-COMP-EMPTY"]["status"] == "PASS"
        assert all(r["status"] != "SKIPPED" for i, r in rows.items() if i.startswith("L3-ANO"))
    assert {r[0] for r in results.select("pipeline").distinct().collect()} == {"a", "b"}


def test_any_column_name(spark):
    name = "a`b.c d"
    df = spark.createDataFrame([(1, None), (1, 2), (1, 2)], ["k", name])
    assert profile.profile(df, profile.null_counts(df, [name])).head()[0] == 1
    assert keys.full_row_duplicates(df).head()[0] == keys.full_row_duplicates_two_pass(df).head()[0] == 1
    assert keys.duplicate_excess(df, [name]).head()[0] == 1
    spec = PipelineSpec(tables=(TableSpec("t", "Silver", mandatory=("k", name)),))
    rows = by_id(validate({"t": df}, spec, run_date=GOLDEN_DATE).results)
    nulls = [r for i, r in rows.items() if "COMP-NULL" in i]
    assert nulls and all(r["status"] == "FAIL" for r in nulls)


@pytest.mark.parametrize("value, text", [(9007199254740993, "9007199254740993"), (5, "5"), (2.0, "2"), (0.5, "0.5D"),
                                         (decimal.Decimal("0.1"), "0.1BD"), (10**20, str(10**20))])
def test_bounds_are_exact(value, text):
    assert bound(value) == text


def test_a_bound_of_sixteen_digits_is_kept(spark):
    df = spark.createDataFrame([(9007199254740992,), (9007199254740993,)], "v long")
    found = profile.profile(df, profile.range_violations(df, [RangeRule("v", min=9007199254740993)]))
    assert found.head()[0] == 1


def test_full_row_duplicates_of_every_type(spark):
    row = """SELECT parse_json('{"b": [1, null], "a": "x"}') AS v, map('k', array(map(1, 2, 3, 4))) AS m,
      named_struct('n', map('p', parse_json('7'))) AS s, array(named_struct('w', parse_json('null'))) AS a,
      CAST(NULL AS VARIANT) AS nothing, X'00ff' AS bin, DATE'2020-01-01' AS d, 1.10BD AS dec, INTERVAL '3' DAY AS i,
      'Q' COLLATE UTF8_LCASE AS c"""
    other = row.replace('{"b": [1, null], "a": "x"}', '{"b": [1, 2], "a": "x"}')
    swapped = row.replace("map(1, 2, 3, 4)", "map(3, 4, 1, 2)").replace('"b": [1, null], "a": "x"', '"a": "x", "b": [1, null]').replace("'Q'", "'q'")
    nulled = row.replace("named_struct('n', map('p', parse_json('7')))", "CAST(NULL AS STRUCT<n: MAP<STRING, VARIANT>>)")
    df = spark.sql(" UNION ALL ".join([row, other, swapped, row, nulled]))
    assert keys.full_row_duplicates(df).head()[0] == keys.full_row_duplicates_two_pass(df).head()[0] == 2


def test_silver_with_a_variant_is_checked(spark):
    layers = healthy(spark, 10)
    layers["silver_orders"] = with_revenue(orders(spark, 10)).withColumn("note", F.expr("parse_json('{\"a\": 1}')"))
    rows = by_id(validate(layers, run_date=GOLDEN_DATE).results)
    assert rows["L1-SIL-UNIQ-FULL"]["status"] == "PASS"
