"""Scenarios counted together give the results of stacked copies, check by check."""

import pytest
from pyspark.sql import functions as F

from fixtures import GOLDEN_DATE, healthy, orders, with_revenue
from plumbline.operators import faults, keys, versions
from plumbline.operators.faults import Change
from plumbline.operators.versions import Versions
from plumbline.plans.run import validate
from plumbline.plans.scenarios import Scenario, validate_scenarios
from plumbline.sources.layers import build_gold_metrics, land_layers
from plumbline.specs import PipelineSpec

SPEC = PipelineSpec()
COMPARED = ("pipeline", "check_id", "layer", "status", "detected_status", "observed", "expected", "detail", "extra")


def told(results):
    return {tuple(str(r[c]) for c in COMPARED) for r in results.select(*COMPARED).collect()}


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    tables = healthy(spark, 100)
    # Equal rows, so that a choice of rows can end among them.
    lines = tables["bronze_orders"]
    more = orders(spark, 1, start=500, quantity=3)
    tables["bronze_orders"] = lines.unionByName(reduce_union([more] * 6))
    tables["silver_orders"] = with_revenue(tables["bronze_orders"])
    picked = {n: tables[n] for n in ("bronze_orders", "silver_orders", "historical_runs") if n in tables}
    paid = tables["bronze_orders"].selectExpr(
        "concat('PAY', invoice_no) AS payment_id", "invoice_no", "unit_price AS amount"
    )
    return land_layers(picked | {"order_payments": paid}, str(tmp_path_factory.mktemp("layers")))


def reduce_union(frames):
    first, *rest = frames
    for df in rest:
        first = first.unionByName(df)
    return first


def changes_of(silver):
    return {
        "healthy": Change(),
        "row_drop": faults.row_drop_change(silver, 0.3),
        "duplicates": faults.duplicates_change(silver, ["invoice_no"], 103),
        "price": faults.price_change(2.0),
        "null_keys": faults.null_keys_change(silver, ["invoice_no"], 103),
        "quantity": faults.quantity_change(silver, 0.5),
        "documents": Change(values={"invoice_no": "concat('X', substring(invoice_no, 1, 5))"}),
        "nothing": Change("FALSE"),
    }


def test_same_as_stacked_copies(spark, base):
    silver, paid = base["silver_orders"], base["order_payments"]
    changes = changes_of(silver)
    orphan = faults.orphans_change(base["bronze_orders"], paid)
    cases = {c: Scenario({"silver_orders": change}) for c, change in changes.items()}
    cases["price"] = Scenario({"silver_orders": changes["price"]}, gold_of="healthy")
    cases["orphans"] = Scenario({"order_payments": orphan})
    found = told(validate_scenarios(base, cases, run_date=GOLDEN_DATE).results)

    stacked = {}
    made = Versions(silver, {**changes, "orphans": Change()})
    for case in made.changes:
        rows = made.rows(case)
        gold = build_gold_metrics(silver if case == "price" else rows)
        payments = paid.unionByName(orphan.added) if case == "orphans" else paid
        stacked[case] = {**base, "silver_orders": rows, "gold_metrics": gold, "order_payments": payments}
    wanted = told(validate(faults.stack_cases(stacked), run_date=GOLDEN_DATE).results)
    assert {r[:2] for r in found} == {r[:2] for r in wanted}
    assert sorted(found - wanted) == sorted(wanted - found) == []


def test_changes_equal_injections(spark, base):
    silver = base["silver_orders"]
    made = Versions(silver, changes_of(silver))
    same = {
        "row_drop": faults.inject_row_drop(silver, 0.3),
        "duplicates": faults.inject_duplicates(silver, ["invoice_no"], 103),
        "price": faults.inject_price_inflation(silver, 2.0),
        "null_keys": faults.inject_null_keys(silver, ["invoice_no"], 103),
        "quantity": faults.inject_scale_quantity(silver, 0.5),
    }
    for case, df in same.items():
        rows = made.rows(case).select(*df.columns)
        assert rows.exceptAll(df).isEmpty() and df.exceptAll(rows).isEmpty(), case


def test_keyed_counts(spark):
    base = spark.createDataFrame(
        [("a", 1), ("a", 1), ("b", 2), (None, 3), (None, 3), ("c", None)], "k string, x int"
    )
    added = spark.createDataFrame([("b", 2), ("z", 9)], "k string, x int")
    made = Versions(base, {
        "same": Change(), "less": Change("x IS NULL OR x > 1"), "more": Change(added=added),
        "upper": Change(values={"k": "'all'"}), "halved": Change(values={"x": "x DIV 4"}), "empty": Change("FALSE"),
    })
    ref = Versions(spark.createDataFrame([("a",), ("b",), ("b",)], "r string"), {c: Change() for c in made.changes})
    for case in made.changes:
        rows, of = made.rows(case), F.col("pipeline") == case
        one = lambda df: df.where(of).drop("pipeline").first()[0]
        assert one(versions.duplicate_excess(made, ["k"])) == keys.duplicate_excess(rows, ["k"]).first()[0]
        assert one(versions.full_row_duplicates(made)) == keys.full_row_duplicates(rows).first()[0]
        assert one(versions.distinct_count(made, "k")) == keys.distinct_count(rows, "k").first()[0]
        wanted = keys.fk_orphans(rows, "k", ref.base, "r").first()[0]
        assert one(versions.fk_orphans(made, "k", ref, "r")) == wanted
        total = versions.profile(made, {"rows": "count(1)", "x": "sum(x)"}).where(of).first()
        assert ((total["rows"] or 0), total["x"]) == tuple(rows.selectExpr("count(1)", "sum(x)").first())


def test_reference_with_changes(spark):
    child = Versions(spark.createDataFrame([("a",), ("b",)], "k string"), {"full": Change(), "less": Change()})
    ref = spark.createDataFrame([("a",), ("b",)], "r string")
    found = versions.fk_orphans(child, "k", Versions(ref, {"full": Change(), "less": Change("r = 'a'")}), "r")
    assert {r["pipeline"]: r["orphans"] for r in found.collect()} == {"full": 0, "less": 1}


def test_bronze_is_read_once_and_not_copied(base):
    plain = {"healthy": Change(), "less": Change("quantity > 1"), "price": faults.price_change(2.0)}
    silver = Versions(base["silver_orders"], plain)
    plan = versions.key_census(base["bronze_orders"], silver, SPEC)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Join" not in plan
    assert plan.count("/bronze_orders") <= 1


def test_what_cannot_be_changed(base):
    with pytest.raises(ValueError, match="bronze_orders"):
        validate_scenarios(base, {"x": Scenario({"bronze_orders": Change("FALSE")})})
