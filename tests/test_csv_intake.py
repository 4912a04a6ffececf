"""Malformed CSV lines go to quarantine and are missed by the row counts of Bronze."""

import pytest
from pyspark.errors import AnalysisException

from fixtures import GOLDEN_DATE, by_id, gate_tables
from plumbline import validate
from plumbline.sources import csv_intake

HEADER = "invoice_no,stock_code,description,quantity,invoice_date,unit_price,customer_id,country\n"
LINES = [
    'I1,A,plain,1,2026-06-17,2.5,7,UK',
    'I2,A,"quoted, with ""marks""",2,2026-06-17,2.5,7,UK',
    'I3,A,short,1,2026-06-17',
    'I4,A,long,1,2026-06-17,2.5,7,UK,more,fields',
    'I5,A,typed,many,2026-06-17,2.5,seven,UK',
    'I6,A,,3,,2.5,,UK',
    'I7,A,overflow,99999999999999999999,2026-06-17,2.5,7,UK',
]


def test_bad_lines_are_set_aside_with_a_reason(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEADER + "\n".join(LINES) + "\n")
    (tmp_path / "in" / "b.csv").write_text(HEADER)
    found = csv_intake.intake_orders(spark, str(tmp_path / "in"))
    assert sorted(r["invoice_no"] for r in found.rows.collect()) == ["I1", "I2", "I6"]
    assert found.source.count() == 7
    by_line = {r["line"][:2]: r for r in found.quarantine.collect()}
    assert {k: r["reason"] for k, r in by_line.items()} == {
        "I3": "not 8 well-formed fields",
        "I4": "not 8 well-formed fields",
        "I5": "quantity is no bigint; customer_id is no bigint",
        "I7": "quantity is no bigint",
    }
    assert by_line["I3"]["file"] == "a.csv" and by_line["I4"]["line"] == LINES[3]
    marks = {r["invoice_no"]: r["description"] for r in found.rows.collect()}
    assert marks["I2"] == 'quoted, with "marks"' and marks["I6"] is None


def test_counts_reach_the_checks(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(HEADER + "\n".join(LINES) + "\n")
    (tmp_path / "history.csv").write_text("run_id,bronze_count,silver_count,drop_pct,gold_revenue\nr1,1,1,0.0,5\nr2,x,1,0,5\n")
    orders = csv_intake.intake_orders(spark, str(tmp_path / "raw.csv"))
    history = csv_intake.intake_history(spark, str(tmp_path / "history.csv"))
    assert history.rows.count() == 1 and history.quarantine.head()["reason"] == "bronze_count is no bigint"
    rows = by_id(validate(csv_intake.intake_layers(orders, history), run_date=GOLDEN_DATE).results)
    assert rows["B1"]["status"] == "FAIL" and "7" in rows["B1"]["detail"] and "3" in rows["B1"]["detail"]
    counts = csv_intake.quarantine_counts({"raw_orders": orders, "historical_runs": history})
    assert sorted(map(tuple, counts.collect())) == [("historical_runs", 2, 1), ("raw_orders", 7, 4)]


def test_line_breaks_inside_quotes(spark, tmp_path):
    text = HEADER + 'I1,A,"two\nlines",1,2026-06-17,2.5,7,UK\nI2,A,"two\nlines",many,2026-06-17,2.5,7,UK\n'
    (tmp_path / "raw.csv").write_text(text)
    found = csv_intake.intake_orders(spark, str(tmp_path / "raw.csv"), multi_line=True)
    assert [r["description"] for r in found.rows.collect()] == ["two\nlines"]
    assert found.quarantine.head()["reason"] == "quantity is no bigint"


def test_missing_and_empty_files(spark, tmp_path):
    assert csv_intake.intake_history(spark, str(tmp_path / "none.csv")) is None
    with pytest.raises(AnalysisException):
        csv_intake.intake_orders(spark, str(tmp_path / "none.csv"))
    (tmp_path / "empty.csv").write_text("")
    found = csv_intake.intake_orders(spark, str(tmp_path / "empty.csv"))
    assert found.source.count() == found.quarantine.count() == 0


def test_gate_files(spark, tmp_path):
    for name, df in gate_tables(spark).items():
        df.limit(5).write.option("header", True).csv(str(tmp_path / f"{name}.csv"))
    found = csv_intake.intake_gate(spark, str(tmp_path))
    assert {n: t.rows.count() for n, t in found.items()} == {n: 5 for n in found}
    with pytest.raises(AnalysisException):
        csv_intake.intake_gate(spark, str(tmp_path / "elsewhere"))
