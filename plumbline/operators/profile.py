"""Fused table profile: every scalar metric of a table in one shared scan.

Each function returns aggregates as SQL text by name; ``profile`` evaluates any number
of them in a single ``agg``, which reads only the columns they mention, combines on the
map side and shuffles one row per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import as_date
from plumbline.specs import PipelineSpec, RangeRule, TableSpec, quoted, ticked

ROWS = "count(1)"


def profile(df: DataFrame, metrics: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with every metric."""
    return df.groupBy(*by).agg(*[F.expr(f"{sql} AS {ticked(name)}") for name, sql in metrics.items()])


def row_count() -> dict[str, str]:
    return {"rows": ROWS}


def null_counts(df: DataFrame, columns: Iterable[str]) -> dict[str, str]:
    """NULLs per column; columns the table lacks are left out."""
    return {f"null_{c}": f"count_if({ticked(c)} IS NULL)" for c in columns if c in df.columns}


def range_name(rules: Iterable[RangeRule], rule: RangeRule) -> str:
    """Metric of a rule; further rules on the same column are numbered."""
    same = [r for r in rules if r.active and r.column == rule.column]
    place = same.index(rule) + 1
    return f"range_{rule.column}" + (f" #{place}" if place > 1 else "")


def range_violations(df: DataFrame, rules: Iterable[RangeRule]) -> dict[str, str]:
    rules = tuple(rules)
    return {
        range_name(rules, r): f"count_if({r.sql()})"
        for r in rules
        if r.active and r.column in df.columns
    }


def date_metrics(df: DataFrame, columns: Iterable[str]) -> dict[str, str]:
    """Unparseable count, earliest and latest date of each date column."""
    out: dict[str, str] = {}
    for name in dict.fromkeys(columns):
        if name not in df.columns:
            continue
        parsed = as_date(name, df.schema[name].dataType)
        out[f"unparsed_{name}"] = f"count_if({ticked(name)} IS NOT NULL AND {parsed} IS NULL)"
        out[f"min_{name}"] = f"min({parsed})"
        out[f"max_{name}"] = f"max({parsed})"
    return out


def rule_metrics(df: DataFrame, spec: TableSpec) -> dict[str, str]:
    """All scan-only metrics the rule library needs for one table."""
    dates = [*spec.date_columns]
    if spec.fresh_date:
        dates.append(spec.fresh_date)
    return {
        **row_count(),
        **null_counts(df, spec.mandatory),
        **range_violations(df, spec.ranges),
        **date_metrics(df, dates),
    }


def bronze_metrics(spec: PipelineSpec) -> dict[str, str]:
    """Catalogue metrics of Bronze: signs, validity, segments, expected revenue."""
    quantity, price, valid = quoted(spec.quantity), quoted(spec.price), spec.valid_row()
    value = f"CAST({quantity} AS DOUBLE) * CAST({price} AS DOUBLE)"
    return {
        "negative_quantity": f"count_if({quantity} < 0)",
        "negative_price": f"count_if({price} < 0)",
        "valid_rows": f"count_if({valid})",
        "valid_high": f"count_if({valid} AND {spec.high_segment})",
        "valid_low": f"count_if({valid} AND {spec.low_segment})",
        "explained": f"count_if({quantity} <= 0 OR {price} <= 0)",
        "expected_revenue": f"sum({value}) FILTER (WHERE {spec.sellable_row()})",
    }


def silver_metrics(df: DataFrame, spec: PipelineSpec) -> dict[str, str]:
    """Catalogue metrics of Silver. A NULL quantity falls into the low segment."""
    out: dict[str, str] = {}
    if spec.quantity in df.columns:
        high = f"coalesce({spec.high_segment}, false)"
        out["nonpositive_quantity"] = f"count_if({quoted(spec.quantity)} <= 0)"
        out["high_rows"] = f"count_if({high})"
        out["low_rows"] = f"count_if(NOT {high})"
    if spec.price in df.columns:
        out["nonpositive_price"] = f"count_if({quoted(spec.price)} <= 0)"
    if spec.revenue in df.columns:
        out["negative_revenue"] = f"count_if({quoted(spec.revenue)} < 0)"
        out["revenue"] = f"sum(CAST({quoted(spec.revenue)} AS DOUBLE))"
    return out


def gold_metrics(df: DataFrame) -> dict[str, str]:
    """The single Gold row of a group, read as aggregates."""
    names = ("total_revenue", "total_orders", "total_customers", "average_order_value")
    return {c: f"max(CAST({c} AS DOUBLE))" for c in names if c in df.columns}
