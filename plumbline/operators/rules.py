"""Rule library: exact checks compiled from table specs, one set per table."""

from __future__ import annotations

import datetime as dt
from functools import partial

from plumbline.functions.sql import case, concat, grouped, json_number, json_object, json_string, pass_or, text
from plumbline.functions.values import as_date
from plumbline.model import (
    COMPLETENESS,
    CONSISTENCY,
    FAIL,
    PASS,
    RULES,
    TIMELINESS,
    UNIQUENESS,
    VALIDITY,
    WARN,
)
from plumbline.operators.bronze import amount, duplicate_sql, null_report, null_sql
from plumbline.operators.check import Check, Rule, run_checks, skipped
from plumbline.operators.profile import range_name
from plumbline.plans.metrics import MetricSheet, fk_state
from plumbline.specs import RangeRule, TableSpec, quoted


def _check(table: TableSpec, suffix: str, name: str, dimension: str, **fields) -> Check:
    return Check(
        check_id=f"L1-{table.tag}-{suffix}",
        check_name=name,
        layer=table.layer,
        dimension=dimension,
        detection_layer=RULES,
        table=table.name,
        **fields,
    )


def _count_check(
    table: TableSpec, suffix: str, name: str, dimension: str, count: str,
    clean: str, dirty: str, evidence: str, severity: str = FAIL, **fields,
) -> Check:
    """A check that passes when a count of offending rows is zero."""
    return _check(
        table, suffix, name, dimension,
        status=pass_or(f"{count} = 0", severity),
        detail=amount(count, clean, dirty),
        observed=json_number(count), expected="'0'", value=count, evidence=evidence, **fields,
    )


def _empty(table: TableSpec, sheet: MetricSheet) -> Check:
    rows = sheet.number(table.name, "rows")
    return _check(
        table, "COMP-EMPTY", "Empty Table Check", COMPLETENESS,
        status=pass_or(f"{rows} > 0"),
        detail=case((f"{rows} > 0", text("The table holds rows.")), otherwise=text("The table is empty.")),
        observed=json_number(rows), expected=json_string(text("> 0")), value=rows,
        evidence=f"SELECT COUNT(*) FROM {table.name}",
    )


def _nulls(table: TableSpec, sheet: MetricSheet) -> Check:
    observed, zeros, nulls = null_report(sheet, table.name, table.mandatory)
    found = concat(text("Nulls in mandatory columns: "), observed, text("."))
    return _check(
        table, "COMP-NULL", "Mandatory Column Null Check", COMPLETENESS,
        status=pass_or(f"{nulls} = 0"),
        detail=case((f"{nulls} = 0", text("Mandatory columns hold no nulls.")), otherwise=found),
        observed=observed, expected=zeros, value=nulls,
        evidence=null_sql(sheet, table.name, table.mandatory),
    )


def _source_count(table: TableSpec, sheet: MetricSheet) -> Check | None:
    if not table.source_table or not sheet.has_table(table.source_table):
        return None
    rows = sheet.number(table.name, "rows")
    source = sheet.number(table.source_table, "rows")
    same = f"{rows} = {source}"
    found = concat(text("Source holds "), grouped(source), text(" rows, the table "), grouped(rows), text("."))
    return _check(
        table, "COMP-SRC", "Source to Table Row Count", COMPLETENESS,
        status=pass_or(same),
        detail=case((same, text("Source and table hold the same number of rows.")), otherwise=found),
        observed=json_number(rows), expected=json_number(source), value=rows,
        evidence=f"SELECT COUNT(*) FROM {table.name}",
    )


def _range_name(table: TableSpec, rule: RangeRule) -> str:
    """The column, and the bounds where a column has several rules."""
    same = [r for r in table.ranges if r.active and r.column == rule.column]
    return f"Range Check: {rule.column}" + (f" ({rule.key})" if len(same) > 1 else "")


def _ranges(table: TableSpec, sheet: MetricSheet) -> list[Check]:
    return [
        _count_check(
            table, f"VAL-{rule.column[:4].upper()}", _range_name(table, rule), VALIDITY,
            sheet.number(table.name, range_name(table.ranges, rule)),
            f"Every {rule.column} is in range.", f" rows have {rule.column} out of range.",
            f"SELECT COUNT(*) FROM {table.name} WHERE {rule.sql()}",
            extra={"column": text(rule.column)},
        )
        for rule in table.ranges
        if rule.active and rule.column in sheet.columns(table.name)
    ]


def _parsed(table: TableSpec, column: str, sheet: MetricSheet) -> str:
    """The very expression that the date metrics parse a column with."""
    return as_date(column, sheet.layers[table.name].schema[column].dataType)


def _dates(table: TableSpec, sheet: MetricSheet) -> list[Check]:
    return [
        _count_check(
            table, "VAL-DATE", f"Date Parse Validity: {column}", VALIDITY,
            sheet.number(table.name, f"unparsed_{column}"),
            f"Every {column} is a date.", f" rows have a {column} that is no date.",
            f"SELECT COUNT(*) FROM {table.name} WHERE {quoted(column)} IS NOT NULL AND {_parsed(table, column, sheet)} IS NULL",
            extra={"column": text(column)},
        )
        for column in table.date_columns
        if column in sheet.columns(table.name)
    ]


def _primary_key(table: TableSpec, sheet: MetricSheet) -> Check | None:
    if not table.primary_key:
        return None
    sheet.need(table.name, *table.primary_key)
    shared = sheet.document_excess.get(table.name)
    excess = sheet.number("keys", shared) if shared else sheet.number(f"{table.name}_pk", "excess")
    return _count_check(
        table, "UNIQ-PK", "Primary Key Duplicate Check", UNIQUENESS, excess,
        "The primary key is unique.", " rows repeat a primary key.",
        duplicate_sql(table.name, table.primary_key),
    )


def _full_row(table: TableSpec, sheet: MetricSheet) -> Check:
    return _count_check(
        table, "UNIQ-FULL", "Full Row Duplicate Check", UNIQUENESS,
        sheet.number(f"{table.name}_row", "excess"),
        "No row occurs twice.", " rows are copies of another row.",
        f"SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {table.name})) FROM {table.name}",
        WARN,
    )


def _foreign_keys(table: TableSpec, sheet: MetricSheet) -> list[Check]:
    out = []
    for fk in table.foreign_keys:
        tag = (fk.ref_table or "REF")[:4].upper()
        name = f"Foreign Key Integrity: {fk.column}"
        if fk.ref_table:
            name += f" -> {fk.ref_table}.{fk.ref_column}"
        reason = fk_state(sheet.layers, table.name, fk)
        if reason:
            out.append(skipped(f"L1-{table.tag}-CONS-FK-{tag}", name, table.layer, reason, RULES))
            continue
        out.append(
            _count_check(
                table, f"CONS-FK-{tag}", name, CONSISTENCY,
                sheet.number(fk.frame(table.name), "orphans"),
                "Every reference has a target.",
                f" rows point to a missing {fk.ref_table}.{fk.ref_column}"
                " (swaps between existing keys are not visible here).",
                f"SELECT COUNT(*) FROM {table.name} c WHERE c.{quoted(fk.column)} IS NOT NULL AND NOT EXISTS "
                f"(SELECT 1 FROM {fk.ref_table} r WHERE r.{quoted(fk.ref_column)} = c.{quoted(fk.column)})",
            )
        )
    return out


def freshness_status(latest: str, run_date: str, ahead: int, back: int) -> str:
    """FAIL in the future, WARN when stale or unknown; both limits are inclusive."""
    return case(
        (f"{latest} IS NULL", text(WARN)),
        (f"{latest} > date_add({run_date}, {ahead})", text(FAIL)),
        (f"{latest} < date_sub({run_date}, {back})", text(WARN)),
        otherwise=text(PASS),
    )


def span_status(first: str, last: str, days: int) -> str:
    return case(
        (f"{last} IS NULL", text(WARN)),
        (f"datediff({last}, {first}) <= {days}", text(PASS)),
        otherwise=text(WARN),
    )


def _freshness(table: TableSpec, sheet: MetricSheet, run_date: dt.date) -> Check | None:
    column = table.fresh_date
    if not column or column not in sheet.columns(table.name):
        return None
    ahead = table.max_future_days or 0
    back = 365 if table.freshness_days is None else table.freshness_days
    today = f"DATE '{run_date}'"
    latest = sheet.metric(table.name, f"max_{column}")
    status = freshness_status(latest, today, ahead, back)
    shown = concat(text(f"Latest {column} "), f"CAST({latest} AS STRING)")
    detail = case(
        (f"{latest} IS NULL", text("No parseable date to judge freshness by.")),
        (f"{status} = '{FAIL}'",
         concat(shown, text(f" lies in the future (more than {ahead} days after the run)."))),
        (f"{status} = '{WARN}'", concat(shown, text(f" is stale (more than {back} days before the run)."))),
        otherwise=concat(shown, text(" is fresh.")),
    )
    observed = json_object(
        max_date=f"CAST({latest} AS STRING)",
        run_date=text(run_date.isoformat()),
        max_future_days=str(ahead),
        expected_freshness_days=str(back),
    )
    goal = case(
        (f"{latest} IS NULL", text("parseable max date")),
        otherwise=text(f"max_date <= run_date + {ahead}d and not stale"),
    )
    return _check(
        table, "TIME-FRESH", f"Date Freshness: {column}", TIMELINESS,
        status=status, detail=detail,
        observed=case((f"{latest} IS NOT NULL", observed)),
        expected=json_string(goal),
        value=f"datediff({today}, {latest})",
        evidence=(
            f"SELECT MAX({_parsed(table, column, sheet)}) AS max_d, {today} AS run_date "
            f"FROM {table.name} WHERE {quoted(column)} IS NOT NULL"
        ),
        extra={"column": text(column)},
    )


def _span(table: TableSpec, sheet: MetricSheet) -> list[Check]:
    out = []
    for column in table.date_columns if table.span_days else ():
        if column not in sheet.columns(table.name):
            continue
        first = sheet.metric(table.name, f"min_{column}")
        last = sheet.metric(table.name, f"max_{column}")
        days = f"datediff({last}, {first})"
        none = f"{last} IS NULL"
        shown = concat(
            text("Dates span "), f"CAST({days} AS STRING)", text(f" days, allowed are {table.span_days}.")
        )
        out.append(
            _check(
                table, "TIME", f"Timeliness Window: {column}", TIMELINESS,
                status=span_status(first, last, table.span_days),
                detail=case((none, text("No parseable date to measure the span of.")), otherwise=shown),
                observed=json_string(concat(text("span="), f"CAST({days} AS STRING)", text("d"))),
                expected=json_string(
                    case((none, text(f"within {table.span_days} days")), otherwise=text(f"<= {table.span_days}d"))
                ),
                value=days,
                evidence=(
                    f"SELECT MIN({_parsed(table, column, sheet)}), MAX({_parsed(table, column, sheet)}) FROM {table.name}"
                ),
                extra={"column": text(column)},
            )
        )
    return out


def run_rule_library(sheet: MetricSheet, run_date: dt.date) -> list[Check]:
    """All rules of every table that exists, in spec order."""
    out: list[Check] = []
    for table in sheet.spec.tables:
        if not sheet.has_table(table.name):
            continue
        # Group ids and names shown when a rule cannot be evaluated.
        rules = (
            ("COMP-EMPTY", "Empty Table Check", partial(_empty, table)),
            ("COMP-NULL", "Mandatory Column Null Check", partial(_nulls, table)),
            ("COMP-SRC", "Source to Table Row Count", partial(_source_count, table)),
            ("VAL-RANGE", "Range Checks", partial(_ranges, table)),
            ("VAL-DATE", "Date Parse Validity", partial(_dates, table)),
            ("UNIQ-PK", "Primary Key Duplicate Check", partial(_primary_key, table)),
            ("UNIQ-FULL", "Full Row Duplicate Check", partial(_full_row, table)),
            ("CONS-FK", "Foreign Key Integrity", partial(_foreign_keys, table)),
            ("TIME-FRESH", "Date Freshness", partial(_freshness, table, run_date=run_date)),
            ("TIME", "Timeliness", partial(_span, table)),
        )
        out += run_checks(
            sheet,
            [Rule(f"L1-{table.tag}-{s}", name, table.layer, build, RULES) for s, name, build in rules],
        )
    return out
