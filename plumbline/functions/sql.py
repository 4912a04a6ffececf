"""Builders of Spark SQL expression text.

Checks are scalar logic over one metric row. As SQL text a check is a single
expression to parse; composed call by call from Column objects it would cost hundreds
of round trips between Python and the JVM.
"""

from __future__ import annotations

import json

from plumbline.model import FAIL, PASS, SEVERITY_ORDER, WARN


def text(value: str | None) -> str:
    """String literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def case(*branches: tuple[str, str], otherwise: str | None = None) -> str:
    body = " ".join(f"WHEN {condition} THEN {value}" for condition, value in branches)
    tail = f" ELSE {otherwise}" if otherwise is not None else ""
    return f"(CASE {body}{tail} END)"


def concat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def between(value: str, low: str | float, high: str | float) -> str:
    return f"({value} BETWEEN {low} AND {high})"


def total(values: list[str]) -> str:
    return f"({' + '.join(values)})" if values else "0"


# Status ---------------------------------------------------------------------


def pass_or(ok: str, otherwise: str = FAIL) -> str:
    return case((ok, text(PASS)), otherwise=text(otherwise))


def ladder(passes: str, warns: str) -> str:
    """PASS, else WARN, else FAIL."""
    return case((passes, text(PASS)), (warns, text(WARN)), otherwise=text(FAIL))


_RANKED = f"array({', '.join(text(s) for s in SEVERITY_ORDER)})"


def severity(status: str) -> str:
    """Rank of a status; NULL for SKIPPED, so that max() passes over it."""
    return f"nullif(array_position({_RANKED}, {status}), 0)"


def status_of(rank: str) -> str:
    """Inverse of :func:`severity`; no rank at all (only skips) is PASS."""
    return f"element_at({_RANKED}, CAST(coalesce({rank}, 1) AS INT))"


def worst_status(status: str) -> str:
    """Aggregate: the most severe status of a group, ignoring SKIPPED."""
    return status_of(f"max({severity(status)})")


def worst_in(statuses: str) -> str:
    """The most severe status of an array, ignoring SKIPPED."""
    return status_of(f"array_max(transform({statuses}, s -> {severity('s')}))")


# Arithmetic -----------------------------------------------------------------


def ratio(numerator: str, denominator: str) -> str:
    """Division that is NULL on a zero denominator."""
    return f"try_divide(CAST({numerator} AS DOUBLE), CAST({denominator} AS DOUBLE))"


def percent(part: str, whole: str) -> str:
    """Share in percent, 0 of an empty whole."""
    return f"coalesce({ratio(part, whole)} * 100, 0D)"


def drop_percent(before: str, after: str, empty: str = "0D") -> str:
    """Share of rows lost between two layers, in percent; ``empty`` when there were none."""
    return f"coalesce((1D - {ratio(after, before)}) * 100, CAST({empty} AS DOUBLE))"


# Text -----------------------------------------------------------------------


def grouped(value: str, digits: int = 0) -> str:
    """Number with thousands separators."""
    return f"format_number(CAST({value} AS DOUBLE), {digits})"


def fixed(value: str, digits: int = 2) -> str:
    """Plain fixed-point text."""
    return f"format_string('%.{digits}f', CAST({value} AS DOUBLE))"


def json_object(**fields: str) -> str:
    """JSON object text; NULL fields are kept."""
    body = ", ".join(f"{text(name)}, {value}" for name, value in fields.items())
    return f"to_json(named_struct({body}), map('ignoreNullFields', 'false'))"


def json_number(value: str) -> str:
    return f"CAST({value} AS STRING)"


def json_string(value: str) -> str:
    """JSON string literal of a text expression, with every escape that JSON asks for."""
    # Spark writes an object; what stands between its key and its closing brace is the literal.
    written = f"to_json(named_struct('v', {value}))"
    return f"(CASE WHEN ({value}) IS NOT NULL THEN substring({written}, 6, length({written}) - 6) END)"


def json_list(names: list[str] | tuple[str, ...]) -> str:
    return json.dumps(list(names), ensure_ascii=False)
