"""Checks as Columns over the metric sheet, and their isolation from each other."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from plumbline.functions.sql import case, json_string, text
from plumbline.functions.text import sanitize_reason
from plumbline.model import CHECK_TYPE, SKIPPED
from plumbline.plans.metrics import MetricSheet, MissingInput

log = logging.getLogger("plumbline.checks")

# Fixed value: what a check that could not run reports as expected.
NOT_EVALUATED = "check could not be evaluated"


@dataclass(frozen=True)
class Check:
    """One result row; ``status`` to ``value`` and ``extra`` are SQL expression text.

    ``observed`` and ``expected`` evaluate to JSON text.
    """

    check_id: str
    check_name: str
    layer: str
    status: str
    detail: str
    observed: str | None = None
    expected: str | None = None
    value: str | None = None
    evidence: str = ""
    dimension: str | None = None
    detection_layer: str | None = None
    table: str | None = None
    extra: Mapping[str, str] = field(default_factory=dict)
    detected_status: str | None = None
    detected_detail: str | None = None

    def row(self, seq: int) -> str:
        """SQL text of the result row."""
        extra = "NULL"
        if self.extra:
            pairs = (f"{text(k)}, CAST({v} AS STRING)" for k, v in self.extra.items())
            extra = f"map({', '.join(pairs)})"
        values = (
            text(self.check_id),
            text(self.check_name),
            text(self.layer),
            self.status,
            f"CAST({self.value or 'NULL'} AS DOUBLE)",
            self.observed or text(None),
            self.expected or text(None),
            self.detail,
            text(self.evidence),
            text(self.dimension),
            text(self.detection_layer),
            text(self.table),
            f"CAST({extra} AS MAP<STRING, STRING>)",
            self.detected_status or self.status,
            self.detected_detail or self.detail,
            str(seq),
        )
        named = (
            f"'{f.name}', {value}" for f, value in zip(CHECK_TYPE.fields, values, strict=True)
        )
        return f"named_struct({', '.join(named)})"


def skipped(
    check_id: str, check_name: str, layer: str, reason: str, detection_layer: str | None = None
) -> Check:
    """A check that could not be evaluated: never a silent pass, never a failure."""
    return Check(
        check_id,
        check_name,
        layer,
        status=text(SKIPPED),
        expected=json_string(text(NOT_EVALUATED)),
        detail=text(reason),
        detection_layer=detection_layer,
    )


def guarded(check: Check, unusable: str, reason: str) -> Check:
    """SKIPPED with ``reason`` for the pipelines where ``unusable`` holds."""
    return replace(
        check,
        status=case((unusable, text(SKIPPED)), otherwise=check.status),
        detail=case((unusable, text(reason)), otherwise=check.detail),
    )


@dataclass(frozen=True)
class Rule:
    """How to build one check (or several) from a sheet.

    Id, name and layer are those of the SKIPPED row shown when ``build`` raises. This
    is also the extension point: pass own rules to ``validate(extra_rules=...)``.
    """

    check_id: str
    check_name: str
    layer: str
    build: Callable[[MetricSheet], Check | list[Check] | None]
    detection_layer: str | None = None


def run_checks(sheet: MetricSheet, rules: Iterable[Rule]) -> list[Check]:
    """Build every rule in isolation; one that raises becomes a SKIPPED check."""
    out: list[Check] = []
    for rule in rules:
        try:
            built = rule.build(sheet)
        except Exception as error:  # isolation boundary of one check
            plain = isinstance(error, MissingInput)
            reason = str(error.args[0]) if plain else sanitize_reason(error)
            log.warning("check %s skipped: %s", rule.check_id, reason)
            built = skipped(
                rule.check_id, rule.check_name, rule.layer, reason, rule.detection_layer
            )
        if built is None:
            continue
        out.extend(built if isinstance(built, list) else [built])
    return out
