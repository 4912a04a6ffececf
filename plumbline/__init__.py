"""Cross-layer data-quality checks for medallion pipelines, as Spark jobs."""

from plumbline.model import (
    FAIL,
    IMPACTED,
    NOT_TRUSTED,
    PASS,
    SKIPPED,
    TRUSTED,
    WARN,
    WARNING,
)
from plumbline.operators.check import Check, Rule
from plumbline.plans.run import ValidationRun, business_impact, check_results, detect, validate
from plumbline.specs import ForeignKey, PipelineSpec, RangeRule, TableSpec, Thresholds

__all__ = [
    "FAIL",
    "IMPACTED",
    "NOT_TRUSTED",
    "PASS",
    "SKIPPED",
    "TRUSTED",
    "WARN",
    "WARNING",
    "Check",
    "ForeignKey",
    "PipelineSpec",
    "RangeRule",
    "Rule",
    "TableSpec",
    "Thresholds",
    "ValidationRun",
    "business_impact",
    "check_results",
    "detect",
    "validate",
]
