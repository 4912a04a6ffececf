"""Tolerant dates and text redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.specs import ticked

# The accepted date spelling and the redaction patterns.
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}([.]\d{1,9})?)?( ?(Z|[+-]\d{2}(:?\d{2})?))?)?$"
SECRET_PATTERN = r"(?i)(password|pwd|secret|token|key)\s*=\s*[^\s]+"
URI_PATTERN = r"(?i)\b[a-z]+://[^\s]+"


def as_date(column: str, dtype: T.DataType) -> str:
    """SQL text: the column as DATE, NULL when it does not parse.

    Text must be ISO year-month-day, alone or with a time of day and zone, whose written day
    counts: a bare cast also takes '2026' and strings with a trailing remainder, so the
    pattern guards it.
    """
    if not isinstance(dtype, T.StringType):
        return f"try_cast({ticked(column)} AS DATE)"
    trimmed = f"trim({ticked(column)})"
    return f"(CASE WHEN {trimmed} RLIKE r'{ISO_DATE}' THEN try_cast(substring_index(substring_index({trimmed}, 'T', 1), ' ', 1) AS DATE) END)"


def redact(text: Column) -> Column:
    """Mask credentials and URIs, squeeze white space."""
    masked = F.regexp_replace(text, SECRET_PATTERN, "$1=***")
    masked = F.regexp_replace(masked, URI_PATTERN, "***")
    return F.trim(F.regexp_replace(masked, r"\s+", " "))
