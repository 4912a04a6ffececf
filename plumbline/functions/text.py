"""Driver-side helper for reasons shown in SKIPPED results."""

from __future__ import annotations

import re

from plumbline.functions.values import SECRET_PATTERN, URI_PATTERN


def sanitize_reason(error: BaseException) -> str:
    """Type and message of an error on one line, credentials and URIs masked."""
    text = f"{type(error).__name__}: {error}"
    text = re.sub(SECRET_PATTERN, r"\1=***", text)
    text = re.sub(URI_PATTERN, "***", text)
    return " ".join(text.split())
