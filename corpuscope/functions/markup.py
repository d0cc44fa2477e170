"""Version notes and markup in API docstrings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions.text import as_col, strip

# Docstring markers. (?d) keeps "." from stopping at anything but a line feed.
ADDED = r"(?dU)versionadded::\s*([0-9.]+)"
CHANGED = r"(?dU)versionchanged::\s*([0-9.]+)\s*(.*)"
DEPRECATED = r"(?idU)deprecated::\s*([0-9.]+)\s*(.*)"
REPLACEMENT = r"(?idU)(?:use|replace with)\s+(.+?)(?:\.|$)"
ROLE = r"(?U):\w+:`([^`]+)`"
DEPRECATED_PREFIX = "_deprecated"


def version_info(doc) -> dict[str, Column]:
    """Columns mined from a docstring, '' where a marker is missing."""
    text = F.coalesce(as_col(doc), F.lit(""))
    note = F.regexp_extract(text, DEPRECATED, 2)
    return {
        "versionadded": F.regexp_extract(text, ADDED, 1),
        "versionchanged": F.regexp_extract(text, CHANGED, 1),
        "versionchanged_note": strip(F.regexp_extract(text, CHANGED, 2)),
        "deprecated_in": F.regexp_extract(text, DEPRECATED, 1),
        "deprecated_note": strip(note),
        "replacement": strip(F.regexp_extract(note, REPLACEMENT, 1)),
    }


def is_deprecated(short_name, doc) -> Column:
    marked = F.coalesce(as_col(doc), F.lit("")).rlike(DEPRECATED)
    return marked | F.coalesce(F.startswith(as_col(short_name), F.lit(DEPRECATED_PREFIX)), F.lit(False))


def clean_markup(c) -> Column:
    """``:role:`x``` becomes x, double backticks go, NULL becomes ''."""
    text = F.regexp_replace(as_col(c), ROLE, "$1")
    return F.coalesce(strip(F.replace(text, F.lit("``"), F.lit(""))), F.lit(""))
