"""JSON held inside longer message texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystar.functions.text import strip_space

# --- fixed values: markers written into message texts ---

TRACE_MARKER = "EXECUTION_TRACE:"
CHART_MARKER = "CHART_SPEC:"

# --- end of fixed values ---


def json_after_marker(text: Column, marker: str) -> Column:
    """First JSON object or array right after the first ``marker``, as text; else null.

    ``get_json_object`` reads one value, respects braces inside strings and ignores what
    follows it. A scalar after the marker is not a result.
    """
    at = F.locate(marker, text)
    rest = strip_space(F.substr(text, at + F.lit(len(marker))))
    found = F.get_json_object(rest, "$")
    return F.when((at > 0) & rest.rlike(r"^[\[{]"), found)


def json_objects_after(text: Column, marker: str) -> Column:
    """Every object that follows a ``marker``, in order, null where it does not parse."""
    pieces = F.split(text, marker)
    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(rest, lambda p: first_object(p))


def first_object(text: Column) -> Column:
    at = F.locate("{", text)
    return F.when(at > 0, F.get_json_object(F.substr(text, at), "$"))
