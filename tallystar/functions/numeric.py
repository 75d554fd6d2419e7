"""Text-to-number conversion with the suppression rules of the survey files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystar.functions.text import strip_space
from tallystar.schema import SUPPRESSION_TOKENS

_INTEGER = r"^[+-]?\d+$"
_DECIMAL = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
# What a tolerant reader takes as a number: digit groups joined by "_" are allowed.
_LOOSE = (
    r"^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
    r"|^[+-]?(?i:inf|infinity)$"
)


def _plain(value: Column) -> Column:
    text = strip_space(value)
    return F.when(~text.isin(*SUPPRESSION_TOKENS), text)


def _pattern(dtype: T.DataType) -> str:
    return _INTEGER if isinstance(dtype, T.IntegralType) else _DECIMAL


def _direct(value: Column, dtype: T.DataType) -> Column:
    """The number of a value that needs no trimming, which is nearly all of them."""
    return F.when(value.rlike(_pattern(dtype)), value.try_cast(dtype))


def _number(value: Column, dtype: T.DataType, otherwise=None) -> Column:
    text = _plain(value)
    trimmed = F.when(text.rlike(_pattern(dtype)), text.try_cast(dtype))
    if otherwise is not None:
        trimmed = F.when(text.isNotNull(), F.coalesce(trimmed, otherwise(text)))
    return F.when(value.isNotNull(), F.coalesce(_direct(value, dtype), trimmed))


def is_bad_number(value: Column, dtype: T.DataType) -> Column:
    """True where a value is neither suppressed nor a number of the wanted type."""
    return value.isNotNull() & _number(value, dtype).isNull() & _plain(value).isNotNull()


def sanitize_numeric(value: Column, dtype: T.DataType, mode: str = "strict") -> Column:
    """Trim, null the suppression tokens, then convert.

    ``strict`` raises on a value that is not a number; ``quarantine`` gives null, to be
    used together with :func:`is_bad_number`. The pattern keeps out spellings such as
    ``1d`` that only the cast accepts.
    """
    if mode == "quarantine":
        return _number(value, dtype)
    if mode != "strict":
        raise ValueError(f"unknown mode: {mode}")
    return _number(
        value, dtype, lambda text: F.raise_error(F.concat(F.lit("not a number: "), text)).cast(dtype)
    )


def tolerant_number(value: Column) -> Column:
    """Double for anything that reads as a number, else null; never raises."""
    text = strip_space(value.cast("string"))
    return F.when(text.rlike(_LOOSE), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def nudged_round(value: Column, digits: int = 2) -> Column:
    """Round after a tiny upward nudge, so that decimal ties do not depend on the engine."""
    return F.round(value + F.lit(1e-7), digits)
