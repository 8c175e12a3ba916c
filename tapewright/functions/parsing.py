"""Text to typed columns with explicit failure: null means absent or unreadable, never an exception."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewright.functions.fixed_values import DATE_FORMATS, NULL_WORDS

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def fold_header(text: str) -> str:
    return "".join(c for c in text.upper() if "A" <= c <= "Z" or "0" <= c <= "9")


def blank(col: Column) -> Column:
    return F.trim(F.coalesce(col, F.lit(""))).isin(*NULL_WORDS)


def multi_format_date(col: Column) -> Column:
    """First of the seven patterns that parses; the shape is tested first because parsers differ in leniency."""
    text = F.trim(col)
    tries = [F.when(text.rlike(shape), F.to_date(F.try_to_timestamp(text, F.lit(fmt)))) for fmt, shape in DATE_FORMATS]
    return F.coalesce(*tries)


def optional_date(col: Column) -> Column:
    return F.when(~blank(col), multi_format_date(col))


def bad_optional_date(col: Column) -> Column:
    return ~blank(col) & multi_format_date(col).isNull()


def _without_commas(col: Column) -> Column:
    return F.trim(F.replace(col, F.lit(","), F.lit("")))


def number(col: Column, kind: str = "decimal(38,10)") -> Column:
    text = _without_commas(col)
    return F.when(text.rlike(NUMBER), text.try_cast(kind))


def number_scale(col: Column) -> Column:
    """Digits after the point as written, trailing zeros included, less the exponent.

    Only a text with an `e` has its exponent cast: a failed cast is a thrown exception, far dearer than all the rest.
    """
    text = _without_commas(col)
    digits = F.length(F.regexp_extract(text, r"\.(\d*)", 1))
    written = F.regexp_extract(text, r"[eE]([+-]?\d+)$", 1).try_cast("int")
    exponent = F.coalesce(F.when(text.contains("e") | text.contains("E"), written), F.lit(0))
    return F.greatest(digits - exponent, F.lit(0))


def storage_problem(col: Column, whole_digits: int, scale: int) -> Column:
    """More whole digits or a finer scale than the stored decimal takes."""
    limit = F.lit("9" * whole_digits + "." + "9" * scale).cast(f"decimal({whole_digits + scale},{scale})")
    return (F.abs(number(col)) > limit) | (number_scale(col) > scale)


def zoned_timestamp(col: Column) -> Column:
    """ISO-8601 with an explicit offset, else null."""
    text = F.trim(col)
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text.try_cast("timestamp"))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])
