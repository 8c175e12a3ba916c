"""Numeric helpers shared by every operator.

Prices are bigint *ticks* (1/10 000 of the currency unit): sums stay exact and hash aggregation stays in
codegen. Money is decimal. Ratios are double and are cut to eight digits once, at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS_PER_UNIT = 10_000


def num(value) -> Column:
    """Decimal literal with its own precision and scale."""
    return F.lit(Decimal(str(value)))


def r8(col: Column) -> Column:
    """Double cut to eight digits, halves upwards."""
    return F.floor(col * F.lit(1e8) + F.lit(0.5)) / F.lit(1e8)


def dec8(col: Column) -> Column:
    """Double to decimal(18,8), halves upwards; sums of the result are exact."""
    return (F.floor(col * F.lit(1e8) + F.lit(0.5)).cast("decimal(18,0)") * num("0.00000001")).cast("decimal(18,8)")


def as_double(col: Column) -> Column:
    return col.cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient, null for a zero denominator."""
    return F.try_divide(as_double(numerator), as_double(denominator))


def change(now: Column, before: Column) -> Column:
    return ratio(now, before) - F.lit(1.0)


def ticks_to_price(col: Column) -> Column:
    return (col.cast("decimal(14,0)") * num("0.0001")).cast("decimal(18,4)")


def price_to_ticks(col: Column) -> Column:
    return F.round(col.cast("decimal(18,4)") * F.lit(TICKS_PER_UNIT), 0).cast("bigint")


def money(col: Column) -> Column:
    """Half-up to the hundredth."""
    return F.round(col, 2).cast("decimal(24,2)")


def whole_div(numerator: Column, denominator: Column) -> Column:
    """Integer quotient towards zero, null for a zero denominator."""
    return F.call_function("div", numerator, F.nullif(denominator, F.lit(0)))


def half_up_div(numerator: Column, denominator: Column) -> Column:
    """Integer quotient of a by b > 0, halves away from zero; exact, so every engine agrees on ties."""
    return F.signum(numerator).cast("bigint") * whole_div(
        F.abs(numerator) * 2 + denominator, denominator * 2)


def units8(col: Column) -> Column:
    """decimal(18,8) as a bigint count of 1e-8."""
    return (col * F.lit(10**8)).cast("bigint")


def cents(col: Column) -> Column:
    return (col * F.lit(100)).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
