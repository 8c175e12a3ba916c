"""Delivery cost rules per order leg, as decimal columns rounded component by component."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewright.functions.fixed_values import COST_RATES
from tapewright.functions.numbers import let, money

COMPONENTS = ("brokerage", "stt", "exchange_charge", "sebi_charge", "gst", "stamp_duty", "dp_charge")


def _rate(rates: Mapping[str, object], name: str) -> Column:
    return F.lit(str(rates[name])).cast("decimal(9,8)")


def leg_costs(turnover: Column, side: str, overrides: Mapping[str, object] | None = None) -> Column:
    """struct of turnover, the seven components and total_charges; side is BUY or SELL.

    The turnover and each component are worked out once; written out in one another they would be twenty times as many.
    """
    if side not in ("BUY", "SELL"):
        raise ValueError("side must be BUY or SELL")
    rates = {**COST_RATES, **(overrides or {})}
    flat = F.lit(str(rates["brokerage_flat"])).cast("decimal(12,2)")

    def parts(t: Column) -> Column:
        stamp = money(t * _rate(rates, "stamp_buy")) if side == "BUY" else F.lit("0").cast("decimal(24,2)")
        return F.struct(
            t.alias("t"), money(flat + t * _rate(rates, "brokerage_rate")).alias("brokerage"),
            F.round(t * _rate(rates, "stt"), 0).cast("decimal(24,2)").alias("stt"),
            money(t * _rate(rates, "exchange")).alias("exchange"), money(t * _rate(rates, "sebi")).alias("sebi"),
            stamp.alias("stamp"), F.lit(str(rates["dp_sell"]) if side == "SELL" else "0").cast("decimal(24,2)").alias("dp"))

    def taxed(c: Column) -> Column:
        gst = money((c["brokerage"] + c["exchange"] + c["sebi"]) * _rate(rates, "gst"))
        return F.struct(c.alias("c"), gst.alias("gst"))

    def made(x: Column) -> Column:
        c, gst = x["c"], x["gst"]
        total = money(c["brokerage"] + c["stt"] + c["exchange"] + c["sebi"] + gst + c["stamp"] + c["dp"])
        out = F.struct(
            money(c["t"]).alias("turnover"), c["brokerage"].alias("brokerage"), c["stt"].alias("stt"),
            c["exchange"].alias("exchange_charge"), c["sebi"].alias("sebi_charge"), gst.alias("gst"), c["stamp"].alias("stamp_duty"),
            c["dp"].alias("dp_charge"), total.alias("total_charges"),
        )
        return F.when(c["t"] < 0, F.raise_error(F.lit("turnover cannot be negative"))).otherwise(out)

    return let(turnover.cast("decimal(28,6)"), lambda t: let(parts(t), lambda c: let(taxed(c), made)))
