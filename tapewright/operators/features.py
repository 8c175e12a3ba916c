"""The 38 technical features, one row per series and session.

All window expressions share one key and order, so a frame costs one shuffle and one sort. Moving sums are
differences of a running sum (constant work per row whatever the window length); only the two deviations and the
prior high slide a frame. EMA, RSI and ATR depend on the whole prefix and run in one `lockstep_scan` on top of the
same partitioning, each only when asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.fixed_values import (
    FEATURE_CODES, MIN_OBSERVATIONS, RECURSIVE_CODES, SESSIONS_PER_YEAR,
)
from tapewright.functions.numbers import as_double, change, ratio
from tapewright.operators.lockstep import Step, lockstep_scan

RETURN_LAGS = {
    "RET_1D": 1, "RET_5D": 5, "RET_10D": 10, "RET_20D": 20, "MOM_1M_21D": 21, "MOM_3M_63D": 63, "MOM_6M_126D": 126,
}


# --- recursions in lockstep: state and inputs hold one entry for each series that has an n-th row -----------------------
def _ema(span: int) -> Step:
    """Seeded with the mean of the first `span` closes."""
    alpha = 2.0 / (span + 1)

    def step(n, state, inputs):
        value, close = state[0], inputs[0]
        if n < span:
            return [value + close], None
        value = (value + close) / span if n == span else alpha * close + (1.0 - alpha) * value
        return [value], value

    return step


def _atr(n, state, inputs):
    """Wilder's mean of 14 true ranges."""
    value, true_range = state[0], inputs[1]
    if n < 14:
        return [value + true_range], None
    value = (value + true_range) / 14 if n == 14 else (value * 13.0 + true_range) / 14.0
    return [value], value


def _rsi(n, state, inputs):
    """Wilder's means of 14 gains and losses, and their relative strength."""
    (previous, gain, loss), close = state, inputs[0]
    if n == 1:
        return [close, gain, loss], None
    up, down = np.maximum(close - previous, 0), np.maximum(previous - close, 0)
    if n <= 15:
        gain, loss = gain + up, loss + down
        if n < 15:
            return [close, gain, loss], None
        gain, loss = gain / 14, loss / 14
    else:
        gain, loss = (gain * 13.0 + up) / 14.0, (loss * 13.0 + down) / 14.0
    strength = 100.0 - 100.0 / (1.0 + gain / np.where(loss == 0, 1.0, loss))
    flat = np.where(gain == 0, 50.0, 100.0)
    return [close, gain, loss], np.where(loss == 0, flat, np.where(gain == 0, 0.0, strength))


#: Recursion that a code rests on: name, entries of state, step.
RECURSIONS = {"EMA_20": (1, _ema(20)), "EMA_50": (1, _ema(50)), "RSI_14": (3, _rsi), "ATR_14": (1, _atr)}


def recursions_of(codes: Sequence[str]) -> list[str]:
    return [name for name in RECURSIONS if name in codes or (name == "ATR_14" and "ATR_PCT_14" in codes)]


def feature_frame(
    bars: DataFrame, codes: Sequence[str] = FEATURE_CODES, keys: Sequence[str] = ("series",),
    keep: Sequence[str] = (),
) -> DataFrame:
    """`keys`, session, row number in the series, `keep` and the asked feature codes.

    Keys must be unique with session: a series then holds at most one row per session of the calendar.
    """
    unknown = set(codes) - set(FEATURE_CODES)
    if unknown:
        raise ValueError(f"unknown feature codes: {sorted(unknown)}")
    w = Window.partitionBy(*keys).orderBy("session")
    total = w.rowsBetween(Window.unboundedPreceding, 0)
    past = w.rowsBetween(-20, -1)
    close, high, low, volume, value = (F.col(c) for c in ("close", "high", "low", "volume", "traded_value"))
    prior_close = F.lag("close", 1).over(w)

    base = {
        "n_obs": F.row_number().over(w),
        "_pc": prior_close,
        "_sum_close": F.sum("close").over(total),
        "_sum_volume": F.sum("volume").over(total),
        "_sum_value": F.sum(F.coalesce(value, F.lit(0).cast("decimal(24,2)"))).over(total),
        "_cnt_value": F.count(value).over(total),
        "_high20": F.max("high").over(past),
        "_ret": change(close, prior_close),
        **{f"_lag{n}": F.lag("close", n).over(w) for n in sorted(set(RETURN_LAGS.values()) - {1})},
    }
    frame = bars.select(
        *keys, "session", "open", "high", "low", "close", "volume", "traded_value",
        *[F.col(c).alias(f"_k_{c}") for c in keep],
    ).withColumns(base)

    def mean(total_col: str, n: int) -> Column:
        gone = F.coalesce(F.lag(total_col, n).over(w), F.lit(0))
        return F.when(F.col("n_obs") >= n, as_double(F.col(total_col) - gone) / F.lit(float(n)))

    def deviation(n: int) -> Column:
        seen = F.col("_cnt_ret") - F.coalesce(F.lag("_cnt_ret", n).over(w), F.lit(0))
        spread = F.stddev_samp("_ret").over(w.rowsBetween(-n + 1, 0))
        return F.when(seen == n, spread * F.sqrt(F.lit(float(SESSIONS_PER_YEAR))))

    values_seen = F.col("_cnt_value") - F.coalesce(F.lag("_cnt_value", 20).over(w), F.lit(0))
    true_range = F.greatest(high - low, F.abs(high - F.col("_pc")), F.abs(low - F.col("_pc")))
    frame = frame.withColumn("_cnt_ret", F.count("_ret").over(total)).withColumns({
        **{f"SMA_{n}": mean("_sum_close", n) for n in (20, 50, 100, 200)},
        **{f"AVG_VOLUME_{n}": mean("_sum_volume", n) for n in (20, 50)},
        "AVG_TRADED_VALUE_20": F.when(values_seen == 20, mean("_sum_value", 20)),
        **{f"VOLATILITY_{n}": deviation(n) for n in (20, 60)},
        "TRUE_RANGE": true_range,
        "PRIOR_HIGH_20": F.when(F.col("n_obs") > 20, F.col("_high20")),
    })
    sma = {n: F.col(f"SMA_{n}") for n in (20, 50, 100, 200)}
    exprs = {
        **{code: change(close, F.col("_pc") if n == 1 else F.col(f"_lag{n}")) for code, n in RETURN_LAGS.items()},
        **{f"DISTANCE_SMA_{n}": change(close, sma[n]) for n in (20, 50, 200)},
        **{f"VOLUME_RATIO_{n}": ratio(volume, F.col(f"AVG_VOLUME_{n}")) for n in (20, 50)},
        "TRUE_RANGE": as_double(F.col("TRUE_RANGE")),
        "GAP_PCT_1D": change(F.col("open"), F.col("_pc")),
        "INTRADAY_RETURN": change(close, F.col("open")),
        "RANGE_PCT": ratio(high - low, close),
        "CLOSE_LOCATION": ratio(close - low, high - low),
        **{f"ABOVE_SMA_{n}": as_double(close) > sma[n] for n in (20, 50, 200)},
        "SMA_20_ABOVE_50": sma[20] > sma[50],
        "SMA_50_ABOVE_200": sma[50] > sma[200],
        "PRIOR_HIGH_20": as_double(F.col("PRIOR_HIGH_20")),
        "BREAKOUT_PCT_20": change(close, F.col("PRIOR_HIGH_20")),
    }
    recursive = [c for c in codes if c in RECURSIVE_CODES]
    place = [*keys, "session", "n_obs", *[f"_k_{c}" for c in keep]]
    plain = [exprs.get(c, F.col(c)).alias(c) for c in codes if c not in recursive]
    if recursive:
        # Only what is asked for, the close and the true range leave the JVM; windows that nothing reads are pruned.
        asked = recursions_of(codes)
        frame = lockstep_scan(
            frame.select(*place, "close", F.col("TRUE_RANGE").alias("_true_range"), *plain), keys, ["session"], ["close", "_true_range"],
            {f"_{name}": RECURSIONS[name] for name in asked})
        late = {**{c: F.col(f"_{c}") for c in asked}, "ATR_PCT_14": ratio(F.col("_ATR_14"), close) if "ATR_14" in asked else None}
        plain = [F.col(c) if c not in recursive else late[c].alias(c) for c in codes]
    return frame.select(*[F.col(c).alias(c.removeprefix("_k_")) if c.startswith("_k_") else F.col(c) for c in place], *plain)


def unavailable_reasons(features: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Map of reason per null feature: too short a history, or undefined for the inputs."""
    reasons = [
        F.when(
            F.col(c).isNull(),
            F.when(F.col("n_obs") < MIN_OBSERVATIONS[c], f"Requires {MIN_OBSERVATIONS[c]} observations")
            .otherwise("Undefined for available inputs"),
        )
        for c in codes
    ]
    entries = F.filter(
        F.array(*[F.struct(F.lit(c).alias("k"), r.alias("v")) for c, r in zip(codes, reasons)]),
        lambda e: e["v"].isNotNull(),
    )
    return features.withColumn("unavailable", F.map_from_entries(entries))
