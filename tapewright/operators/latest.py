"""The newest row of every series with its features, folded to one row a series: no window, no row per session.

A series' bars are gathered once, in order (at most one a session of the calendar), and each feature reads what it needs
of them: a few places from the end, sums of a slice, or, for the recursions, one fold over the closes or true ranges. The folds
take the bars in the order of the plain recursion, so the last row of `feature_frame` comes out the same to the last bit. They
run as higher-order functions inside the JVM, and only those that are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.fixed_values import FEATURE_CODES, SESSIONS_PER_YEAR
from tapewright.functions.numbers import as_double, change, ratio
from tapewright.operators.features import RETURN_LAGS

_BARS, _CLOSES = "_bars", "_closes"


def _back(k: int) -> Column:
    """The bar k places before the newest; null before the first."""
    return F.try_element_at(_BARS, F.lit(-1 - k))


def _newest(values: Column | str, n: int) -> Column:
    return F.slice(values, -n, n)


def _total(values: Column | str) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def _from(n: int, value: Column) -> Column:
    """Only for series of at least n bars."""
    return F.when(F.col("n_obs") >= n, value)


def _mean(values: Column | str, n: int) -> Column:
    return _from(n, as_double(_total(_newest(values, n))) / F.lit(float(n)))


def _seed(values: Column | str, n: int) -> Column:
    return as_double(_total(F.slice(values, 1, n))) / F.lit(float(n))


def _rest(values: Column | str, n: int) -> Column:
    """What follows the first n."""
    return F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))


def _ema(n: int) -> Column:
    alpha = 2.0 / (n + 1)
    fold = F.aggregate(_rest(_CLOSES, n), _seed(_CLOSES, n), lambda acc, x: F.lit(alpha) * x + F.lit(1.0 - alpha) * acc)
    return _from(n, fold)


def _wilder(values: Column) -> Column:
    return F.aggregate(_rest(values, 14), _seed(values, 14), lambda acc, x: (acc * F.lit(13.0) + x) / F.lit(14.0))


def _steps(made: Callable[[Column, Column], Column]) -> Column:
    """made(close, close before) for every bar but the first."""
    return F.zip_with(F.slice(_CLOSES, 2, F.greatest(F.col("n_obs") - 1, F.lit(0))), F.slice(_CLOSES, 1, F.greatest(F.col("n_obs") - 1, F.lit(0))), made)


def _rsi() -> tuple[dict[str, Column], Column]:
    """Mean gain and mean loss, and the strength made of them."""
    nought = F.lit(0).cast("long")
    gain = _wilder(_steps(lambda now, past: F.greatest(now - past, nought)))
    loss = _wilder(_steps(lambda now, past: F.greatest(past - now, nought)))
    level = F.when(F.col("_loss") == 0, F.when(F.col("_gain") == 0, 50.0).otherwise(100.0)).when(F.col("_gain") == 0, 0.0).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.col("_gain") / F.col("_loss")))
    return {"_gain": gain, "_loss": loss}, _from(15, level)


def _deviation(n: int) -> Column:
    """Sample deviation of the last n returns, over a year; null unless all of them exist."""
    past = F.slice(_CLOSES, -n - 1, n)
    returns = F.zip_with(_newest(_CLOSES, n), past, change)
    mean = F.aggregate(returns, F.lit(0.0), lambda acc, x: acc + x) / F.lit(float(n))
    spread = F.aggregate(
        returns, F.struct(mean.alias("m"), F.lit(0.0).alias("s")),
        lambda acc, x: F.struct(acc["m"].alias("m"), (acc["s"] + (x - acc["m"]) * (x - acc["m"])).alias("s")),
        lambda acc: acc["s"])
    return _from(n + 1, F.sqrt(spread / F.lit(n - 1.0)) * F.sqrt(F.lit(float(SESSIONS_PER_YEAR))))


def latest_frame(
    bars: DataFrame, codes: Sequence[str] = FEATURE_CODES, keys: Sequence[str] = ("series",), keep: Sequence[str] = (),
) -> DataFrame:
    """`keys`, session, number of bars, `keep` and the asked codes for the newest bar of each series."""
    unknown = set(codes) - set(FEATURE_CODES)
    if unknown:
        raise ValueError(f"unknown feature codes: {sorted(unknown)}")
    one = F.struct("session", "open", "high", "low", "close", "volume", "traded_value", *[F.col(c).alias(f"_k_{c}") for c in keep])
    frame = bars.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("_bars")).select(
        *keys, "_bars", F.size("_bars").alias("n_obs"), F.transform("_bars", lambda b: b["close"]).alias("_closes"))
    now, before = _back(0), _back(1)
    close, prior = now["close"], before["close"]
    volumes, highs = F.transform(_BARS, lambda b: b["volume"]), F.transform(_BARS, lambda b: b["high"])
    values = F.transform(_newest(_BARS, 20), lambda b: b["traded_value"])
    value_sum = F.aggregate(values, F.lit(0).cast("decimal(38,2)"), lambda acc, x: (acc + x).cast("decimal(38,2)"))

    def reach(bar: Column, last: Column) -> Column:
        return F.greatest(bar["high"] - bar["low"], F.abs(bar["high"] - last), F.abs(bar["low"] - last))

    ranges = F.transform(_BARS, lambda b, i: reach(b, F.get(_CLOSES, i - 1)))
    rsi_parts, rsi = _rsi()
    sma = {n: F.col(f"_sma{n}") for n in (20, 50, 100, 200)}
    #: Values that several codes read, made once: name, value, codes.
    shared = {
        **{f"_sma{n}": (_mean(_CLOSES, n), [c for c in FEATURE_CODES if "SMA" in c and str(n) in c.split("_")]) for n in sma},
        **{f"_vol{n}": (_mean(volumes, n), [f"AVG_VOLUME_{n}", f"VOLUME_RATIO_{n}"]) for n in (20, 50)},
        **{name: (value, ["RSI_14"]) for name, value in rsi_parts.items()},
        "_atr": (_from(14, _wilder(ranges)), ["ATR_14", "ATR_PCT_14"]),
        "_high": (_from(21, F.array_max(F.slice(highs, -21, 20))), ["PRIOR_HIGH_20", "BREAKOUT_PCT_20"]),
    }
    frame = frame.withColumns({name: value for name, (value, readers) in shared.items() if set(readers) & set(codes)})
    made = {
        **{code: change(close, _back(n)["close"]) for code, n in RETURN_LAGS.items()},
        **{f"SMA_{n}": sma[n] for n in sma},
        "EMA_20": _ema(20), "EMA_50": _ema(50), "RSI_14": rsi,
        **{f"DISTANCE_SMA_{n}": change(close, sma[n]) for n in (20, 50, 200)},
        "TRUE_RANGE": as_double(reach(now, prior)), "ATR_14": F.col("_atr"), "ATR_PCT_14": ratio(F.col("_atr"), close),
        "VOLATILITY_20": _deviation(20), "VOLATILITY_60": _deviation(60),
        **{f"AVG_VOLUME_{n}": F.col(f"_vol{n}") for n in (20, 50)},
        **{f"VOLUME_RATIO_{n}": ratio(now["volume"], F.col(f"_vol{n}")) for n in (20, 50)},
        "AVG_TRADED_VALUE_20": _from(20, as_double(value_sum) / F.lit(20.0)),
        "GAP_PCT_1D": change(now["open"], prior), "INTRADAY_RETURN": change(close, now["open"]),
        "RANGE_PCT": ratio(now["high"] - now["low"], close),
        "CLOSE_LOCATION": ratio(close - now["low"], now["high"] - now["low"]),
        **{f"ABOVE_SMA_{n}": as_double(close) > sma[n] for n in (20, 50, 200)},
        "SMA_20_ABOVE_50": sma[20] > sma[50], "SMA_50_ABOVE_200": sma[50] > sma[200],
        "PRIOR_HIGH_20": as_double(F.col("_high")), "BREAKOUT_PCT_20": change(close, F.col("_high")),
    }
    return frame.select(
        *keys, now["session"].alias("session"), "n_obs", *[now[f"_k_{c}"].alias(c) for c in keep], *[made[c].alias(c) for c in codes])
