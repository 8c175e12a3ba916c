"""Feature requests: a series over a range, the latest row, and history for back-testing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.fixed_values import FEATURE_CODES, MARKET_ZONE
from tapewright.operators.actions import actions_as_of, adjust_prices, pit_adjusted_frame
from tapewright.operators.features import feature_frame
from tapewright.operators.latest import latest_frame
from tapewright.operators.pit import prices_range, session_list, with_session_times


def _to_session(as_of: Column, end=None) -> Column:
    last = F.to_date(F.from_utc_timestamp(as_of, MARKET_ZONE))
    return last if end is None else F.least(last, F.lit(end).cast("date"))


def feature_series(
    bars: DataFrame, calendar: DataFrame, actions: DataFrame, *, as_of: Column, start=None, end=None,
    policy: str = "ADJUSTED", codes: Sequence[str] = FEATURE_CODES, exchange: str = "X",
) -> DataFrame:
    """Whole prefix in, rows of [start, end] that were available by `as_of` out."""
    timed = with_session_times(bars.where(F.col("session") <= _to_session(as_of, end)), calendar, exchange)
    if policy == "RAW":
        frame = feature_frame(timed, codes, keep=("available_at",))
    else:
        known = actions_as_of(actions, as_of).where(F.col("ex_date") <= _to_session(as_of, end))
        frame = pit_adjusted_frame(timed, known, codes, resolved=True)
    return prices_range(frame.where(F.col("available_at") <= as_of), start, end)


def latest_features(
    bars: DataFrame, calendar: DataFrame, actions: DataFrame, *, as_of: Column, observation_date=None,
    policy: str = "ADJUSTED", codes: Sequence[str] = FEATURE_CODES, exchange: str = "X",
) -> DataFrame:
    """One row per series: its last session whose close came by `as_of`."""
    upto = bars.where(F.col("session") <= _to_session(as_of, observation_date))
    usable = with_session_times(upto, calendar, exchange).where(F.col("available_at") <= as_of)
    if policy == "ADJUSTED":
        # ex dates after a series' last bar are harmless to its latest row only if left out
        last = usable.groupBy("series").agg(F.max("session").alias("_last"))
        known = actions_as_of(actions, as_of).join(last, "series").where(F.col("ex_date") <= F.col("_last"))
        usable = adjust_prices(usable, known.drop("_last"))
    return latest_frame(usable, codes, keep=("available_at",))


def historical_features(
    bars: DataFrame, calendar: DataFrame, actions: DataFrame, *, start, end, policy: str = "ADJUSTED",
    codes: Sequence[str] = FEATURE_CODES, exchange: str = "X",
) -> DataFrame:
    """Per series and session of the range, each day as known at its own close."""
    timed = with_session_times(prices_range(bars, None, end), calendar, exchange)
    if policy == "RAW":
        frame = feature_frame(timed, codes, keep=("available_at",))
    else:
        frame = pit_adjusted_frame(timed, actions, codes)
    return prices_range(frame, start, end)


def missing_session_warning(bars: DataFrame, calendar: DataFrame, exchange: str = "X") -> DataFrame:
    """Sessions of the calendar that a series lacks after its first bar: the first eight and how many more.

    The days of a series are compared as sorted arrays bounded by the calendar; no series x session product is
    shuffled.
    """
    own = bars.groupBy("series").agg(F.collect_set("session").alias("_own"), F.min("session").alias("_from"))
    days = session_list(calendar.where(F.col("exchange") == exchange))
    expected = F.filter(F.col("_days"), lambda d: d >= F.col("_from"))
    missing = F.array_except(expected, F.col("_own"))
    return own.withColumn("_days", days).select("series", F.array_sort(missing).alias("m")).where(
        F.size("m") > 0
    ).select("series", F.size("m").alias("missing"), F.concat(
        F.lit("Missing expected trading sessions: "),
        F.array_join(F.transform(F.slice("m", 1, 8), lambda d: d.cast("string")), ", "),
        F.when(F.size("m") > 8, F.format_string(" (+%d more)", F.size("m") - 8)).otherwise(""),
    ).alias("warning"))
