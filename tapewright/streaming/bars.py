"""Event-time bars: OHLC of ticks per series and window, finalised by a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_bars(ticks: DataFrame, window: str = "1 day", late: str | None = None) -> DataFrame:
    """`ticks` has series, ts, tick_id, price, quantity. Open and close follow (ts, tick_id), so late but accepted
    ticks land in order. Works on a stream (append after the watermark) and on a batch alike.

    A stream has to say how late a tick may be; what comes later is counted by the query itself, in `lastProgress`
    under `stateOperators[].numRowsDroppedByWatermark`. A batch drops nothing.
    """
    if ticks.isStreaming and not late:
        raise ValueError("a stream needs a bound for late ticks")
    rows = ticks.withWatermark("ts", late) if late and ticks.isStreaming else ticks
    place: Column = F.struct("ts", "tick_id")
    return rows.groupBy("series", F.window("ts", window).alias("w")).agg(
        F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", place).alias("close"), F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("n"),
    ).select("series", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "n")
