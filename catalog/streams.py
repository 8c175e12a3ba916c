"""Event-time bars of `events` (the batch form of the streaming operator; the stream itself is tested)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions.numbers import r8
from tapewright.sources import adapters as src
from tapewright.streaming.bars import windowed_bars


def ticks(s, p):
    return src.table(s, p, "events").select(
        F.col("user_id").alias("series"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tick_id"), F.col("value").alias("price"),
        F.lit(1).cast("bigint").alias("quantity"))


def _daily(s, p):
    return windowed_bars(ticks(s, p)).withColumns({
        "start": F.date_format("start", "yyyy-MM-dd"), **{c: r8(F.col(c)) for c in ("open", "high", "low", "close")}})


QUERIES = {"stream_event_time_bars": _daily}
ORACLES = {"stream_event_time_bars": """
  SELECT user_id AS series, strftime(date_trunc('day', ts), '%Y-%m-%d') AS "start", floor(arg_min(value, (ts, event_id)) * 1e8 + 0.5e0) / 1e8 AS open,
    floor(max(value) * 1e8 + 0.5e0) / 1e8 AS high, floor(min(value) * 1e8 + 0.5e0) / 1e8 AS low, floor(arg_max(value, (ts, event_id)) * 1e8 + 0.5e0) / 1e8 AS close,
    count(*) AS volume, count(*) AS n FROM events GROUP BY 1, 2"""}
