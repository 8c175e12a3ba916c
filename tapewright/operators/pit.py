"""Look-ups as known at a given time: memberships, calendars, newest rows, as-of joins.

Newest-row look-ups are `max_by` aggregates, which combine before the shuffle, so one entity holding most of the
rows stays cheap. Calendars hold one row per exchange and date and are the only thing windowed by exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.fixed_values import CLOSE_FALLBACK_SECONDS, MARKET_ZONE, OPEN_FALLBACK_SECONDS


# --- prices and newest rows -------------------------------------------------------------------------------
def prices_range(bars: DataFrame, start=None, end=None) -> DataFrame:
    if start is not None:
        bars = bars.where(F.col("session") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.where(F.col("session") <= F.lit(end).cast("date"))
    return bars


def latest_price_date(bars: DataFrame) -> DataFrame:
    return bars.agg(F.max("session").alias("latest_session"))


def latest_per_group(df: DataFrame, keys: Sequence[str], *newest: Column) -> DataFrame:
    """The row with the largest `newest` tuple in every group, without sorting the group."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*newest)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def latest_run(runs: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Newest finished run; the preferred dataset codes come first."""
    done = runs.where(F.col("status").isin("SUCCEEDED", "SUCCESS", "PARTIAL"))
    return done.orderBy(
        F.when(F.col("dataset_code").isin(*preferred), 0).otherwise(1), F.col("completed_at").desc(),
        F.col("started_at").desc(),
    ).limit(1)


def security_search(securities: DataFrame, text: str | None, page: int, page_size: int) -> DataFrame:
    """One page by symbol, with the number of hits beside every row."""
    hits = securities
    if text:
        like = f"%{text}%"
        hits = hits.where(F.col("symbol").ilike(like) | F.col("company_name").ilike(like))
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    rows = hits.orderBy("symbol").offset((page - 1) * page_size).limit(page_size)
    return rows.crossJoin(total)  # one row on the right


def lookup_by_name(df: DataFrame, value: str, *columns: str) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | (F.lower(c) == F.lower(F.lit(value)))
    return df.where(hit)


# --- memberships --------------------------------------------------------------------------------------------
def members_as_of(memberships: DataFrame, on) -> DataFrame:
    on = F.lit(on).cast("date")
    return memberships.where((F.col("valid_from") <= on) & (F.col("valid_to").isNull() | (F.col("valid_to") >= on)))


def memberships_between(memberships: DataFrame, start, end) -> DataFrame:
    start, end = F.lit(start).cast("date"), F.lit(end).cast("date")
    return memberships.where(
        (F.col("valid_from") <= end) & (F.col("valid_to").isNull() | (F.col("valid_to") >= start))
    )


def _session_row(calendar: DataFrame, start=None, end=None, exchange: str | None = None) -> DataFrame:
    days = prices_range(calendar.where("is_trading_day"), start, end)
    days = days if exchange is None else days.where(F.col("exchange") == exchange)
    return days.agg(F.sort_array(F.collect_set("session")).alias("days"))


def session_list(calendar: DataFrame, start=None, end=None, exchange: str | None = None) -> Column:
    """Sorted sessions of an exchange as one array value, read by a scalar subquery.

    One entry a day: a thousand years are under a megabyte. Without `exchange` the calendar has to hold just one.
    """
    return _session_row(calendar, start, end, exchange).scalar()


def members_by_session(memberships: DataFrame, calendar: DataFrame, start=None, end=None, exchange: str | None = None) -> DataFrame:
    """(index_id, series, session) for every session a membership covers; overlapping intervals count once.

    The intervals of a member, at most one per day of its start, are gathered before the days are laid out, so no set of days
    is held or shuffled. Members are dealt into a stated number of partitions: by their bytes, all of them would share a task.
    The sessions come by a join with one row: Spark takes its size as a product, so the grid is never mistaken for a small table.
    """
    member = ["index_id", "series"]
    spans = memberships.where(F.col("valid_from").isNotNull()).groupBy(*member, "valid_from").agg(
        F.bool_or(F.col("valid_to").isNull()).alias("open"), F.max("valid_to").alias("valid_to"))
    parts = int(memberships.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = spans.repartition(parts, *member).groupBy(*member).agg(
        F.collect_list(F.struct("valid_from", "open", "valid_to")).alias("_spans"))
    active = F.filter(
        F.col("days"),
        lambda d: F.exists("_spans", lambda x: (d >= x["valid_from"]) & (x["open"] | (d <= x["valid_to"]))),
    )
    sessions = _session_row(calendar, start, end, exchange)  # one row on the right
    return held.crossJoin(sessions).select(*member, F.explode(active).alias("session"))


def coverage_guard(memberships: DataFrame, start) -> DataFrame:
    """Per index: may history from `start` be asked for, or does the first snapshot come later?"""
    first = F.min("valid_from")
    return memberships.groupBy("index_id").agg(
        first.alias("first_snapshot"),
        F.when(first > F.lit(start).cast("date"), "HISTORICAL_MEMBERSHIP_NOT_COVERED").otherwise("COVERED")
        .alias("status"),
    )


# --- index history ------------------------------------------------------------------------------------------
def index_history_as_of(index_prices: DataFrame, source_mode: str, as_of: Column) -> DataFrame:
    return index_prices.where((F.col("source_mode") == source_mode) & (F.col("available_at") <= as_of))


def index_coverage(index_prices: DataFrame, nth: int = 200) -> DataFrame:
    w = Window.partitionBy("index_id", "source_mode").orderBy("session")  # at most one row per session
    numbered = index_prices.select("index_id", "source_mode", "session").withColumn("k", F.row_number().over(w))
    return numbered.groupBy("index_id", "source_mode").agg(
        F.min("session").alias("first_session"), F.max("session").alias("last_session"),
        F.count(F.lit(1)).alias("sessions"), F.min(F.when(F.col("k") == nth, F.col("session"))).alias("nth_session"),
    )


# --- calendars ----------------------------------------------------------------------------------------------
def trading_days(calendar: DataFrame, start=None, end=None) -> DataFrame:
    return prices_range(calendar.where("is_trading_day"), start, end)


def session_index(calendar: DataFrame, start=None, end=None) -> DataFrame:
    """Zero-based ordinal of each session of the range, per exchange."""
    w = Window.partitionBy("exchange").orderBy("session")
    return trading_days(calendar, start, end).withColumn("idx", F.row_number().over(w) - 1)


def session_neighbours(dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """For (exchange, day): is it a session (null when unknown), and the sessions strictly before and after."""
    known = calendar.select("exchange", F.col("session").alias("day"), "is_trading_day", F.lit(False).alias("asked"))
    asked = dates.select("exchange", "day").distinct().select(
        "exchange", "day", F.lit(None).cast("boolean").alias("is_trading_day"), F.lit(True).alias("asked")
    )
    merged = known.unionByName(asked).groupBy("exchange", "day").agg(
        F.bool_or("is_trading_day").alias("is_trading_day"), F.bool_or("asked").alias("asked")
    )
    w = Window.partitionBy("exchange").orderBy("day")  # distinct dates only
    session = F.when(F.col("is_trading_day"), F.col("day"))
    out = merged.select(
        "exchange", "day", "asked", F.coalesce("is_trading_day", F.lit(False)).alias("is_session"),
        F.last(session, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev_session"),
        F.first(session, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next_session"),
    )
    return out.where("asked").drop("asked")


def _clock(date_col: Column, seconds: Column) -> Column:
    local = F.timestamp_seconds(F.unix_date(date_col).cast("bigint") * 86400 + seconds)
    return F.to_utc_timestamp(local, MARKET_ZONE)


def with_session_times(df: DataFrame, calendar: DataFrame, exchange: str | None = None) -> DataFrame:
    """Add `opens_at` and `available_at` (the close), with the fallbacks where the calendar states none."""
    cal = calendar.select("exchange", "session", "open_s", "close_s")
    if exchange is not None:
        joined = df.join(cal.where(F.col("exchange") == exchange).drop("exchange"), "session", "left")
    else:
        joined = df.join(cal, ["exchange", "session"], "left")
    return joined.withColumns({
        "opens_at": _clock(F.col("session"), F.coalesce("open_s", F.lit(OPEN_FALLBACK_SECONDS))),
        "available_at": _clock(F.col("session"), F.coalesce("close_s", F.lit(CLOSE_FALLBACK_SECONDS))),
    }).drop("open_s", "close_s")


def known_by(df: DataFrame, cutoff: Column, column: str = "available_at", naive: bool = False) -> DataFrame:
    """Rows known by `cutoff`; naive stored times are read on the market clock."""
    known = F.to_utc_timestamp(column, MARKET_ZONE) if naive else F.col(column)
    return df.where(known <= cutoff)


# --- reports and filings --------------------------------------------------------------------------------------
def report_as_of(reports: DataFrame, on) -> DataFrame:
    on = F.lit(on).cast("date")
    eligible = reports.where((F.col("reported_on") <= on) & (F.col("effective_on") <= on))
    return latest_per_group(eligible, ["entity"], F.col("period_end"), F.col("effective_on"))


def without_superseded(rows: DataFrame, id_col: str, link_col: str) -> DataFrame:
    """Drop rows that another row of the same set replaces."""
    links = rows.select(F.col(link_col).alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    return rows.join(links, id_col, "left_anti")


def filings_as_of(filings: DataFrame, as_of: Column) -> DataFrame:
    return without_superseded(filings.where(F.col("available_at") <= as_of), "filing_id", "supersedes_id")


def scope_fallback(filings: DataFrame, wanted: str = "CONSOLIDATED") -> DataFrame:
    """Filings of the wanted scope; an entity without any falls back wholly to STANDALONE, flagged."""
    chosen = filings.groupBy("entity").agg(F.max(F.col("scope") == wanted).alias("_exact"))
    rows = filings.join(chosen, "entity")
    fallback = F.lit(False) if wanted != "CONSOLIDATED" else (~F.col("_exact") & (F.col("scope") == "STANDALONE"))
    return (
        rows.where((F.col("_exact") & (F.col("scope") == wanted)) | fallback)
        .withColumn("fallback_used", ~F.col("_exact")).drop("_exact")
    )


def classification_as_of(classifications: DataFrame, on, as_of: Column) -> DataFrame:
    eligible = classifications.where(
        (F.col("snapshot_date") <= F.lit(on).cast("date")) & (F.col("available_at") <= as_of)
    )
    return latest_per_group(eligible, ["series"], F.col("snapshot_date"), F.col("available_at"))
