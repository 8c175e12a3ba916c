"""Data-quality checks and coverage counts. Each check is one row: name, status, issue_count."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.operators.pit import session_index


def ohlc_flags() -> Column:
    """Number of broken rules of a row: negative price, high below low, open or close outside, negative volume."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    rules = [(o < 0) | (h < 0) | (lo < 0) | (c < 0), h < lo, (o < lo) | (o > h), (c < lo) | (c > h), v < 0]
    return sum(F.when(rule, 1).otherwise(0) for rule in rules)


def _check(name: str, issues: Column, bad: str) -> list[Column]:
    n = F.coalesce(issues, F.lit(0)).cast("bigint")
    return [F.lit(name).alias("check"), F.when(n > 0, bad).otherwise("HEALTHY").alias("status"), n.alias("issue_count")]


def ohlc_violations(bars: DataFrame) -> DataFrame:
    return bars.agg(F.sum(ohlc_flags()).alias("n")).select(*_check("OHLC validation", F.col("n"), "FAILED"))


def duplicate_keys(bars: DataFrame) -> DataFrame:
    groups = bars.groupBy("series", "session").count().where("count > 1")
    return groups.agg(F.count(F.lit(1)).alias("n")).select(*_check("Duplicate detection", F.col("n"), "FAILED"))


def missing_per_series(bars: DataFrame, securities: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar sessions between a series' first and last price that have no price, for active series.

    Expected counts are differences of session ordinals, so no series x session grid is built; first and last
    prices may fall on days that are no sessions, hence ordinals of the next and previous session.
    """
    active = securities.where("is_active").select("series", "exchange")
    own = bars.join(active, "series")
    ordinals = session_index(calendar).select("exchange", "session", "idx")
    bounds = own.groupBy("series", "exchange").agg(F.min("session").alias("lo"), F.max("session").alias("hi"))
    seen = own.join(ordinals, ["exchange", "session"], "left_semi").groupBy("series").agg(
        F.count(F.lit(1)).alias("observed"))
    days = bounds.select("exchange", F.col("lo").alias("day")).union(bounds.select("exchange", "hi")).distinct()
    marks = _ordinals_around(days, ordinals)
    placed = bounds.join(marks.select("exchange", F.col("day").alias("lo"), F.col("upto").alias("before_lo"),
                                      F.col("exact").alias("lo_exact")), ["exchange", "lo"]).join(
        marks.select("exchange", F.col("day").alias("hi"), F.col("upto").alias("upto_hi")), ["exchange", "hi"])
    expected = F.col("upto_hi") - F.col("before_lo") + F.col("lo_exact").cast("int")
    return placed.join(seen, "series", "left").select(
        "series", F.greatest(F.lit(0), expected - F.coalesce("observed", F.lit(0))).cast("bigint").alias("missing"))


def _ordinals_around(days: DataFrame, ordinals: DataFrame) -> DataFrame:
    """Number of sessions up to each day, and whether the day is one. Distinct dates only, so the window is small."""
    from pyspark.sql import Window

    sessions = ordinals.select("exchange", F.col("session").alias("day"), F.lit(1).alias("is_session"))
    both = sessions.unionByName(days.select("exchange", "day", F.lit(0).alias("is_session")))
    merged = both.groupBy("exchange", "day").agg(F.max("is_session").alias("s"), F.min("is_session").alias("asked"))
    w = Window.partitionBy("exchange").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return merged.select("exchange", "day", F.sum("s").over(w).alias("upto"), (F.col("s") == 1).alias("exact"), "asked"
                         ).where("asked = 0").drop("asked")


def missing_sessions(bars: DataFrame, securities: DataFrame, calendar: DataFrame) -> DataFrame:
    missing = missing_per_series(bars, securities, calendar)
    return missing.agg(F.sum("missing").alias("n")).select(*_check("Session coverage", F.col("n"), "WARNING"))


def unknown_calendar(bars: DataFrame, securities: DataFrame, calendar: DataFrame) -> DataFrame:
    days = bars.join(securities.select("series", "exchange"), "series").select("exchange", "session").distinct()
    unknown = days.join(calendar, ["exchange", "session"], "left_anti")
    return unknown.agg(F.countDistinct("session").alias("n")).select(
        *_check("Calendar evidence", F.col("n"), "WARNING"))


def freshness(bars: DataFrame, calendar: DataFrame, as_of) -> DataFrame:
    on = F.lit(as_of).cast("date")
    latest = bars.agg(F.max("session").alias("data"))
    known = calendar.where(F.col("is_trading_day") & (F.col("session") <= on)).select("session").distinct()
    joined = known.crossJoin(latest)  # one row on the right
    facts = joined.agg(
        F.max("session").alias("cal"), F.count_if(F.col("data").isNull() | (F.col("session") > F.col("data"))).alias("stale"))
    old = F.datediff(on, F.col("cal")) > 7
    status = (
        F.when(F.col("cal").isNull(), "FAILED").when(old, "WARNING").when(F.col("stale") > 0, "WARNING")
        .otherwise("HEALTHY"))
    count = F.when(F.col("cal").isNull() | old, F.lit(1)).otherwise(F.col("stale")).cast("bigint")
    return facts.select(F.lit("Freshness").alias("check"), status.alias("status"), count.alias("issue_count"))


def artifact_health(log: DataFrame) -> DataFrame:
    n = log.agg(F.count_if(F.col("status").isin("FAILED", "CONFLICT")).alias("failed"),
                F.count_if(F.col("status") == "PARTIAL").alias("partial"))
    return n.select(
        F.lit("Source artifacts").alias("check"),
        F.when(F.col("failed") > 0, "FAILED").when(F.col("partial") > 0, "WARNING").otherwise("HEALTHY").alias("status"),
        (F.col("failed") + F.col("partial")).alias("issue_count"))


MEMBERSHIP_ISSUES = ("UNEXPECTED_MEMBER_COUNT", "UNKNOWN_INDEX_SECURITY", "INDEX_SNAPSHOT_CONFLICT")
ACTION_ISSUES = ("AMBIGUOUS_ACTION_RATIO", "UNSUPPORTED_CORPORATE_ACTION", "AVAILABILITY_TIMESTAMP_UNKNOWN",
                 "DUPLICATE_CORPORATE_ACTION", "CORPORATE_ACTION_REVISION_UNRESOLVED")


def issue_health(issues: DataFrame, actions: DataFrame) -> DataFrame:
    """Membership issues, and action issues together with official actions that lack a knowledge time."""
    counts = issues.agg(F.count_if(F.col("code").isin(*MEMBERSHIP_ISSUES)).alias("m"),
                        F.count_if(F.col("code").isin(*ACTION_ISSUES)).alias("a"))
    bare = actions.agg(F.count_if((F.col("origin") == "OFFICIAL") & F.col("available_at").isNull()).alias("u"))
    both = counts.crossJoin(bare)  # one row each
    members = both.select(*_check("Index membership ingestion", F.col("m"), "WARNING"))
    acts = both.select(
        F.lit("Corporate-action PIT coverage").alias("check"),
        F.when(F.col("u") > 0, "FAILED").when(F.col("a") > 0, "WARNING").otherwise("HEALTHY").alias("status"),
        (F.col("u") + F.col("a")).alias("issue_count"))
    return members.unionByName(acts)


def overall_status(*checks: DataFrame) -> DataFrame:
    every = reduce(DataFrame.unionByName, checks)
    rank = F.when(F.col("status") == "FAILED", 2).when(F.col("status") == "WARNING", 1).otherwise(0)
    worst = F.max(rank)
    return every.agg(
        F.when(worst == 2, "FAILED").when(worst == 1, "WARNING").otherwise("HEALTHY").alias("status"),
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("status") != "HEALTHY").alias("not_healthy"))


# --- coverage ---------------------------------------------------------------------------------------------
def origin_mode(*tables: DataFrame) -> DataFrame:
    """OFFICIAL, DEMO, MIXED or UNKNOWN over the origins of several tables."""
    rows = reduce(DataFrame.unionByName, [t.select("origin") for t in tables])
    n = rows.agg(*[F.count_if(F.col("origin") == o).alias(o.lower()) for o in ("OFFICIAL", "DEMO", "UNKNOWN")])
    mode = (
        F.when((F.col("official") > 0) & (F.col("demo") > 0), "MIXED").when(F.col("official") > 0, "OFFICIAL")
        .when(F.col("demo") > 0, "DEMO").otherwise("UNKNOWN"))
    return n.withColumn("mode", mode)


def price_coverage(bars: DataFrame, securities: DataFrame, origin: str = "OFFICIAL") -> DataFrame:
    """Counted per series first, so distinct counts never shuffle price rows by one key."""
    own = bars.join(securities.where(F.col("origin") == origin).select("series"), "series", "left_semi")
    per_day = own.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    days = per_day.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("sessions"),
                       F.min("session").alias("first_session"), F.max("session").alias("last_session"))
    series = own.select("series").distinct().agg(F.count(F.lit(1)).alias("series"))
    return days.crossJoin(series)  # one row each


def session_gaps(bars: DataFrame, calendar: DataFrame, index_prices: DataFrame) -> DataFrame:
    """Sessions without any price, index days without any price, and sessions inside the index span without one."""
    priced = bars.select("session").distinct()
    sessions = calendar.where("is_trading_day").select("session").distinct()
    index_days = index_prices.select("session").distinct()
    span = index_days.agg(F.min("session").alias("lo"), F.max("session").alias("hi"))
    inside = sessions.crossJoin(span).where(F.col("session").between(F.col("lo"), F.col("hi")))  # one row on the right
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(sessions.join(priced, "session", "left_anti"), "sessions_without_prices").crossJoin(
        count(index_days.join(priced, "session", "left_anti"), "benchmark_without_prices")).crossJoin(
        count(inside.join(index_days, "session", "left_anti"), "sessions_without_benchmark"))


def member_history_depth(memberships: DataFrame, bars: DataFrame, target_start) -> DataFrame:
    """History of the members of each index' latest snapshot."""
    last = memberships.groupBy("index_id").agg(F.max("valid_from").alias("valid_from"))
    members = memberships.join(last, ["index_id", "valid_from"], "left_semi").select("index_id", "series").distinct()
    per = bars.groupBy("series").agg(
        F.count("session").alias("n"), F.min("session").alias("lo"), F.max("session").alias("hi"))
    whole = bars.agg(F.countDistinct("session").alias("sessions"), F.max("session").alias("end"))
    rows = members.join(per, "series", "left").crossJoin(whole)  # one row on the right
    gap = (F.col("sessions") >= 20) & (F.col("n") < F.floor(F.col("sessions") * F.lit("0.95").cast("decimal(3,2)")))
    return rows.groupBy("index_id").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("n") > 0).alias("with_any"),
        F.count_if(F.col("n") >= 200).alias("with_200"), F.count_if(F.col("n") >= 252).alias("with_252"),
        F.count_if((F.col("lo") <= F.lit(target_start).cast("date")) & (F.col("hi") == F.col("end"))).alias("with_target"),
        F.count_if(gap).alias("significant_gaps"))


def fundamental_coverage(filings: DataFrame, facts: DataFrame, mapped: Column) -> DataFrame:
    heads = filings.agg(
        F.count(F.lit(1)).alias("filings"), F.countDistinct("entity").alias("entities"),
        F.count_if(F.col("scope") == "CONSOLIDATED").alias("consolidated"),
        F.count_if(F.col("scope") == "STANDALONE").alias("standalone"),
        F.min("period_end").alias("first_period"), F.max("period_end").alias("last_period"),
        F.min("available_at").alias("first_available"), F.max("available_at").alias("last_available"))
    body = facts.agg(F.count(F.lit(1)).alias("facts"), F.count_if(mapped).alias("mapped"),
                     F.count_if(~mapped).alias("unmapped"))
    return heads.crossJoin(body)  # one row each


def classification_coverage(classifications: DataFrame, members: DataFrame, benchmarks: DataFrame) -> DataFrame:
    rows = classifications.select("series", "snapshot_date", "sector")
    known = rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("series").alias("classified"),
                     F.max("snapshot_date").alias("last_snapshot"))
    inside = rows.select("series").distinct().join(members.select("series").distinct(), "series", "left_semi").agg(
        F.count(F.lit(1)).alias("members_classified"))
    mapped = rows.join(benchmarks.select("sector").distinct(), "sector", "left_semi").agg(
        F.count(F.lit(1)).alias("benchmark_mappings"))
    return known.crossJoin(inside).crossJoin(mapped)  # one row each


def membership_coverage(memberships: DataFrame, indices: DataFrame | None = None) -> DataFrame:
    """Snapshots of every index; of the given `indices` those without a snapshot too, as NONE."""
    per = memberships.groupBy("index_id", "valid_from").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.count(F.lit(1)) == 1, "CURRENT_SNAPSHOT_ONLY").otherwise("BOUNDED_SNAPSHOT_SEQUENCE")
    held = per.groupBy("index_id").agg(
        F.min("valid_from").alias("first_snapshot"), F.max("valid_from").alias("last_snapshot"),
        F.count(F.lit(1)).alias("snapshots"), F.max_by("n", "valid_from").alias("latest_members"), kind.alias("kind"))
    if indices is None:
        return held
    every = indices.select("index_id").unionByName(held.select("index_id")).distinct()
    return every.join(held, "index_id", "left").fillna(0, ["snapshots", "latest_members"]).fillna("NONE", ["kind"])


def dataset_readiness(measured: DataFrame, rules: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add `status` to rows of (code, measures) by each data set's own rule: what makes it READY, and what PARTIAL, as conditions
    on its measures. A data set without a rule, or one whose measures are unknown, is UNAVAILABLE."""
    ready, partial = F.lit(False), F.lit(False)
    for code, (full, some) in rules.items():
        ready = F.when(F.col("code") == code, F.expr(full)).otherwise(ready)
        partial = F.when(F.col("code") == code, F.expr(some)).otherwise(partial)
    return readiness(measured, ready, partial)


def readiness(counts: DataFrame, ready: Column, partial: Column) -> DataFrame:
    return counts.withColumn("status", F.when(ready, "READY").when(partial, "PARTIAL").otherwise("UNAVAILABLE"))


def overall_readiness(datasets: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    up, down = F.count_if(F.col("status") == "READY"), F.count_if(F.col("status") == "UNAVAILABLE")
    return datasets.agg(
        n.alias("datasets"), F.when(up == n, "READY").when(down == n, "UNAVAILABLE").otherwise("PARTIAL").alias("status"))


def recent_rows(log: DataFrame, time_col: str, id_col: str, limit: int = 25) -> DataFrame:
    return log.orderBy(F.col(time_col).desc(), F.col(id_col).desc()).limit(limit)
