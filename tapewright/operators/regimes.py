"""Market regimes of an index and attribution of trades to them. An index has one row per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.fixed_values import REGIMES, VOL_MINIMUM, VOL_RANK, VOL_WINDOW
from tapewright.functions.numbers import num, r8
from tapewright.operators.analytics import trade_analytics
from tapewright.operators.features import feature_frame

CODES = ("SMA_50", "SMA_200", "MOM_3M_63D", "VOLATILITY_20")
NONE = REGIMES[-1]


def nearest_rank(ordered: Column, share: str) -> Column:
    """ceil(p * n)-th smallest of a sorted array, null when empty."""
    n = F.size(ordered)
    rank = F.greatest(F.lit(1), F.least(F.ceil(num(share) * n).cast("int"), n))
    return F.when(n > 0, F.try_element_at(ordered, rank))


def regime_timeline(index_prices: DataFrame) -> DataFrame:
    """Features, volatility threshold and class per index and session.

    The threshold looks at the last 252 *valid* volatilities before the day: a range frame over the number of
    valid values seen, so rows without a value take no place.
    """
    tape = index_prices.withColumns({
        "series": F.col("index_id"), "volume": F.lit(0).cast("bigint"),
        "traded_value": F.lit(None).cast("decimal(24,2)"), "level": F.col("close")})
    frame = feature_frame(tape, CODES, keep=("level",)).withColumnRenamed("series", "index_id")
    w = Window.partitionBy("index_id")
    seen = F.count("VOLATILITY_20").over(w.orderBy("session").rowsBetween(Window.unboundedPreceding, -1))
    frame = frame.withColumn("_seen", seen)
    prior = F.array_sort(F.collect_list("VOLATILITY_20").over(w.orderBy("_seen").rangeBetween(-VOL_WINDOW, -1)))
    frame = frame.withColumn("prior_valid", F.least(F.col("_seen"), F.lit(VOL_WINDOW))).withColumn(
        "threshold", F.when(F.col("prior_valid") >= VOL_MINIMUM, nearest_rank(prior, VOL_RANK)))
    return classify(frame).drop("_seen")


def classify(frame: DataFrame) -> DataFrame:
    close = F.col("level").cast("double")
    sma50, sma200, mom, vol = (F.col(c) for c in CODES)
    few = F.col("prior_valid") < VOL_MINIMUM
    missing = sma50.isNull() | sma200.isNull() | mom.isNull() | vol.isNull()
    bull = (close > sma200) & (sma50 > sma200) & (mom > 0)
    bear = (close < sma200) & (sma50 < sma200) & (mom < 0)
    high = vol >= F.col("threshold")
    regime = (
        F.when(missing | few, NONE).when(high, "HIGH_VOLATILITY").when(bull, "TRENDING_BULL")
        .when(bear, "TRENDING_BEAR").otherwise("SIDEWAYS")
    )
    why_missing = F.array_compact(F.array(
        *[F.when(F.col(c).isNull(), F.lit(f"MISSING_REQUIRED_INPUT:{c}")) for c in CODES],
        F.when(few, F.lit(f"PRIOR_VOLATILITY_HISTORY_BELOW_{VOL_MINIMUM}"))))
    reasons = (
        F.when(missing | few, why_missing)
        .when(high, F.array(F.lit("VOLATILITY_20_AT_OR_ABOVE_PRIOR_NEAREST_RANK_THRESHOLD")))
        .when(bull, F.array(F.lit("ALL_BULL_CONDITIONS_MET"))).when(bear, F.array(F.lit("ALL_BEAR_CONDITIONS_MET")))
        .otherwise(F.array(F.lit("NO_HIGH_VOLATILITY_OR_TREND_RULE_MATCH"))))
    return frame.withColumns({"regime": regime, "reasons": reasons})


def _runs(timeline: DataFrame) -> DataFrame:
    w = Window.partitionBy("index_id").orderBy("session")
    changed = F.coalesce((F.lag("regime").over(w) != F.col("regime")).cast("int"), F.lit(1))
    marked = timeline.select("index_id", "session", "regime", changed.alias("_new")).withColumn(
        "run", F.sum("_new").over(w))
    return marked.groupBy("index_id", "run").agg(
        F.any_value("regime").alias("regime"), F.min("session").alias("start"), F.max("session").alias("end"),
        F.count(F.lit(1)).alias("sessions"))


def regime_transitions(timeline: DataFrame) -> DataFrame:
    w = Window.partitionBy("index_id").orderBy("run")
    return _runs(timeline).select(
        "index_id", F.col("start").alias("transition_date"), F.lag("regime").over(w).alias("previous"),
        F.col("regime").alias("new"), F.lag("sessions").over(w).alias("previous_sessions"),
    ).where(F.col("previous").isNotNull())


def regime_distribution(timeline: DataFrame) -> DataFrame:
    """All five classes per index; shares are of classified sessions only."""
    counts = timeline.groupBy("index_id").agg(*[F.count_if(F.col("regime") == r).alias(r) for r in REGIMES])
    classified = sum(F.col(r) for r in REGIMES[:-1])
    rows = F.explode(F.array(*[
        F.struct(F.lit(r).alias("regime"), F.col(r).alias("sessions"),
                 (F.lit(None).cast("double") if r == NONE else r8(F.try_divide(F.col(r), classified))).alias("share"))
        for r in REGIMES])).alias("x")
    return counts.select("index_id", rows).select("index_id", "x.*")


def current_regime(timeline: DataFrame) -> DataFrame:
    return _runs(timeline).groupBy("index_id").agg(
        F.max_by("regime", "run").alias("regime"), F.max_by("start", "run").alias("start"),
        F.max_by("sessions", "run").alias("sessions"))


def regime_coverage(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("index_id").agg(
        F.min("session").alias("first_session"), F.max("session").alias("last_session"),
        F.count(F.lit(1)).alias("sessions"),
        F.min(F.when(F.col("regime") != NONE, F.col("session"))).alias("first_classified"))


def regime_attribution(decided: DataFrame, timeline: DataFrame) -> DataFrame:
    """Trade metrics per regime of the signal date, all five classes and OVERALL; a date without one is insufficient.

    `timeline` is one index. Classes without setups show zero counts.
    """
    regimes = timeline.select(F.col("session").alias("signal"), "regime")
    tagged = decided.join(regimes, "signal", "left").withColumn(
        "classification", F.explode(F.array(F.coalesce("regime", F.lit(NONE)), F.lit("OVERALL"))))
    stats = trade_analytics(tagged, ["classification"])
    names = F.array(*[F.lit(r) for r in (*REGIMES, "OVERALL")])
    every = decided.sparkSession.range(1).select(F.explode(names).alias("classification"))
    zero = ["signal_count", "executed_count", "closed_count", "winning", "losing", "breakeven"]
    return every.join(stats, "classification", "left").fillna(0, zero).fillna(
        0.0, ["total_net_pnl", "gross_profit", "gross_loss"])


def attribution_by_index(decided: DataFrame, timeline: DataFrame) -> DataFrame:
    """As `regime_attribution`, for every index of the timeline: (index_id, classification) and the metrics.

    All classes of all indices are one aggregation over the setups, and OVERALL, which no index changes, is one more group of it. The
    regimes of a session travel as one map; indices and sessions are as few as in the calendar.
    """
    names = timeline.agg(F.array_sort(F.collect_set("index_id")).alias("_indices"))  # one row
    on_day = timeline.groupBy(F.col("session").alias("signal")).agg(
        F.map_from_entries(F.collect_list(F.struct("index_id", "regime"))).alias("_regimes"))
    own = F.transform("_indices", lambda i: F.struct(
        i.alias("index_id"), F.coalesce(F.try_element_at("_regimes", i), F.lit(NONE)).alias("classification")))
    whole = F.array(F.struct(F.lit("").alias("index_id"), F.lit("OVERALL").alias("classification")))
    tagged = decided.join(on_day, "signal", "left").crossJoin(names).withColumn("_tag", F.explode(F.concat(own, whole))).select(
        "*", "_tag.*").drop("_tag", "_indices", "_regimes")
    stats = trade_analytics(tagged, ["index_id", "classification"])
    every = names.select(F.explode("_indices").alias("index_id")).withColumn(
        "classification", F.explode(F.array(*[F.lit(r) for r in (*REGIMES, "OVERALL")])))
    found = every.join(stats.withColumnsRenamed({"index_id": "_i", "classification": "_c"}), (F.col("classification") == F.col("_c")) & (
        (F.col("_c") == "OVERALL") | (F.col("_i") == F.col("index_id"))), "left").drop("_i", "_c")
    zero = ["signal_count", "executed_count", "closed_count", "winning", "losing", "breakeven"]
    return found.fillna(0, zero).fillna(0.0, ["total_net_pnl", "gross_profit", "gross_loss"])


def attribution_reconciles(attributed: DataFrame) -> DataFrame:
    """Do the classes add up to OVERALL in trades and in profit?"""
    overall = F.col("classification") == "OVERALL"
    pick = lambda c, cond: F.sum(F.when(cond, F.col(c)))
    return attributed.agg(
        pick("executed_count", ~overall).alias("attributed_trades"), pick("executed_count", overall).alias("trades"),
        r8(pick("total_net_pnl", ~overall)).alias("attributed_pnl"),
        r8(pick("total_net_pnl", overall)).alias("pnl"),
    ).withColumns({
        "trades_reconciled": F.col("attributed_trades") == F.col("trades"),
        "pnl_reconciled": F.abs(F.col("attributed_pnl") - F.col("pnl")) < 0.005})
