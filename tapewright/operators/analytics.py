"""Trade statistics from decided setups (one row per setup with `decision`), one aggregate per grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.numbers import cents, half_up_div, r8, units8
from tapewright.operators.ranks import exact_percentiles

PERCENTILES = (5, 25, 50, 75, 95)


def _back(units: Column, per: float) -> Column:
    return units.cast("double") / F.lit(per)


def _metrics() -> list[Column]:
    trade = F.col("decision") == "TRADE"
    closed = trade & F.col("net_pnl").isNotNull()
    of = lambda c: F.when(closed, c)
    n = F.count_if(closed)
    net, gross, cost = (cents(of(F.col(c))) for c in ("net_pnl", "gross_pnl", "total_costs"))
    ret, gret = units8(of(F.col("net_return"))), units8(of(F.col("gross_return")))
    wins, losses = F.count_if(closed & (F.col("net_pnl") > 0)), F.count_if(closed & (F.col("net_pnl") < 0))
    gain = F.coalesce(F.sum(F.when(net > 0, net)), F.lit(0))
    loss = F.sum(F.when(net < 0, net))
    mean8 = lambda c: _back(half_up_div(F.sum(c), n), 1e8)
    mean2 = lambda c: _back(half_up_div(F.sum(c), n), 1e2)
    total = lambda c: _back(F.coalesce(F.sum(c), F.lit(0)), 1e2)
    deployed = F.sum(cents(of(F.col("deployed"))))
    none = F.lit(None).cast("string")
    warnings = F.array_join(F.array_compact(F.array(
        F.when(n == 0, "NO_TRADES").when(n < 10, "VERY_LOW_SAMPLE_SIZE").when(n < 30, "LOW_SAMPLE_SIZE"),
        F.when(loss.isNotNull(), none).when(wins > 0, "PROFIT_FACTOR_UNDEFINED_NO_LOSING_TRADES")
        .when(n > 0, "PROFIT_FACTOR_UNDEFINED_NO_GAINS_OR_LOSSES"),
        F.when(n == 1, "INSUFFICIENT_TRADES_STANDARD_DEVIATION"),
    )), ",")
    return [
        F.count(F.lit(1)).alias("signal_count"), F.count_if(trade).alias("executed_count"), n.alias("closed_count"),
        F.count_if(closed & (F.col("exit_reason") == "FORCED_END_OF_TEST")).alias("forced_end_count"),
        F.count_if(closed & (F.col("exit_reason") != "FORCED_END_OF_TEST")).alias("closed_normal_count"),
        wins.alias("winning"), losses.alias("losing"), (n - wins - losses).alias("breakeven"),
        r8(F.try_divide(wins, n)).alias("win_rate"), r8(F.try_divide(losses, n)).alias("loss_rate"),
        mean8(gret).alias("average_gross_return"), mean8(ret).alias("average_net_return"),
        mean2(gross).alias("average_gross_pnl"), mean2(net).alias("average_net_pnl"),
        total(gross).alias("total_gross_pnl"), total(net).alias("total_net_pnl"), total(cost).alias("total_costs"),
        r8(F.try_divide(F.sum(cost).cast("double"), deployed.cast("double"))).alias("cost_drag"),
        mean2(cost).alias("average_cost"),
        r8(F.try_divide(gain.cast("double"), -loss.cast("double"))).alias("profit_factor"),
        mean2(net).alias("expectancy"),
        _back(F.max(ret), 1e8).alias("best_return"), _back(F.min(ret), 1e8).alias("worst_return"),
        F.when(n >= 2, r8(F.stddev_pop(of(F.col("net_return")).cast("double")))).alias("stddev_net_return"),
        mean8(F.when(closed, F.col("holding_sessions")).cast("bigint") * 10**8).alias("average_holding"),
        F.max(F.when(closed, F.col("holding_sessions"))).cast("bigint").alias("maximum_holding"),
        mean8(units8(of(F.col("mae")))).alias("average_mae"), mean8(units8(of(F.col("mfe")))).alias("average_mfe"),
        warnings.alias("warnings"),
        _back(gain, 1e2).alias("gross_profit"), _back(F.coalesce(loss, F.lit(0)), 1e2).alias("gross_loss"),
        F.when(wins > 0, _back(half_up_div(gain, wins), 1e2)).alias("average_win"),
        F.when(losses > 0, _back(half_up_div(loss, losses), 1e2)).alias("average_loss"),
    ]


def trade_analytics(decided: DataFrame, keys: Sequence[str] = (), percentiles: bool = True) -> DataFrame:
    """All trade metrics per group of setups; groups come from setups, so one without trades still shows."""
    if not keys:
        return trade_analytics(decided.withColumn("_all", F.lit(0)), ["_all"], percentiles).drop("_all")
    stats = decided.groupBy(*keys).agg(*_metrics())
    if not percentiles:
        return stats
    return stats.join(return_percentiles(decided, keys), list(keys), "left")


def return_percentiles(decided: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    if not keys:
        return return_percentiles(decided.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")
    closed = decided.where((F.col("decision") == "TRADE") & F.col("net_return").isNotNull())
    found = exact_percentiles(closed, keys, units8(F.col("net_return")), PERCENTILES)
    return found.select(*keys, *[_back(F.col(f"p{h:02d}"), 1e8).alias(f"percentile_{h:02d}") for h in PERCENTILES])


def period_breakdown(decided: DataFrame) -> DataFrame:
    """By calendar year of the signal."""
    return trade_analytics(decided.withColumn("label", F.year("signal").cast("string")), ["label"])


def holdout_split(decided: DataFrame, boundary) -> DataFrame:
    """IN_SAMPLE, OUT_OF_SAMPLE and OVERALL in one pass over the setups."""
    side = F.when(F.col("signal") < F.lit(boundary).cast("date"), "IN_SAMPLE").otherwise("OUT_OF_SAMPLE")
    tagged = decided.withColumn("label", F.explode(F.array(side, F.lit("OVERALL"))))
    return trade_analytics(tagged, ["label"])


def return_histogram(decided: DataFrame, bins: int = 8) -> DataFrame:
    """Equal-width bins between the smallest and the largest return; one bin if they coincide."""
    closed = decided.where((F.col("decision") == "TRADE") & F.col("net_return").isNotNull()).select(
        F.col("net_return").cast("double").alias("r"))
    bounds = closed.agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_of = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(F.col("r") - F.col("lo"), width)), F.lit(bins - 1)))
    counted = closed.crossJoin(bounds).groupBy(bin_of.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = bounds.where(F.col("lo").isNotNull()).select(
        "lo", width.alias("w"),
        F.explode(F.sequence(F.lit(0), F.when(width == 0, 0).otherwise(bins - 1))).alias("k")
    ).withColumn("bin", F.col("k").cast("bigint"))
    return every.join(counted, "bin", "left").select(
        "bin", r8(F.col("lo") + F.col("w") * F.col("bin")).alias("lower"),
        r8(F.col("lo") + F.col("w") * (F.col("bin") + 1)).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("trades"))
