"""Signals to statistics: history of features, setups, trades, costs, analytics and regime attribution.

The decided setups feed several statistics and are kept in executor storage for them; call `release` when done.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.operators import analytics, regimes, scan, trades
from tapewright.operators.asof_features import historical_features
from tapewright.operators.pit import members_by_session
from tapewright.operators.trades import TradeSettings


@dataclass
class Market:
    bars: DataFrame
    calendar: DataFrame
    actions: DataFrame
    memberships: DataFrame


@dataclass
class Backtest:
    decided: DataFrame

    def trades(self) -> DataFrame:
        return trades.executed(self.decided)

    def skipped(self) -> DataFrame:
        return trades.skip_reasons(self.decided)

    def costs(self) -> DataFrame:
        return trades.cost_totals(self.trades())

    def analytics(self, *keys: str) -> DataFrame:
        return analytics.trade_analytics(self.decided, keys)

    def by_year(self) -> DataFrame:
        return analytics.period_breakdown(self.decided)

    def holdout(self, boundary) -> DataFrame:
        return analytics.holdout_split(self.decided, boundary)

    def by_regime(self, index_prices: DataFrame) -> DataFrame:
        return regimes.regime_attribution(self.decided, regimes.regime_timeline(index_prices))

    def release(self) -> None:
        self.decided.unpersist()


def _run(market: Market, setups: DataFrame, settings: TradeSettings) -> Backtest:
    return Backtest(trades.label_trades(setups, market.bars, market.calendar, market.actions, settings).persist())


def strategy_backtest(market: Market, rules: Sequence[scan.Rule], settings: TradeSettings, policy: str = "ADJUSTED") -> Backtest:
    history = historical_features(
        market.bars, market.calendar, market.actions, start=settings.start, end=settings.end, policy=policy,
        codes=scan.required_codes(rules), exchange=settings.exchange)
    members = members_by_session(market.memberships, market.calendar, settings.start, settings.end)
    return _run(market, scan.historical_signals(history, members, rules), settings)


def composition_outcomes(
    market: Market, components: Mapping[str, Sequence[scan.Rule]], required: int, settings: TradeSettings, policy: str = "ADJUSTED",
) -> DataFrame:
    codes = scan.required_codes(*components.values())
    history = historical_features(
        market.bars, market.calendar, market.actions, start=settings.start, end=settings.end, policy=policy, codes=codes,
        exchange=settings.exchange)
    members = members_by_session(market.memberships, market.calendar, settings.start, settings.end)
    return scan.historical_composition(history, members, components, required)


def composition_backtest(market: Market, outcomes: DataFrame, settings: TradeSettings) -> Backtest:
    return _run(market, outcomes.where(F.col("status") == "MATCHED").select("series", "session"), settings)
