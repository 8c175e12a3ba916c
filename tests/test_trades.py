"""Trades on a handful of price paths: each settings is one job over many series, one path a series."""

from decimal import Decimal

import pytest
from tests.helpers import BAR, action, actions, bar, calendar, days, noon
from pyspark.sql import functions as F

from tapewright.functions.costs import leg_costs
from tapewright.operators import scan
from tapewright.operators.trades import TradeSettings, executed, label_trades
from tapewright.plans.backtest import Market, composition_backtest, composition_outcomes

WEEK = days(8)
STEADY = {i: (400, 404, 396, 401) for i in range(8)}


def opens(*prices, first=1):
    """Quiet sessions from `first` on that open at the given prices."""
    return {first + i: (p, p + 1, p - 1, p) for i, p in enumerate(prices)}


def labelled(spark, paths, signals=None, acts=(), **settings):
    """{series: its labelled setups in order} for paths {series: {session number: (open, high, low, close)}}."""
    bars = [bar(k, WEEK[i], *map(Decimal, map(str, row))) for k, path in paths.items() for i, row in path.items()]
    asked = [(k, WEEK[i]) for k in paths for i in (signals or {}).get(k, (0,))]
    rows = label_trades(
        spark.createDataFrame(asked, "series bigint, session date"), spark.createDataFrame(bars, BAR), calendar(spark, WEEK), actions(spark, acts),
        TradeSettings(**{"holding": 2, "notional": "50000", "slippage_bps": "0", "max_exit_delay": 3, **settings})).orderBy("series", "signal").collect()
    return {k: [r for r in rows if r.series == k] for k in paths}


def test_timed_trades_sizes_and_refusals(spark):
    paths = {
        1: opens(200, 206, 212, 220), 2: opens(206, 212, 220, first=2), 3: opens(60_000, 60_010, 60_020), 4: STEADY, 5: opens(125),
        6: STEADY, 7: opens(333, 333, 340)}
    got = labelled(spark, paths, signals={4: (7,), 5: (0, 4), 6: (0, 1, 3, 6)})
    first = got[1][0]
    assert (first.entry_session, first.exit_session, first.raw_entry, first.raw_exit) == (WEEK[1], WEEK[3], Decimal("200.0000"), Decimal("212.0000"))
    assert first.quantity0 == 250 and first.gross_pnl == 3000 and first.holding_sessions == 2 and first.exit_reason == "TIME_EXIT"
    assert got[2][0].decision == "ENTRY_PRICE_UNAVAILABLE" and got[3][0].decision == "INSUFFICIENT_NOTIONAL_FOR_ONE_SHARE"
    assert got[4][0].decision == "ENTRY_OUTSIDE_TEST_RANGE" and got[7][0].quantity0 == 150
    # A position that can't be closed stays open for good.
    assert [(r.decision, r.exit_reason) for r in got[5]][0] == ("TRADE", "EXIT_PRICE_UNAVAILABLE") and got[5][1].decision == "ALREADY_OPEN_POSITION"
    assert [r.decision for r in got[6]] == ["TRADE", "ALREADY_OPEN_POSITION", "TRADE", "TRADE"]
    assert got[6][3].exit_reason == "FORCED_END_OF_TEST" and got[6][3].raw_exit == Decimal("401.0000")


def test_stops_and_targets(spark):
    """Entry at 400: the stop is at 380, the target at 432."""
    quiet = (400, 405, 395, 402)
    paths = {
        11: {1: (400, 440, 370, 410)}, 12: {1: quiet, 2: (371, 390, 365, 380)}, 13: {1: quiet, 2: (444, 450, 440, 445)},
        14: {1: (400, 403, 380, 390)}, 15: {1: (400, 432, 399, 420)}, 16: {1: quiet, 2: (401, 431.95, 380.05, 400), 3: (399, 400, 398, 399), 4: (398, 400, 397, 399)}}
    got = {k: r[0] for k, r in labelled(spark, paths, holding=3, stop_loss="0.05", profit_target="0.08").items()}
    assert {k: (r.exit_reason, str(r.raw_exit)) for k, r in got.items()} == {
        11: ("STOP_LOSS", "380.0000"), 12: ("STOP_LOSS", "371.0000"), 13: ("PROFIT_TARGET", "444.0000"), 14: ("STOP_LOSS", "380.0000"),
        15: ("PROFIT_TARGET", "432.0000"), 16: ("TIME_EXIT", "398.0000")}
    assert "AMBIGUOUS_INTRADAY_PATH_STOP_FIRST" in got[11].warnings and not any("AMBIGUOUS" in w for w in got[14].warnings or ())


def test_slippage_works_against_the_trade(spark):
    got = labelled(spark, {21: opens(500, 520)}, holding=1, slippage_bps="20")[21][0]
    assert (got.slipped_entry, got.slipped_exit, got.quantity0) == (Decimal("501.0000"), Decimal("518.9600"), 99)


@pytest.mark.parametrize(("kind", "num", "times"), [("STOCK_SPLIT", "5", 5), ("BONUS", "3", 4)])
def test_share_changes_in_the_hold(spark, kind, num, times):
    path = {1: (400, 404, 396, 400), **opens(*[400 // times] * 3, first=2)}
    got = labelled(spark, {31: path}, acts=[action(1, 31, kind, WEEK[2], num, "1", noon(WEEK[0]))])[31][0]
    assert got.quantity == times * got.quantity0 and got.gross_pnl == 0


def test_costs_of_a_leg(spark):
    t = spark.range(1).select(
        leg_costs(F.lit("100000"), "BUY").alias("b"), leg_costs(F.lit("100000"), "SELL").alias("s"),
        leg_costs(F.lit("100000"), "SELL", {"brokerage_flat": "20", "brokerage_rate": "0.0001", "dp_sell": "15.50"}).alias("x")).first()
    assert [t.b[c] for c in ("stt", "exchange_charge", "sebi_charge", "gst", "stamp_duty", "total_charges")] == [
        Decimal(v) for v in ("100.00", "3.07", "0.10", "0.57", "15.00", "118.74")]
    assert t.s["stamp_duty"] == 0 and t.s["total_charges"] == Decimal("103.74")
    assert t.x["brokerage"] == Decimal("30.00") and t.x["dp_charge"] == Decimal("15.50")


def test_composition_history_end_to_end(spark):
    """Numbers of the known three-security, 230-session history with N=2 of 3 loose rule sets."""
    sessions = [d for d in days(400) if d.weekday() < 5][:230]
    rows = []
    for i, d in enumerate(sessions):
        for k in range(3):
            c = Decimal("75") + Decimal("0.40") * i + k
            rows.append(bar(k, d, c - Decimal("0.10"), c + Decimal("0.60"), c - Decimal("0.60"), c, 1_000_000 + 2_000 * i + k))
    market = Market(
        spark.createDataFrame(rows, BAR), calendar(spark, sessions), actions(spark),
        spark.createDataFrame([("U", k, sessions[0], None) for k in range(3)], "index_id string, series bigint, valid_from date, valid_to date"))
    loose = {
        "MOMENTUM_TREND": {"min_momentum_3m": "-1", "min_momentum_6m": "-1", "min_volume_ratio_20": "0"},
        "BREAKOUT_20D": {"min_breakout_pct_20": "-1", "min_volume_ratio_20": "0", "min_close_location": "0", "max_atr_pct_14": "2"},
        "MEAN_REVERSION_PULLBACK": {"max_rsi_14": "100", "max_distance_sma_20": "2", "max_return_5d": "5", "max_atr_pct_14": "2"}}
    settings = TradeSettings(holding=3, slippage_bps="0", start=str(sessions[198]), end=str(sessions[-1]))
    outcomes = composition_outcomes(market, {n: scan.rules_for(n, o) for n, o in loose.items()}, 2, settings, "RAW").persist()
    assert outcomes.count() == 96 and outcomes.where("status = 'MATCHED'").count() == 93
    run = composition_backtest(market, outcomes, settings)
    stats = run.analytics().first()
    assert executed(run.decided).count() == 24
    assert stats.total_net_pnl == 11210.71 and stats.average_net_return == 0.00467518
    assert run.costs().first().total_charges == Decimal("5360.69")
    run.release()


def test_large_quantities_and_plan(spark):
    """A notional of a billion billions at small prices; the tape is exchanged once, and nothing leaves the JVM."""
    paths = {1: {i: (1, 1, 1, 1) for i in range(1, 8)}}
    first = labelled(spark, paths, acts=(action(1, 1, "STOCK_SPLIT", WEEK[2], 1000, 1, noon(WEEK[0])),), notional="1000000000000000")[1][0]
    assert first.quantity0 == 10**15 and first.quantity == 10**18 and first.exit_turnover == 10**18 and first.entry_turnover == 10**15
    frame = label_trades(
        spark.createDataFrame([(1, WEEK[0])], "series bigint, session date"), spark.createDataFrame([bar(1, WEEK[1], 1, 1, 1, 1)], BAR).alias("tape"),
        calendar(spark, WEEK), actions(spark, ()), TradeSettings())
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(series") <= 3 and "Python" not in plan and "InArrow" not in plan


def test_a_leg_works_its_turnover_out_once(spark):
    """Costs of a null turnover are null but for the fixed charge, and the expression of the turnover stands in the plan once."""
    rows = spark.createDataFrame([(1, Decimal("100000")), (2, None)], "k int, v decimal(12,0)")
    legs = rows.select("k", leg_costs(F.col("v") * F.lit(3).cast("decimal(3,0)"), "SELL", {"dp_sell": "15.50"}).alias("c"))
    got = {r.k: r.c for r in legs.collect()}
    assert got[1].turnover == 300000 and got[1].stt == 300 and got[1].total_charges == sum(
        (got[1].brokerage, got[1].stt, got[1].exchange_charge, got[1].sebi_charge, got[1].gst, got[1].stamp_duty, got[1].dp_charge))
    assert got[2].turnover is None and got[2].total_charges is None and got[2].dp_charge == Decimal("15.50")
    assert legs._jdf.queryExecution().optimizedPlan().toString().count(" * 3") == 1
