import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from tests.helpers import action, actions, days, noon
from pyspark.sql import functions as F

from tapewright.operators import actions as act
from tapewright.operators import pit, regimes, scan
from tapewright.operators.ingest import dedupe_two_keys
from tapewright.operators.portfolio import running_in_two_levels
from tapewright.operators.ranks import cume_dist, exact_percentiles


def half_up(x):
    return int(abs(x) + Decimal("0.5")) * (1 if x >= 0 else -1)


def test_percentiles_against_brute_force_with_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot", rng.randint(-10**6, 10**6)) for _ in range(1500)] + [("few", 3), ("few", 4)] + [("one", -7)]
    out = {r.g: r for r in exact_percentiles(spark.createDataFrame(rows, "g string, v bigint"), ["g"], F.col("v"), [5, 25, 50, 75, 95]).collect()}
    for g in ("hot", "few", "one"):
        ordered = sorted(v for k, v in rows if k == g)
        for h in (5, 25, 50, 75, 95):
            pos = Decimal(h) * (len(ordered) - 1) / 100
            lo = int(pos)
            hi = min(lo + 1, len(ordered) - 1)
            assert out[g][f"p{h:02d}"] == half_up(ordered[lo] + (ordered[hi] - ordered[lo]) * (pos - lo))


def test_cume_dist_against_brute_force(spark):
    rng = random.Random(6)
    values = [rng.randint(-50_000, 50_000) for _ in range(800)] + [7] * 300
    df = spark.createDataFrame([("g", v) for v in values], "g string, v bigint")
    for r in cume_dist(df, ["g"], F.col("v")).collect():
        assert r.at_or_below == sum(x <= r.v for x in values) and r.total == len(values)


def test_running_sum_in_two_levels(spark):
    rows = [("p", i // 40, i, (i * 7) % 13) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, b int, o int, x bigint")
    total = 0
    for n, r in enumerate(running_in_two_levels(df, ["k"], "b", ["o"], {"run": "x"}).orderBy("o").collect(), 1):
        total += r.x
        assert (r.sequence, r.run) == (n, total)


def test_two_key_deduplication_is_greedy_in_file_order(spark):
    rng = random.Random(7)
    rows = [("f", i, f"s{rng.randint(0, 25)}", f"i{rng.randint(0, 25)}", None) for i in range(120)]
    schema = "artifact_id string, row_no bigint, symbol string, isin string, issue struct<severity:string,code:string,message:string>"
    out = dedupe_two_keys(spark.createDataFrame(rows, schema), (["symbol"], "A", "a"), (["isin"], "B", "b"))
    kept, symbols, isins = {}, set(), set()
    for _, i, s, n, _ in rows:
        kept[i] = "A" if s in symbols else "B" if n in isins else None
        if kept[i] is None:
            symbols.add(s)
            isins.add(n)
    got = {r.row_no: r.issue.code if r.issue else None for r in out.collect()}
    assert {k: v is None for k, v in got.items()} == {k: v is None for k, v in kept.items()}


def test_chain_roots_and_cycles(spark):
    d = days(3)
    chain = [action(i, 1, "BONUS", d[0], "1", "1", noon(d[0]), i - 1 if i > 1 else None) for i in range(1, 38)]
    ring = [action(100 + i, 2, "BONUS", d[0], "1", "1", noon(d[0]), 100 + (i + 1) % 5) for i in range(5)]
    tail = [action(200, 2, "BONUS", d[0], "1", "1", noon(d[0]), 100)]
    out = {r.id: r for r in act.chain_roots(actions(spark, chain + ring + tail)).collect()}
    assert all(out[i].root == 1 and not out[i].cyclic for i in range(1, 38))
    assert all(out[i].cyclic for i in (100, 101, 102, 103, 104, 200))


def test_revisions_become_effective_when_known(spark):
    d = days(10)
    rows = actions(spark, [action(1, 1, "STOCK_SPLIT", d[5], "2", "1", noon(d[0])), action(2, 1, "STOCK_SPLIT", d[5], "3", "1", noon(d[7]), 1)])
    ids = lambda when: [r.id for r in act.actions_as_of(rows, F.lit(when)).collect()]
    assert ids(noon(d[6])) == [1] and ids(noon(d[8])) == [2]


def test_membership_interval_is_inclusive(spark):
    m = spark.createDataFrame([("I", 1, date(2020, 1, 1), date(2020, 1, 31))], "index_id string, series bigint, valid_from date, valid_to date")
    assert [pit.members_as_of(m, x).count() for x in ("2019-12-31", "2020-01-01", "2020-01-31", "2020-02-01")] == [0, 1, 1, 0]


@pytest.mark.parametrize(("matched", "unknown", "need", "expected"), [
    (2, 0, 2, "MATCHED"), (1, 1, 2, scan.INSUFFICIENT), (1, 0, 2, "NOT_MATCHED"), (0, 2, 2, scan.INSUFFICIENT), (3, 0, 1, "MATCHED")])
def test_consensus(spark, matched, unknown, need, expected):
    states = [F.lit("MATCHED")] * matched + [F.lit(scan.INSUFFICIENT)] * unknown + [F.lit("NOT_MATCHED")] * (3 - matched - unknown)
    assert spark.range(1).select(scan.consensus(states, need)).first()[0] == expected


def test_parameters_are_validated():
    assert scan.rules_for("MOMENTUM_TREND")[0] == ("MOM_3M_63D", ">=", Decimal("0.10"))
    for bad in ({"nope": 1}, {"min_momentum_3m": "9"}, {"min_momentum_3m": True}, {"require_above_sma_50": "yes"}):
        with pytest.raises(ValueError):
            scan.rules_for("MOMENTUM_TREND", bad)
    for args in (("ABOVE_SMA_50", ">", True), ("RSI_14", "=", True), ("RSI_14", "between", "5", "1"), ("X", ">", 1)):
        with pytest.raises(ValueError):
            scan.predicate(*args)


@pytest.mark.parametrize(("vol", "threshold", "prior", "close", "s50", "s200", "mom", "expected"), [
    (0.5, 0.4, 200, 11, 10.5, 10, 0.1, "HIGH_VOLATILITY"), (0.3, 0.4, 200, 11, 10.5, 10, 0.1, "TRENDING_BULL"),
    (0.3, 0.4, 200, 9, 9.5, 10, -0.1, "TRENDING_BEAR"), (0.3, 0.4, 200, 11, 9.5, 10, 0.1, "SIDEWAYS"),
    (0.3, 0.4, 125, 11, 10.5, 10, 0.1, "INSUFFICIENT_HISTORY"), (None, 0.4, 200, 11, 10.5, 10, 0.1, "INSUFFICIENT_HISTORY")])
def test_regime_truth_table(spark, vol, threshold, prior, close, s50, s200, mom, expected):
    row = spark.createDataFrame([(vol, threshold, prior, float(close), s50, float(s200), mom)],
                                "VOLATILITY_20 double, threshold double, prior_valid int, level double, SMA_50 double, SMA_200 double, MOM_3M_63D double")
    assert regimes.classify(row).first().regime == expected


def test_unknown_dates_are_no_sessions(spark):
    cal = spark.createDataFrame([("X", date(2020, 1, 6), True), ("X", date(2020, 1, 7), False), ("X", date(2020, 1, 8), True)],
                                "exchange string, session date, is_trading_day boolean")
    asked = spark.createDataFrame([("X", date(2020, 1, x)) for x in (6, 7, 9)], "exchange string, day date")
    out = {r.day.day: r for r in pit.session_neighbours(asked, cal).collect()}
    assert (out[6].is_session, out[6].prev_session, out[6].next_session) == (True, None, date(2020, 1, 8))
    assert (out[7].is_session, out[7].prev_session) == (False, date(2020, 1, 6)) and out[9].is_session is False


def test_naive_times_are_read_on_the_market_clock(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 1, 10, 0),)], "available_at timestamp")
    assert pit.known_by(df, F.lit("2020-01-01 04:30:00").cast("timestamp"), naive=True).count() == 1
    assert pit.known_by(df, F.lit("2020-01-01 04:30:00").cast("timestamp")).count() == 0
