"""Keys stay keys: batches that repeat one, masters that repeat an identity, portfolios that share a setup, two exchanges."""

from datetime import date
from decimal import Decimal
from hashlib import sha256

import pytest

from tapewright.operators import merge
from tapewright.operators.pit import members_by_session
from tapewright.operators.portfolio import STEPS, mark_positions, with_share_steps
from tapewright.plans.scan import ranked_matches
from tapewright.session import checkpoint_folder

DAY = date(2025, 1, 2)
PRICE = "series bigint, session date, open bigint, high bigint, low bigint, close bigint, volume bigint, traded_value decimal(24,2), row_no bigint"
CAL = "exchange string, session date, is_trading_day boolean"


def test_a_key_is_inserted_once(spark):
    row = lambda s, c, n: (s, DAY, 1, 9, 1, c, 5, None, n)
    new = spark.createDataFrame([row(1, 4, 1), row(1, 4, 2), row(1, 5, 3), row(2, 4, 4)], PRICE)
    old = new.where("false").drop("row_no").selectExpr("*", "'OFFICIAL' AS origin")
    got = merge.merge_prices(new, old, spark.createDataFrame([], CAL)).orderBy("row_no").collect()
    assert [(r.action, r.code) for r in got] == [
        ("INSERT", None), ("UNCHANGED", None), ("CONFLICT", "HISTORICAL_DATA_CONFLICT"), ("INSERT", None)]
    # the conflict names the values of the row that came first, and its own
    text = lambda c: sha256(f"1|9|1|{c}|5".encode()).hexdigest()
    assert [(r.existing_hash, r.incoming_hash) for r in got] == [(None, None), (None, None), (text(4), text(5)), (None, None)]


def test_repeated_identities_give_one_row(spark):
    master = spark.createDataFrame(
        [("AAA", 1, "EQ", "IN1", "A"), ("AAA", 2, "EQ", "IN2", "A"), ("BBB", 3, "EQ", "IN3", "B"), ("BBB", 3, "EQ", "IN3", "B")],
        "symbol string, series bigint, board string, isin string, company_name string")
    rows = spark.createDataFrame([("AAA", None, "EQ"), ("BBB", "IN3", "EQ"), ("CCC", None, "EQ")], "symbol string, isin string, board string")
    got = {r.symbol: (r.key, r.identity_issue) for r in merge.resolve_identity(rows, master).collect()}
    assert got == {"AAA": (None, "AMBIGUOUS_SECURITY"), "BBB": (3, None), "CCC": (None, "SECURITY_NOT_IN_MASTER")}
    assert merge.resolve_identity(rows, master).count() == 3


def test_equal_actions_are_not_collapsed(spark):
    schema = "series bigint, type string, ex_date date, num decimal(18,8), den decimal(18,8), published_at timestamp"
    from datetime import datetime

    one = (1, "BONUS", DAY, Decimal(1), Decimal(1), datetime(2025, 1, 1))
    stored = spark.createDataFrame([], schema.replace("published_at", "available_at"))
    known = spark.createDataFrame([(1,)], "series bigint")
    got = merge.merge_actions(spark.createDataFrame([one, one], schema), stored, known).collect()
    assert sorted(r.action for r in got) == ["INSERT", "UNCHANGED"]


def test_portfolios_that_share_a_setup_are_marked_apart(spark):
    trades = spark.createDataFrame(
        [("A", 1, DAY, 10, Decimal(10), Decimal(100), DAY, None, []), ("B", 1, DAY, 1, Decimal(1), Decimal(100), DAY, None, [])],
        "portfolio_id string, series bigint, signal date, quantity0 bigint, quantity decimal(18,6), slipped_entry decimal(18,4), entry_session date, "
        "exit_session date, share_steps " + STEPS)
    bars = spark.createDataFrame([(1, DAY, 1_000_000)], "series bigint, session date, close bigint")
    cal = spark.createDataFrame([("X", date(2025, 1, d), True) for d in (2, 3)], CAL)
    got = {(r.portfolio_id, r.session.day): (float(r.value), r.stale) for r in mark_positions(trades, bars, cal, "2025-01-03").collect()}
    assert got == {("A", 2): (1000.0, False), ("A", 3): (1000.0, True), ("B", 2): (100.0, False), ("B", 3): (100.0, True)}


def test_share_changes_of_a_hold_add_up(spark):
    """Three changes: on the entry day (too early), twice inside on two days, one of them double, and one after the exit."""
    day = lambda d: date(2025, 1, d)
    trades = spark.createDataFrame(
        [("A", 1, day(1), 10, Decimal(10), Decimal(90), day(2), day(8), "x"), ("A", 2, day(1), 3, Decimal(3), Decimal(90), day(2), None, "y")],
        "portfolio_id string, series bigint, signal date, quantity0 bigint, quantity decimal(18,6), slipped_entry decimal(18,4), entry_session date, "
        "exit_session date, factors string")
    half, third = Decimal("0.5"), Decimal("0.333333333333333333")
    effects = spark.createDataFrame(
        [(1, day(2), [half]), (1, day(4), [half]), (1, day(6), [half, third]), (1, day(9), [half]), (2, day(3), []), (3, day(4), [half])],
        "series bigint, session date, factors array<decimal(19,18)>")
    held = with_share_steps(trades, effects)
    steps = {r.series: [(x.since.day, float(x.quantity)) for x in r.share_steps] for r in held.collect()}
    assert steps == {1: [(4, 20.0), (6, 120.0)], 2: []}
    bars = spark.createDataFrame([(1, day(d), 10_000 * d) for d in (3, 4, 6, 7)], "series bigint, session date, close bigint")
    cal = spark.createDataFrame([("X", day(d), True) for d in range(2, 11)], CAL)
    got = {r.session.day: (float(r.value), r.stale) for r in mark_positions(held, bars, cal, "2025-01-10").where("series = 1").collect()}
    assert got == {2: (900.0, True), 3: (30.0, False), 4: (80.0, False), 5: (80.0, True), 6: (720.0, False), 7: (840.0, False)}


def test_sessions_of_exchanges_are_kept_apart(spark):
    cal = spark.createDataFrame([("X", DAY, False), ("Y", DAY, True), ("X", date(2025, 1, 3), True)], CAL)
    members = spark.createDataFrame([("I", 1, DAY, None)], "index_id string, series bigint, valid_from date, valid_to date")
    days = lambda e: {r.session.day for r in members_by_session(members, cal, exchange=e).collect()}
    assert days("X") == {3} and days("Y") == {2}


def test_members_days_are_laid_out_after_their_intervals_are_merged(spark):
    """Overlapping, repeated, open and empty intervals; null keys are one member; no set of days is built above the generated rows."""
    day = lambda d: date(2025, 1, d)
    cal = spark.createDataFrame([("X", day(d), True) for d in range(1, 11)], "exchange string, session date, is_trading_day boolean")
    members = spark.createDataFrame(
        [("I", 1, day(1), day(3)), ("I", 1, day(2), day(5)), ("I", 1, day(2), day(5)), ("I", 1, day(2), day(2)), ("I", 1, day(8), None), ("I", 1, day(8), day(9)),
         ("I", 2, day(6), day(4)), ("I", 3, None, None), (None, None, day(4), day(4)), (None, None, day(4), day(5)), ("J", 1, day(10), None)],
        "index_id string, series bigint, valid_from date, valid_to date")
    grid = members_by_session(members, cal)
    got = sorted((str(r.index_id), r.series, r.session.day) for r in grid.collect())
    assert got == sorted([("I", 1, d) for d in (1, 2, 3, 4, 5, 8, 9, 10)] + [("None", None, 4), ("None", None, 5), ("J", 1, 10)])
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "Aggregate" not in plan[:plan.index("Generate explode")]


def test_all_matches_are_ranked(spark):
    scanned = spark.range(80).selectExpr("id AS series", "'MATCHED' AS status", "cast(id AS double) AS m")
    assert ranked_matches(scanned, "m").count() == 80 and ranked_matches(scanned, "m", 5).count() == 5


def test_the_checkpoint_folder_has_to_be_set():
    class Unset:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, other=None: None)

        class sparkContext:  # noqa: N801
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        checkpoint_folder(Unset)
