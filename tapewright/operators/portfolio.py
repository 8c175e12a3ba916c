"""Portfolio tables: cash ledger, marking, equity snapshots and risk metrics of equity curves.

A portfolio has one snapshot per session, so its curve may be windowed. Its fills may be many: running balances are
built in two levels, session totals first and then the events inside a session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.fixed_values import SESSIONS_PER_YEAR
from tapewright.functions.numbers import cents, half_up_div, money, r8, ticks_to_price, units8
from tapewright.operators.pit import session_list
from tapewright.operators.ranks import exact_percentiles
from tapewright.operators.trades import QTY

P = "portfolio_id"
STEPS = f"array<struct<since:date,quantity:{QTY}>>"


def running_in_two_levels(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], sums: dict[str, str],
) -> DataFrame:
    """Add a row number and running sums per key in (bucket, order); no window spans more than one bucket of a key
    or the bucket totals of one key."""
    totals = df.groupBy(*keys, bucket).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    over = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(
        *keys, bucket, F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_t_{o}").over(over), F.lit(0)).alias(f"_b_{o}") for o in sums])
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(start, [*keys, bucket])
    return joined.withColumns({
        "sequence": F.col("_n0") + F.row_number().over(inside),
        **{o: F.col(f"_b_{o}") + F.sum(c).over(upto) for o, c in sums.items()},
    }).drop("_n0", *[f"_b_{o}" for o in sums])


def fills(trades: DataFrame, capital: str, first_session) -> DataFrame:
    """Ledger events of executed trades, exits before entries on a day, after one deposit per portfolio."""
    deposit = trades.select(P).distinct().select(
        P, F.lit(first_session).cast("date").alias("session"), F.lit(0).alias("rank"), F.lit(-1).cast("bigint")
        .alias("series"), F.lit("INITIAL_CAPITAL").alias("event"), F.lit(capital).cast("decimal(24,2)").alias("net"))
    out_net = (money(F.col("exit_turnover")) - F.col("exit_cost.total_charges")).cast("decimal(24,2)")
    in_net = (-(F.col("deployed") + F.col("entry_cost.total_charges"))).cast("decimal(24,2)")
    sells = trades.where(F.col("exit_session").isNotNull()).select(
        P, F.col("exit_session").alias("session"), F.lit(1).alias("rank"), "series", F.lit("EXIT").alias("event"),
        out_net.alias("net"))
    buys = trades.select(
        P, F.col("entry_session").alias("session"), F.lit(2).alias("rank"), "series", F.lit("ENTRY").alias("event"),
        in_net.alias("net"))
    return deposit.unionByName(sells).unionByName(buys)


def cash_ledger(events: DataFrame) -> DataFrame:
    """Sequence and balance after every event; `sound` is false where cash goes below zero."""
    run = running_in_two_levels(events, [P], "session", ["rank", "series"], {"balance": "net"})
    return run.withColumn("sound", F.col("balance") >= 0)


def ledger_check(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(P).agg(
        F.count(F.lit(1)).alias("events"), F.sum("net").cast("decimal(24,2)").alias("net_total"),
        F.max_by("balance", "sequence").cast("decimal(24,2)").alias("final_balance"),
        F.min("balance").cast("decimal(24,2)").alias("lowest_balance"),
    ).withColumn("reconciles", F.col("net_total") == F.col("final_balance"))


def with_share_steps(trades: DataFrame, effects: DataFrame) -> DataFrame:
    """Add `share_steps`: from which session a hold has which share count, one step for each session with share changes.

    `effects` are rows of `hold_effects`; those of a series are few and travel as one array. A hold takes those after its
    entry day, up to its exit day, each on top of the ones before.
    """
    listed = effects.where(F.size("factors") > 0).groupBy("series").agg(
        F.sort_array(F.collect_list(F.struct("session", "factors"))).alias("_effects"))
    during = F.filter("_effects", lambda e: (e["session"] > F.col("entry_session")) & (
        F.col("exit_session").isNull() | (e["session"] <= F.col("exit_session"))))
    start = F.struct(F.lit(1).cast(QTY).alias("multiple"), F.array().cast(STEPS).alias("steps"))
    own = F.col("quantity0").cast("decimal(20,0)")

    def step(acc: Column, e: Column) -> Column:
        # the fold's value twice: as the state, and in the step that it makes
        multiple = F.aggregate(e["factors"], acc["multiple"], lambda q, f: (q / f).cast(QTY))
        made = F.struct(e["session"].alias("since"), (own * multiple).cast(QTY).alias("quantity"))
        return F.struct(multiple.alias("multiple"), F.concat(acc["steps"], F.array(made)).alias("steps"))

    return trades.join(listed, "series", "left").withColumn(
        "share_steps", F.coalesce(F.aggregate(during, start, step)["steps"], F.array().cast(STEPS))).drop("_effects")


def mark_positions(trades: DataFrame, bars: DataFrame, calendar: DataFrame, end, exchange: str | None = None) -> DataFrame:
    """Value of every open position at every close, entry day included and exit day not.

    A day without a close keeps the last value and counts as stale; a share change moves price and quantity by inverse
    factors, so carrying the value carries the scaled mark. The share count of a day is that of the last of the trade's
    `share_steps` by then.
    """
    days = session_list(calendar, None, end, exchange)
    last = F.coalesce(F.col("exit_session"), F.date_add(F.lit(end).cast("date"), 1))
    held = trades.withColumn("_days", days).select(
        P, "series", "signal", "quantity0", "slipped_entry", "share_steps",
        F.explode(F.filter("_days", lambda x: (x >= F.col("entry_session")) & (x < last))).alias("session"))
    by_then = F.filter("share_steps", lambda s: s["since"] <= F.col("session"))
    quantity = F.coalesce(F.try_element_at(by_then, F.lit(-1))["quantity"], F.col("quantity0").cast(QTY))
    tape = bars.where(F.col("close") > 0).select("series", "session", F.col("close").alias("_close"))
    rows = held.join(tape, ["series", "session"], "left")
    fresh = (ticks_to_price(F.col("_close")) * quantity).cast("decimal(32,6)")
    w = Window.partitionBy(P, "series", "signal").orderBy("session")  # one holding period of one portfolio
    carried = F.last(fresh, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    at_entry = (F.col("slipped_entry") * F.col("quantity0").cast("decimal(20,0)")).cast("decimal(32,6)")
    return rows.select(
        P, "series", "signal", "session", F.coalesce(carried, at_entry).alias("value"),
        F.col("_close").isNull().alias("stale"))


def mark_to_market(marks: DataFrame) -> DataFrame:
    return marks.groupBy(P, "session").agg(
        money(F.sum("value")).alias("gross"), F.count(F.lit(1)).alias("open_positions"),
        F.count_if("stale").alias("stale_marks"))


def equity_snapshots(
    marks: DataFrame, events: DataFrame, trades: DataFrame, calendar: DataFrame, capital: str, start, end,
    exchange: str | None = None,
) -> DataFrame:
    """One row per portfolio and session: cash, equity, return, drawdown, exposure, realised and unrealised."""
    grid = events.select(P).distinct().withColumn("_d", session_list(calendar, start, end, exchange)).select(
        P, F.explode("_d").alias("session"))
    flows = events.groupBy(P, "session").agg(F.sum("net").alias("net"))
    closed = trades.where(F.col("exit_session").isNotNull()).groupBy(P, F.col("exit_session").alias("session")).agg(
        F.sum("net_pnl").alias("pnl"), F.sum("exit_cost.total_charges").alias("c_out"))
    opened = trades.groupBy(P, F.col("entry_session").alias("session")).agg(
        F.sum("entry_cost.total_charges").alias("c_in"))
    on = [P, "session"]
    rows = grid
    for part in (mark_to_market(marks), flows, closed, opened):
        rows = rows.join(part, on, "left")
    w = Window.partitionBy(P).orderBy("session")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("decimal(24,2)")
    total = lambda c: F.sum(F.coalesce(c, zero)).over(upto).cast("decimal(24,2)")
    daily = (F.coalesce("c_in", zero) + F.coalesce("c_out", zero)).cast("decimal(24,2)")
    rows = rows.withColumns({
        "cash": total(F.col("net")), "gross": F.coalesce("gross", zero), "realized": total(F.col("pnl")),
        "daily_costs": daily, "cumulative_costs": F.sum(daily).over(upto).cast("decimal(24,2)"),
    }).withColumn("equity", (F.col("cash") + F.col("gross")).cast("decimal(24,2)"))
    rows = rows.withColumn(
        "unrealized", (F.col("equity") - F.lit(capital).cast("decimal(24,2)") - F.col("realized")).cast("decimal(24,2)"))
    return with_curve(rows).select(
        *on, "cash", "gross", "equity", "realized", "unrealized", "daily_costs", "cumulative_costs",
        F.coalesce("open_positions", F.lit(0)).alias("open_positions"),
        F.coalesce("stale_marks", F.lit(0)).alias("stale_marks"),
        r8(_over(F.col("gross"))).alias("exposure"), r8(_over(F.col("cash"))).alias("cash_share"),
        "daily_return", "drawdown")


def _over(part: Column) -> Column:
    return F.when(F.col("equity") > 0, part.cast("double") / F.col("equity").cast("double"))


def with_curve(rows: DataFrame) -> DataFrame:
    """Add daily_return and drawdown to (portfolio, session, equity)."""
    w = Window.partitionBy(P).orderBy("session")
    before = F.lag("equity").over(w).cast("double")
    peak = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    now = F.col("equity").cast("double")
    return rows.withColumns({
        "daily_return": r8(F.try_divide(now, before) - 1.0), "drawdown": r8(F.try_divide(now, peak) - 1.0)})


def drawdown_details(curve: DataFrame, keys: Sequence[str] = (P,)) -> DataFrame:
    """Deepest fall, its peak and trough, the first session back at the peak, and its length in sessions."""
    w = Window.partitionBy(*keys).orderBy("session")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.select(*keys, "session", "equity").withColumns({
        "i": F.row_number().over(w), "peak": F.max("equity").over(upto), "last_i": F.count("equity").over(
            Window.partitionBy(*keys))})
    rows = rows.withColumns({
        # the first session at the running peak
        "peak_i": F.max(F.when(F.col("equity") > F.coalesce(F.lag("peak").over(w), F.lit(-1)), F.col("i"))).over(upto),
        "fall": F.try_divide(F.col("equity").cast("double"), F.col("peak").cast("double")) - 1.0})
    worst = rows.groupBy(*keys).agg(F.min_by(F.struct("i", "session", "peak", "peak_i", "fall", "equity", "last_i"),
                                            F.struct("fall", "i")).alias("w"))
    joined = rows.select(*keys, "i", "session", "equity").join(worst, list(keys))
    back = (F.col("i") > F.col("w.i")) & (F.col("equity") >= F.col("w.peak")) & (F.col("w.fall") < 0)
    found = joined.groupBy(*keys).agg(
        F.any_value("w").alias("w"), F.min(F.when(back, F.col("i"))).alias("ri"),
        F.min(F.when(back, F.col("session"))).alias("recovery"),
        F.min(F.when(F.col("i") == F.col("w.peak_i"), F.col("session"))).alias("peak_date"),
        F.min("session").alias("first"))
    fell = F.col("w.fall") < 0
    return found.select(
        *keys, r8(F.col("w.fall")).alias("max_drawdown"),
        F.when(fell, F.col("w.peak") - F.col("w.equity")).otherwise(0).cast("decimal(24,2)").alias("max_drawdown_value"),
        F.when(fell, F.col("peak_date")).otherwise(F.col("first")).alias("peak_date"),
        F.when(fell, F.col("w.session")).otherwise(F.col("first")).alias("trough_date"),
        F.col("recovery").alias("recovery_date"),
        F.when(fell, F.coalesce(F.col("ri"), F.col("w.last_i")) - F.col("w.peak_i")).otherwise(0).cast("bigint")
        .alias("duration_sessions"))


def risk_metrics(curve: DataFrame, keys: Sequence[str] = (P,), risk_free: float = 0.0, start_value=None) -> DataFrame:
    """CAGR, volatility, Sharpe, Sortino, drawdown and Calmar per curve; null with a warning where undefined.

    `start_value` is the invested capital; a slice starts at its own first equity.
    """
    w = Window.partitionBy(*keys).orderBy("session")
    before = F.lag("equity").over(w)
    daily = F.when(before > 0, r8(F.col("equity").cast("double") / before.cast("double") - 1.0))
    rows = curve.select(*keys, "session", "equity").withColumn("r", daily)
    daily_rf = (1.0 + risk_free) ** (1.0 / SESSIONS_PER_YEAR) - 1.0
    excess = F.col("r") - F.lit(daily_rf)
    downside = F.least(excess, F.lit(0.0))
    year = F.sqrt(F.lit(float(SESSIONS_PER_YEAR)))
    stats = rows.groupBy(*keys).agg(
        F.min("session").alias("start_date"), F.max("session").alias("end_date"),
        F.min_by("equity", "session").alias("first_equity"), F.max_by("equity", "session").alias("ending_equity"),
        F.count("r").alias("n"), r8(F.stddev_samp("r")).alias("sd"), r8(F.stddev_samp(excess)).alias("esd"),
        F.avg(excess).alias("mean"), F.sqrt(F.avg(downside * downside)).alias("dd"))
    start = F.col("first_equity") if start_value is None else F.lit(start_value).cast("decimal(24,2)")
    growth = F.try_divide(F.col("ending_equity").cast("double"), start.cast("double"))
    days = F.datediff("end_date", "start_date")
    enough = F.col("n") >= 2
    stats = stats.withColumn("starting_equity", start).withColumns({
        "total_return": r8(growth - 1.0),
        "cagr": F.when((start > 0) & (F.col("ending_equity") > 0) & (days > 0),
                       r8(F.pow(growth, F.lit(365.2425) / days) - 1.0)),
        "annualized_volatility": F.when(enough, r8(F.col("sd") * year)),
        "sharpe": F.when(enough & (F.col("esd") != 0), r8(F.try_divide(F.col("mean"), F.col("esd")) * year)),
        "sortino": F.when(enough & (F.col("dd") != 0), r8(F.try_divide(F.col("mean") * year, F.col("dd")))),
    })
    out = stats.join(drawdown_details(curve, keys), list(keys))
    deep = F.col("max_drawdown")
    out = out.withColumn("calmar", F.when(deep != 0, r8(F.try_divide(F.col("cagr"), F.abs(deep)))))
    warnings = F.array_join(F.array_sort(F.array_compact(F.array(
        F.when(~enough, "INSUFFICIENT_DAILY_RETURNS_FOR_RISK_METRICS"),
        F.when(enough & (F.col("esd") == 0), "SHARPE_UNDEFINED_ZERO_VARIANCE"),
        F.when(enough & (F.col("dd") == 0), "SORTINO_UNDEFINED_ZERO_DOWNSIDE"),
        F.when(F.col("cagr").isNull(), "CAGR_UNDEFINED_INSUFFICIENT_ELAPSED_TIME"),
        F.when(F.col("calmar").isNull(), "CALMAR_UNDEFINED_ZERO_DRAWDOWN_OR_CAGR"),
    ))), ",")
    return out.withColumn("warnings", warnings).drop("n", "sd", "esd", "mean", "dd", "first_equity")


def segment_metrics(curve: DataFrame, boundary, risk_free: float = 0.0) -> DataFrame:
    side = F.when(F.col("session") < F.lit(boundary).cast("date"), "IN_SAMPLE").otherwise("OUT_OF_SAMPLE")
    return risk_metrics(curve.withColumn("label", side), (P, "label"), risk_free)


def portfolio_metrics(snapshots: DataFrame, trades: DataFrame) -> DataFrame:
    """Exposure, cash, turnover, costs and outcome counts per portfolio."""
    curve = snapshots.groupBy(P).agg(
        r8(F.avg("exposure")).alias("average_exposure"), F.max("exposure").alias("maximum_exposure"),
        r8(F.avg("cash_share")).alias("average_cash_share"), F.min("cash").alias("minimum_cash"),
        r8(F.avg("open_positions")).alias("average_open_positions"),
        F.max("open_positions").alias("maximum_open_positions"), F.avg(F.col("equity").cast("double")).alias("_mean"))
    closed = F.col("net_pnl").isNotNull()
    traded = cents(money(F.col("entry_turnover"))) + F.coalesce(cents(money(F.col("exit_turnover"))), F.lit(0))
    cost = cents(F.col("entry_cost.total_charges")) + F.coalesce(cents(F.col("exit_cost.total_charges")), F.lit(0))
    n = F.count_if(closed)
    book = trades.groupBy(P).agg(
        F.sum(traded).alias("_turnover"), F.sum(cost).alias("_cost"), F.count(F.lit(1)).alias("entry_count"),
        n.alias("exit_count"), F.count_if(closed & (F.col("net_pnl") > 0)).alias("profitable"),
        F.count_if(closed & (F.col("net_pnl") < 0)).alias("losing"),
        F.count_if(closed & (F.col("net_pnl") == 0)).alias("breakeven"),
        (half_up_div(F.sum(units8(F.when(closed, F.col("net_return")))), n).cast("double") / 1e8)
        .alias("average_return"))
    middle = exact_percentiles(trades.where(closed), [P], units8(F.col("net_return")), [50])
    out = curve.join(book, P).join(middle, P, "left")
    return out.select(
        P, "average_exposure", "maximum_exposure", "average_cash_share", "minimum_cash", "average_open_positions",
        "maximum_open_positions", (F.col("_turnover").cast("double") / 100).alias("total_turnover"),
        r8(F.try_divide(F.col("_turnover").cast("double") / 100, F.col("_mean"))).alias("portfolio_turnover"),
        (F.col("_cost").cast("double") / 100).alias("total_costs"),
        r8(F.try_divide(F.col("_cost").cast("double"), F.col("_turnover").cast("double"))).alias("cost_drag"),
        "entry_count", "exit_count", "profitable", "losing", "breakeven",
        r8(F.try_divide(F.col("profitable"), F.col("exit_count"))).alias("win_rate"), "average_return",
        (F.col("p50").cast("double") / 1e8).alias("median_return"))


def rejection_counts(decisions: DataFrame, reason: str = "decision", accepted: str = "TRADE") -> DataFrame:
    return decisions.where(F.col(reason) != accepted).groupBy(P, F.col(reason).alias("reason")).agg(
        F.count(F.lit(1)).alias("candidates"))
