"""Forward labelling of setups: entry at the next open, stop/target/time exit, costs, one open trade per series.

Bars, effects of actions and setups of a series share one shuffle. A range frame over session numbers (at most holding + delay + 1
of them) gives each setup its own short path, and a fold in the JVM walks it to the first exit. Only the rule that a series
holds one trade at a time is sequential.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.costs import COMPONENTS, leg_costs
from tapewright.functions.fixed_values import MAX_EXIT_DELAY, SLIPPAGE_BPS, TRADE_NOTIONAL
from tapewright.functions.numbers import dec8, money, num, ticks_to_price
from tapewright.operators.actions import SHARE_CHANGES, factor
from tapewright.operators.pit import session_index, with_session_times

PRICE, QTY, TURNOVER = "decimal(18,4)", "decimal(28,6)", "decimal(28,6)"


@dataclass(frozen=True)
class TradeSettings:
    holding: int = 20
    slippage_bps: str = SLIPPAGE_BPS
    notional: str = TRADE_NOTIONAL
    stop_loss: str | None = None
    profit_target: str | None = None
    max_exit_delay: int = MAX_EXIT_DELAY
    start: str | None = None
    end: str | None = None
    exchange: str = "X"
    cost_overrides: Mapping[str, object] = field(default_factory=dict)


def slipped(price: Column, bps: str, side: str) -> Column:
    """Adverse slippage, half-up to four digits."""
    sign = 1 if side == "BUY" else -1
    multiplier = 1 + sign * Decimal(bps) / Decimal(10000)
    return F.round(price.cast(PRICE) * num(multiplier), 4).cast(PRICE)


def position_size(entry: Column, notional: str) -> Column:
    return F.floor(F.lit(notional).cast("decimal(18,2)") / entry).cast("bigint")


def hold_effects(actions: DataFrame, calendar: DataFrame, exchange: str = "X") -> DataFrame:
    """(series, session, factors, notes): actions taking effect on their ex date as known at that day's open."""
    stored = actions.withColumnRenamed("available_at", "known_at").withColumn("session", F.col("ex_date"))
    links = stored.where(F.col("supersedes_id").isNotNull()).groupBy(F.col("supersedes_id").alias("id")).agg(
        F.min("known_at").alias("_replaced_at"))
    live = with_session_times(stored, calendar, exchange).join(links, "id", "left").where(
        (F.col("known_at") <= F.col("opens_at"))
        & (F.col("_replaced_at").isNull() | (F.col("_replaced_at") > F.col("opens_at"))))
    positive = (F.col("num") > 0) & (F.col("den") > 0)
    supported = F.col("type").isin(*SHARE_CHANGES)
    note = F.when(~supported, F.concat(F.lit("UNSUPPORTED_CORPORATE_ACTION:"), "type")).when(
        ~F.coalesce(positive, F.lit(False)), F.concat(F.lit("INVALID_CORPORATE_ACTION_RATIO:"), "type"))
    value = F.when(note.isNull(), factor(F.col("type"), F.col("num"), F.col("den")))
    rows = live.select("series", "session", F.struct("known_at", "id", value.alias("f"), note.alias("note")).alias("e"))
    listed = F.array_sort(F.collect_list("e"))
    return rows.groupBy("series", "session").agg(
        F.filter(F.transform(listed, lambda e: e["f"]), lambda f: f.isNotNull()).alias("factors"),
        F.filter(F.transform(listed, lambda e: e["note"]), lambda x: x.isNotNull()).alias("notes"),
    )


#: One entry of a setup's path: a bar, or actions that take effect (before the bar of the same session).
STEP = ("p int, is_bar boolean, day date, open decimal(18,4), high decimal(18,4), low decimal(18,4), close decimal(18,4), "
        "factors array<decimal(19,18)>, notes array<string>")


def _timeline(placed: DataFrame, bars: DataFrame, days: DataFrame, effects: DataFrame | None) -> DataFrame:
    """Setups, bars and effects of every series by session number; only setups have a signal."""
    step = [f.split(" ") for f in STEP.split(", ")]

    def steps(**given) -> Column:
        return F.struct(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in step]).alias("step")

    price = {c: ticks_to_price(F.col(c)) for c in ("open", "high", "low", "close")}
    none = F.array().cast("array<string>")
    tape = bars.select("series", "session", *price).join(days, "session").select(
        "series", "p", steps(p=F.col("p"), is_bar=F.lit(True), day=F.col("session"), factors=none, notes=none, **price))
    rows = tape if effects is None else tape.unionByName(effects.join(days, "session").select(
        "series", "p", steps(p=F.col("p"), is_bar=F.lit(False), factors=F.col("factors"), notes=F.col("notes"))))
    return placed.unionByName(rows, allowMissingColumns=True)


def price_setups(
    setups: DataFrame, bars: DataFrame, calendar: DataFrame, actions: DataFrame | None, settings: TradeSettings,
) -> DataFrame:
    """One row per distinct (series, session) setup, with the trade it would make or the reason it makes none.

    A range frame over session numbers gathers what follows a setup, from the next session to the last that an exit may take;
    the path is folded in order to its first exit.
    """
    st = settings
    one = Window.partitionBy("exchange").orderBy("session")  # a calendar: one row per session
    cal = (
        session_index(calendar, st.start, st.end).where(F.col("exchange") == st.exchange)
        .withColumns({"last_idx": F.max("idx").over(Window.partitionBy("exchange")), "next": F.lead("session").over(one)})
        .select("session", "idx", "last_idx", "next")
    )
    days = cal.select("session", F.col("idx").alias("p"))
    placed = setups.select("series", F.col("session").alias("signal")).distinct().join(
        cal.withColumnRenamed("session", "signal"), "signal", "left").withColumnRenamed("idx", "p")
    effects = None if actions is None else hold_effects(actions, calendar, st.exchange)
    after = Window.partitionBy("series").orderBy("p").rangeBetween(1, 1 + st.holding + st.max_exit_delay)
    inside = F.col("p") + 1 <= F.col("last_idx")
    rows = (
        _timeline(placed, bars, days, effects).withColumn("_path", F.collect_list("step").over(after))
        .where(F.col("signal").isNotNull())
        .select("series", "signal", "last_idx", F.when(inside, F.col("p") + 1).alias("entry"), F.when(inside, F.col("next")).alias("entry_session"),
                F.sort_array("_path").alias("_path"))
    )
    first = F.filter("_path", lambda e: e["is_bar"] & (e["p"] == F.col("entry")))
    later = F.filter("_path", lambda e: e["is_bar"] | (e["p"] > F.col("entry")))
    closed = F.array_max(F.transform(F.filter("_path", lambda e: e["close"] > 0), lambda e: e["p"]))
    rows = rows.withColumns({
        "raw_entry": F.get(first, F.lit(0))["open"], "_path": later, "scheduled": F.col("entry") + st.holding,
        "forced": F.col("entry") + st.holding > F.col("last_idx"), "_last_close": closed,
    }).withColumns({
        "slipped_entry": slipped(F.col("raw_entry"), st.slippage_bps, "BUY"),
        "path_last": F.when(F.col("forced"), F.coalesce("_last_close", "entry")).otherwise(F.col("scheduled") - 1),
    })
    priced = rows.withColumn("_end", _walked(st)).withColumns({
        "x": F.col("_end.x"), "_low_seen": F.col("_end.low"), "_high_seen": F.col("_end.high"), "_all_notes": F.col("_end.notes")})
    return _settle(priced.drop("_path", "_end"), st)


EXIT = "struct<p:int,day:date,multiple:decimal(28,6),notes:array<string>,unclear:boolean,reason:string,base:decimal(18,4)>"


def _walked(st: TradeSettings) -> Column:
    """Fold of a path: levels and share multiple after all effects, extremes while held, and the first exit (x)."""
    def level(share: str | None, sign: int) -> Column:
        if share is None:
            return F.lit(None).cast(PRICE)
        return F.round(F.col("slipped_entry") * num(1 + sign * Decimal(share)), 4).cast(PRICE)

    state = ("stop", "target", "multiple", "notes", "low", "high", "x")
    start = F.struct(
        level(st.stop_loss, -1).alias("stop"), level(st.profit_target, 1).alias("target"), F.lit(1).cast(QTY).alias("multiple"),
        F.array().cast("array<string>").alias("notes"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        F.lit(None).cast(EXIT).alias("x"))

    def moved(acc: Column, **given: Column) -> Column:
        return F.struct(*[given.get(name, acc[name]).alias(name) for name in state])

    def effect(acc: Column, e: Column) -> Column:
        def scaled(lv: Column, f: Column) -> Column:
            return F.round(lv * f, 4).cast(PRICE)

        return moved(
            acc, stop=F.aggregate(e["factors"], acc["stop"], scaled), target=F.aggregate(e["factors"], acc["target"], scaled),
            multiple=F.aggregate(e["factors"], acc["multiple"], lambda q, f: (q / f).cast(QTY)), notes=F.concat(acc["notes"], e["notes"]))

    def bar(acc: Column, e: Column) -> Column:
        stop, target = acc["stop"], acc["target"]
        held = (e["p"] <= F.col("path_last")) & e["open"].isNotNull()
        by_open_stop, by_open_target = e["open"] <= stop, e["open"] >= target
        by_low, by_high = e["low"] <= stop, e["high"] >= target
        reason = (
            F.when(by_open_stop, "STOP_LOSS").when(by_open_target, "PROFIT_TARGET").when(by_low, "STOP_LOSS")
            .when(by_high, "PROFIT_TARGET"))
        base = F.when(by_open_stop | by_open_target, e["open"]).when(by_low, stop).when(by_high, target)
        unclear = F.coalesce(~F.coalesce(by_open_stop, F.lit(False)) & ~F.coalesce(by_open_target, F.lit(False)) & by_low & by_high, F.lit(False))

        def leave(why, price, doubt=None) -> Column:
            return F.struct(
                e["p"].alias("p"), e["day"].alias("day"), acc["multiple"].alias("multiple"), acc["notes"].alias("notes"),
                (F.lit(False) if doubt is None else doubt).alias("unclear"), why.alias("reason"), price.alias("base")).cast(EXIT)

        at_end = F.col("forced") & (e["p"] == F.col("path_last")) & (e["close"] > 0)
        searched = ~F.col("forced") & (e["p"] >= F.col("scheduled")) & (e["open"] > 0)
        x = (F.when(held & reason.isNotNull(), leave(reason, base, unclear)).when(at_end, leave(F.lit("FORCED_END_OF_TEST"), e["close"]))
             .when(searched, leave(F.lit("TIME_EXIT"), e["open"])))
        quiet, shares = held & reason.isNull(), acc["multiple"].cast("double")
        return moved(
            acc, x=x, low=F.when(quiet, F.least(acc["low"], e["low"].cast("double") * shares)).otherwise(acc["low"]),
            high=F.when(quiet, F.greatest(acc["high"], e["high"].cast("double") * shares)).otherwise(acc["high"]))

    return F.aggregate("_path", start, lambda acc, e: F.when(~e["is_bar"], effect(acc, e)).when(acc["x"].isNotNull(), acc).otherwise(bar(acc, e)))


def _settle(priced: DataFrame, st: TradeSettings) -> DataFrame:
    """Quantities, excursions, costs and profit of every priced setup."""
    entry = F.col("slipped_entry")
    skip = (
        F.when(F.col("entry").isNull(), "ENTRY_OUTSIDE_TEST_RANGE")
        .when(F.col("raw_entry").isNull() | (F.col("raw_entry") <= 0), "ENTRY_PRICE_UNAVAILABLE")
        .when(F.col("quantity0") < 1, "INSUFFICIENT_NOTIONAL_FOR_ONE_SHARE")
    )
    ok = F.when(F.col("raw_entry") > 0, entry)
    out = priced.withColumn("quantity0", position_size(ok, st.notional)).withColumn("skip_reason", skip)
    taken = F.col("skip_reason").isNull()
    x = F.col("x")
    exit_value = x["base"].cast("double") * x["multiple"].cast("double")
    closing = F.when(x["reason"].isin("STOP_LOSS", "PROFIT_TARGET", "TIME_EXIT"), exit_value)
    lowest = F.least(entry.cast("double"), F.col("_low_seen"), closing)
    highest = F.greatest(entry.cast("double"), F.col("_high_seen"), closing)
    held = (
        F.when(x.isNull(), F.col("path_last") - F.col("entry") + 1)
        .when(x["reason"] == "TIME_EXIT", x["p"] - F.col("entry")).otherwise(x["p"] - F.col("entry") + 1)
    )
    quantity = (F.col("quantity0").cast("decimal(20,0)") * x["multiple"].cast(QTY)).cast(QTY)
    out = out.withColumns({
        "exit_session": x["day"],
        "exit_reason": F.when(taken, F.coalesce(x["reason"], F.lit("EXIT_PRICE_UNAVAILABLE"))),
        "raw_exit": x["base"],
        "slipped_exit": slipped(x["base"], st.slippage_bps, "SELL"),
        "quantity": F.coalesce(quantity, F.col("quantity0").cast(QTY)),
        "holding_sessions": F.when(taken, held),
        "mae": F.when(taken, dec8(lowest / entry.cast("double") - 1.0)),
        "mfe": F.when(taken, dec8(highest / entry.cast("double") - 1.0)),
        "warnings": F.array_sort(F.array_distinct(F.concat(
            F.coalesce(x["notes"], F.col("_all_notes"), F.array().cast("array<string>")),
            F.when(F.coalesce(x["unclear"], F.lit(False)), F.array(F.lit("AMBIGUOUS_INTRADAY_PATH_STOP_FIRST")))
            .otherwise(F.array().cast("array<string>")),
            F.when(taken & x.isNull(), F.array(F.lit("EXIT_PRICE_UNAVAILABLE_AFTER_BOUNDED_SEARCH")))
            .otherwise(F.array().cast("array<string>")),
        ))),
    })
    in_turnover = F.when(taken, (entry * F.col("quantity0").cast("decimal(20,0)")).cast(TURNOVER))
    out_turnover = F.when(taken, (F.col("slipped_exit") * F.col("quantity")).cast(TURNOVER))
    out = out.withColumns({"entry_turnover": in_turnover, "exit_turnover": out_turnover}).withColumns({
        "entry_cost": F.when(taken, leg_costs(F.col("entry_turnover"), "BUY", st.cost_overrides)),
        "exit_cost": F.when(F.col("exit_turnover").isNotNull(),
                            leg_costs(F.col("exit_turnover"), "SELL", st.cost_overrides)),
    })
    return pnl(out).select(
        "series", "signal", "skip_reason", "entry", "entry_session", "raw_entry", "slipped_entry", "quantity0",
        "quantity", "exit_session", "exit_reason", "raw_exit", "slipped_exit", "holding_sessions", "mae", "mfe",
        "warnings", "entry_turnover", "exit_turnover", "entry_cost", "exit_cost", "deployed", "gross_pnl",
        "total_costs", "net_pnl", "gross_return", "net_return",
    )


def pnl(trades: DataFrame) -> DataFrame:
    """Gross and net profit from turnovers and costs; returns are on the entry turnover."""
    gross = money(F.col("exit_turnover") - F.col("entry_turnover"))
    costs = money(F.col("entry_cost.total_charges") + F.col("exit_cost.total_charges"))
    base = F.col("entry_turnover").cast("double")
    return trades.withColumns({"deployed": money(F.col("entry_turnover")), "gross_pnl": gross, "total_costs": costs}
                              ).withColumn("net_pnl", money(F.col("gross_pnl") - F.col("total_costs"))).withColumns({
        "gross_return": dec8(F.try_divide(F.col("gross_pnl").cast("double"), base)),
        "net_return": dec8(F.try_divide(F.col("net_pnl").cast("double"), base)),
    })


def no_overlap(priced: DataFrame) -> DataFrame:
    """Add `decision`: TRADE, or why the setup is skipped; an unclosed trade blocks its series for good.

    A series' setups, one a session at most, are gathered on the partitioning they come in and folded in order of their signals.
    """
    rest = [c for c in priced.columns if c not in ("series", "signal", "skip_reason", "exit_session")]
    setup = F.struct("signal", "skip_reason", "exit_session", F.struct(*rest).alias("rest"))
    start = F.struct(
        F.lit(None).cast("date").alias("until"), F.lit(False).alias("for_good"), F.array().cast("array<string>").alias("decisions"))

    def step(acc: Column, s: Column) -> Column:
        blocked = acc["for_good"] | F.coalesce(s["signal"] < acc["until"], F.lit(False))
        trade = ~blocked & s["skip_reason"].isNull()
        decision = F.when(blocked, "ALREADY_OPEN_POSITION").otherwise(F.coalesce(s["skip_reason"], F.lit("TRADE")))
        return F.struct(
            F.when(trade, s["exit_session"]).otherwise(acc["until"]).alias("until"),
            (acc["for_good"] | (trade & s["exit_session"].isNull())).alias("for_good"),
            F.concat(acc["decisions"], F.array(decision)).alias("decisions"))

    decided = priced.groupBy("series").agg(F.sort_array(F.collect_list(setup)).alias("setups")).withColumn(
        "decisions", F.aggregate("setups", start, step)["decisions"])
    rows = decided.select("series", F.explode(F.arrays_zip("setups", "decisions")).alias("z"))
    made = {"series": F.col("series"), **{c: F.col(f"z.setups.{c}") for c in ("signal", "skip_reason", "exit_session")},
            **{c: F.col(f"z.setups.rest.{c}") for c in rest}}
    return rows.select(*[made[c].alias(c) for c in priced.columns], F.col("z.decisions").alias("decision"))


def label_trades(setups, bars, calendar, actions, settings: TradeSettings) -> DataFrame:
    return no_overlap(price_setups(setups, bars, calendar, actions, settings))


def executed(decided: DataFrame) -> DataFrame:
    return decided.where(F.col("decision") == "TRADE")


def skip_reasons(decided: DataFrame) -> DataFrame:
    return decided.where(F.col("decision") != "TRADE").groupBy(F.col("decision").alias("reason")).agg(
        F.count(F.lit(1)).alias("setups"))


def cost_totals(trades: DataFrame) -> DataFrame:
    """Each cost component summed over all entry and exit legs."""
    legs = trades.select("entry_cost").unionByName(
        trades.where(F.col("exit_cost").isNotNull()).select(F.col("exit_cost").alias("entry_cost")))
    return legs.agg(*[
        F.coalesce(F.sum(f"entry_cost.{c}"), F.lit(0)).cast("decimal(24,2)").alias(c)
        for c in (*COMPONENTS, "total_charges")
    ])
