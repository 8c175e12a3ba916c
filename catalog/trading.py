"""Trade labelling (T1-T11) and leg costs (C1, C2)."""

from __future__ import annotations

from catalog.features import feature_parts
from catalog.lookups import d
from catalog.sql import part, sql
from pyspark.sql import functions as F

from tapewright.functions.costs import COMPONENTS, leg_costs
from tapewright.functions.numbers import ticks_to_price
from tapewright.operators import scan, trades
from tapewright.operators.features import feature_frame
from tapewright.sources import adapters as src

QUERIES, ORACLES = {}, {}
RULES = [("ABOVE_SMA_50", "=", True), ("SMA_20_ABOVE_50", "=", True), ("VOLUME_RATIO_20", ">=", "1.0")]
HOLD, DELAY, STOP, TARGET = 4, 2, "0.60", "0.80"
SETTINGS = trades.TradeSettings(
    holding=HOLD, max_exit_delay=DELAY, stop_loss=STOP, profit_target=TARGET, notional="5000", start="1996-01-01",
    end="2001-06-25")


def setups(s, p):
    frame = feature_frame(src.bars(s, p), scan.required_codes(RULES))
    # besides the rule, every bar shortly before a split or bonus, so that trades held across one occur
    near = F.col("session").between("1998-05-11", "1998-06-01") | F.col("session").between("1997-03-24", "1997-04-07")
    return frame.where((scan.rule_status(RULES) == "MATCHED") | near).select("series", "session")


def priced(s, p):
    return trades.price_setups(setups(s, p), src.bars(s, p), src.calendar(s, p), src.actions(s, p), SETTINGS)


def decided(s, p):
    """Kept for the several passes that statistics make over it; lost blocks are rebuilt from lineage."""
    return trades.no_overlap(priced(s, p)).persist()


def taken(s, p):
    return trades.executed(decided(s, p))


feature_parts("bars")
part("setups", ("averaged_bars",), """
  SELECT series, session AS signal FROM averaged_bars
  WHERE (close > "SMA_50" AND "SMA_20" > "SMA_50" AND volume / nullif("AVG_VOLUME_20", 0) >= 1e0)
     OR session BETWEEN DATE '1998-05-11' AND DATE '1998-06-01'
     OR session BETWEEN DATE '1997-03-24' AND DATE '1997-04-07'""")
part("cal", ("calendar",), """
  SELECT session, row_number() OVER (ORDER BY session) - 1 AS idx, count(*) OVER () - 1 AS last_idx FROM calendar
  WHERE session BETWEEN DATE '1996-01-01' AND DATE '2001-06-25'""")


def price(c):
    return f"CAST(CAST({c} AS DECIMAL(14,0)) * 0.0001 AS DECIMAL(18,4))"


part("tape", ("bars", "cal"), f"""
  SELECT series, session, idx, {price('open')} AS o, {price('high')} AS h, {price('low')} AS l, {price('close')} AS c
  FROM bars JOIN cal USING (session)""")
part("effects", ("actions", "cal", "calendar"), """
  SELECT a.series, c.idx, a.type, CASE type WHEN 'STOCK_SPLIT' THEN CAST(den AS DOUBLE) / CAST(num AS DOUBLE)
         WHEN 'BONUS' THEN CAST(den AS DOUBLE) / CAST(den + num AS DOUBLE) END AS f
  FROM actions a JOIN cal c ON c.session = a.ex_date
  WHERE a.available_at <= a.ex_date + to_seconds(33300) - INTERVAL 330 MINUTE AND NOT EXISTS (
    SELECT 1 FROM actions b WHERE b.supersedes_id = a.id
    AND b.available_at <= a.ex_date + to_seconds(33300) - INTERVAL 330 MINUTE)""")
part("entries", ("setups", "cal", "tape"), f"""
  SELECT s.series, s.signal, c.idx + 1 AS entry, c.last_idx, c.idx + 1 + {HOLD} AS scheduled,
         c.idx + 1 + {HOLD} > c.last_idx AS forced, ce.session AS entry_session, t.o AS raw_entry,
         CAST(round(t.o * 1.0005, 4) AS DECIMAL(18,4)) AS slipped_entry
  FROM setups s LEFT JOIN cal c ON c.session = s.signal AND c.idx + 1 <= c.last_idx
       LEFT JOIN cal ce ON ce.idx = c.idx + 1
       LEFT JOIN tape t ON t.series = s.series AND t.idx = c.idx + 1""")
part("lasts", ("entries", "tape"), """
  SELECT e.series, e.signal, max(t.idx) AS last_close FROM entries e JOIN tape t ON t.series = e.series
   AND t.idx BETWEEN e.entry AND e.last_idx AND t.c > 0 WHERE e.forced GROUP BY ALL""")
part("walk0", ("entries", "lasts", "tape", "effects", "cal"), f"""
  SELECT e.*, CASE WHEN forced THEN coalesce(last_close, entry) ELSE scheduled - 1 END AS path_last, k.idx AS p,
         k.session AS day, t.o, t.h, t.l, t.c,
         CAST(coalesce((SELECT product(f) FROM effects x WHERE x.series = e.series AND x.idx > e.entry
               AND x.idx <= k.idx), 1e0) AS DECIMAL(19,18)) AS f
  FROM entries e LEFT JOIN lasts USING (series, signal)
       JOIN cal k ON k.idx BETWEEN e.entry AND least(e.scheduled + {DELAY}, e.last_idx)
       LEFT JOIN tape t ON t.series = e.series AND t.idx = k.idx""")
part("walk", ("walk0",), f"""
  SELECT *, CAST(1e0 / CAST(f AS DOUBLE) AS DECIMAL(18,6)) AS q,
         CAST(round(CAST(round(slipped_entry * (1 - {STOP}), 4) AS DECIMAL(18,4)) * f, 4) AS DECIMAL(18,4)) AS stop,
         CAST(round(CAST(round(slipped_entry * (1 + {TARGET}), 4) AS DECIMAL(18,4)) * f, 4) AS DECIMAL(18,4)) AS target
  FROM walk0""")
part("touches", ("walk",), """
  SELECT series, signal, min(p) AS touch_p FROM walk WHERE p <= path_last AND o IS NOT NULL
    AND (o <= stop OR o >= target OR l <= stop OR h >= target) GROUP BY ALL""")
part("exits", ("walk", "touches"), """
  SELECT series, signal, p AS x, day AS exit_session, q AS multiple,
         CASE WHEN o <= stop OR (o < target AND l <= stop) THEN 'STOP_LOSS' ELSE 'PROFIT_TARGET' END AS exit_reason,
         CASE WHEN o <= stop OR o >= target THEN o WHEN l <= stop THEN stop ELSE target END AS base,
         o > stop AND o < target AND l <= stop AND h >= target AS unclear
  FROM walk JOIN touches USING (series, signal) WHERE p = touch_p
  UNION ALL
  SELECT series, signal, p, day, q, 'FORCED_END_OF_TEST', c, false FROM walk w WHERE forced AND p = path_last AND c > 0
    AND NOT EXISTS (SELECT 1 FROM touches t WHERE t.series = w.series AND t.signal = w.signal)
  UNION ALL
  SELECT series, signal, p, day, q, 'TIME_EXIT', o, false FROM (
    SELECT *, min(p) OVER (PARTITION BY series, signal) AS lo FROM walk w WHERE NOT forced AND p >= scheduled AND o > 0
      AND NOT EXISTS (SELECT 1 FROM touches t WHERE t.series = w.series AND t.signal = w.signal)) WHERE p = lo""")
part("seen", ("walk", "touches"), """
  SELECT series, signal, min(CAST(l AS DOUBLE) * CAST(q AS DOUBLE)) AS lo, max(CAST(h AS DOUBLE) * CAST(q AS DOUBLE)) AS hi
  FROM walk LEFT JOIN touches USING (series, signal) WHERE p <= path_last AND (touch_p IS NULL OR p < touch_p)
  GROUP BY ALL""")
part("trade1", ("entries", "exits", "seen", "lasts"), """
  SELECT e.series, e.signal, e.entry, e.entry_session, e.raw_entry, e.slipped_entry, x, exit_session, multiple,
         base AS raw_exit, lo, hi, unclear,
         CASE WHEN e.entry IS NULL THEN 'ENTRY_OUTSIDE_TEST_RANGE'
              WHEN e.raw_entry IS NULL OR e.raw_entry <= 0 THEN 'ENTRY_PRICE_UNAVAILABLE'
              WHEN floor(5000e0 / CAST(slipped_entry AS DOUBLE)) < 1 THEN 'INSUFFICIENT_NOTIONAL_FOR_ONE_SHARE' END AS skip_reason,
         CAST(floor(5000e0 / CAST(slipped_entry AS DOUBLE)) AS BIGINT) AS quantity0,
         coalesce(exit_reason, 'EXIT_PRICE_UNAVAILABLE') AS exit_reason,
         CAST(round(base * 0.9995, 4) AS DECIMAL(18,4)) AS slipped_exit,
         CASE WHEN exit_reason = 'TIME_EXIT' THEN x - e.entry WHEN x IS NOT NULL THEN x - e.entry + 1
              WHEN forced THEN coalesce(last_close, e.entry) - e.entry + 1 ELSE scheduled - e.entry END AS held
  FROM entries e LEFT JOIN exits USING (series, signal) LEFT JOIN seen USING (series, signal)
       LEFT JOIN lasts USING (series, signal)""")


def dec8_sql(x):
    return f"CAST(CAST(floor(({x}) * 1e8 + 0.5e0) AS BIGINT) AS DOUBLE) / 1e8"


def leg_sql(turnover, side):
    """Component -> SQL text over a DECIMAL(22,6) turnover."""
    out = {
        "brokerage": "CAST(0 AS DECIMAL(24,2))",
        "stt": f"CAST(round({turnover} * 0.00100000, 0) AS DECIMAL(24,2))",
        "exchange_charge": f"CAST(round({turnover} * 0.00003070, 2) AS DECIMAL(24,2))",
        "sebi_charge": f"CAST(round({turnover} * 0.00000100, 2) AS DECIMAL(24,2))",
    }
    out["gst"] = f"CAST(round(({out['exchange_charge']} + {out['sebi_charge']}) * 0.18000000, 2) AS DECIMAL(24,2))"
    out["stamp_duty"] = (f"CAST(round({turnover} * 0.00015000, 2) AS DECIMAL(24,2))" if side == "BUY"
                         else "CAST(0 AS DECIMAL(24,2))")
    out["dp_charge"] = "CAST(0 AS DECIMAL(24,2))"
    return out


ENTRY_LEG, EXIT_LEG = leg_sql("entry_turnover", "BUY"), leg_sql("exit_turnover", "SELL")
part("trade2", ("trade1",), f"""
  SELECT *, CASE WHEN skip_reason IS NULL THEN CAST(slipped_entry * CAST(quantity0 AS DECIMAL(12,0)) AS DECIMAL(22,6)) END AS entry_turnover,
         CAST(coalesce(multiple, 1) * CAST(quantity0 AS DECIMAL(12,0)) AS DECIMAL(18,6)) AS quantity,
         CASE WHEN skip_reason IS NULL THEN CAST(slipped_exit * CAST(multiple * CAST(quantity0 AS DECIMAL(12,0)) AS DECIMAL(18,6)) AS DECIMAL(22,6)) END AS exit_turnover,
         CASE WHEN skip_reason IS NULL THEN {dec8_sql("least(CAST(slipped_entry AS DOUBLE), lo, CASE WHEN exit_reason IN ('STOP_LOSS','PROFIT_TARGET','TIME_EXIT') THEN CAST(raw_exit AS DOUBLE) * CAST(multiple AS DOUBLE) END) / CAST(slipped_entry AS DOUBLE) - 1e0")} END AS mae,
         CASE WHEN skip_reason IS NULL THEN {dec8_sql("greatest(CAST(slipped_entry AS DOUBLE), hi, CASE WHEN exit_reason IN ('STOP_LOSS','PROFIT_TARGET','TIME_EXIT') THEN CAST(raw_exit AS DOUBLE) * CAST(multiple AS DOUBLE) END) / CAST(slipped_entry AS DOUBLE) - 1e0")} END AS mfe
  FROM trade1""")
part("trade3", ("trade2",), f"""
  SELECT *, CAST(round(entry_turnover, 2) AS DECIMAL(24,2)) AS deployed,
         CAST(round(exit_turnover - entry_turnover, 2) AS DECIMAL(24,2)) AS gross_pnl,
         {' + '.join(ENTRY_LEG.values())} AS entry_total, {' + '.join(EXIT_LEG.values())} AS exit_total
  FROM trade2""")
part("trade4", ("trade3",), f"""
  SELECT *, CAST(entry_total + exit_total AS DECIMAL(24,2)) AS total_costs,
         CAST(gross_pnl - (entry_total + exit_total) AS DECIMAL(24,2)) AS net_pnl,
         {dec8_sql('CAST(gross_pnl AS DOUBLE) / CAST(entry_turnover AS DOUBLE)')} AS gross_return,
         {dec8_sql('CAST(gross_pnl - (entry_total + exit_total) AS DOUBLE) / CAST(entry_turnover AS DOUBLE)')} AS net_return,
         row_number() OVER (PARTITION BY series ORDER BY signal) AS k
  FROM trade3""")
# T9: one step per setup of a series
DECIDE = """decide AS (
  SELECT series, k, signal, skip_reason IS NULL AS took, coalesce(skip_reason, 'TRADE') AS decision,
         CASE WHEN skip_reason IS NULL THEN coalesce(exit_session, DATE '9999-12-31') END AS until
  FROM trade4 WHERE k = 1
  UNION ALL
  SELECT t.series, t.k, t.signal, (x.until IS NULL OR t.signal >= x.until) AND t.skip_reason IS NULL,
         CASE WHEN x.until IS NOT NULL AND t.signal < x.until THEN 'ALREADY_OPEN_POSITION'
              ELSE coalesce(t.skip_reason, 'TRADE') END,
         CASE WHEN (x.until IS NULL OR t.signal >= x.until) AND t.skip_reason IS NULL
              THEN coalesce(t.exit_session, DATE '9999-12-31') ELSE x.until END
  FROM decide x JOIN trade4 t ON t.series = x.series AND t.k = x.k + 1
),
decided AS (SELECT t.*, decision FROM trade4 t JOIN decide USING (series, k)),
taken AS (SELECT * FROM decided WHERE decision = 'TRADE')"""


def trade_sql(body, *needs, more=""):
    return sql(body, "trade4", *needs, recursive=DECIDE + more)


def dbl(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def dbls(*columns):
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)


def add(name, query, oracle):
    QUERIES[name], ORACLES[name] = query, oracle


def texted(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


add("t01_next_open_entry",
    lambda s, p: dbl(texted(priced(s, p).select("series", "signal", "entry_session", "raw_entry", F.when(
        F.col("skip_reason").isin("ENTRY_OUTSIDE_TEST_RANGE", "ENTRY_PRICE_UNAVAILABLE"), F.col("skip_reason")).alias(
        "reason")), "signal", "entry_session"), "raw_entry"),
    sql(f"""SELECT series, {d('signal')}, {d('entry_session')}, {dbls('raw_entry')}, CASE WHEN skip_reason IN
            ('ENTRY_OUTSIDE_TEST_RANGE', 'ENTRY_PRICE_UNAVAILABLE') THEN skip_reason END AS reason FROM trade1""", "trade1"))
add("t02_t03_slippage_and_size",
    lambda s, p: dbl(texted(priced(s, p).where(F.col("slipped_entry").isNotNull()).select(
        "series", "signal", "slipped_entry", "slipped_exit", "quantity0", "skip_reason"), "signal"), "slipped_entry",
        "slipped_exit"),
    sql(f"""SELECT series, {d('signal')}, {dbls('slipped_entry', 'slipped_exit')}, quantity0, skip_reason FROM trade1
            WHERE slipped_entry IS NOT NULL""", "trade1"))


def _exits(*reasons):
    return (lambda s, p: dbl(texted(priced(s, p).where(F.col("exit_reason").isin(*reasons)).select(
        "series", "signal", "exit_session", "exit_reason", "raw_exit", "holding_sessions",
        F.array_contains("warnings", "AMBIGUOUS_INTRADAY_PATH_STOP_FIRST").alias("unclear")).withColumn(
        "holding_sessions", F.col("holding_sessions").cast("bigint")), "signal", "exit_session"), "raw_exit"),
        sql(f"""SELECT series, {d('signal')}, {d('exit_session')}, exit_reason, {dbls('raw_exit')}, held AS holding_sessions,
                coalesce(unclear, false) AS unclear FROM trade1 WHERE skip_reason IS NULL
                AND exit_reason IN ({', '.join(repr(r) for r in reasons)})""", "trade1"))


add("t04_first_touch", *_exits("STOP_LOSS", "PROFIT_TARGET"))
add("t05_time_exit", *_exits("TIME_EXIT", "EXIT_PRICE_UNAVAILABLE"))
add("t06_forced_end", *_exits("FORCED_END_OF_TEST"))
add("t07_hold_action_effects",
    lambda s, p: dbl(texted(priced(s, p).where(F.col("skip_reason").isNull() & (F.col("quantity") != F.col("quantity0"))).select(
        "series", "signal", "quantity0", "quantity", "raw_exit", "exit_reason"), "signal"), "quantity", "raw_exit"),
    sql(f"""SELECT series, {d('signal')}, quantity0, {dbls('quantity', 'raw_exit')}, exit_reason FROM trade2
            WHERE skip_reason IS NULL AND quantity <> quantity0""", "trade2"))
add("t08_mae_mfe",
    lambda s, p: dbl(texted(priced(s, p).where(F.col("skip_reason").isNull()).select("series", "signal", "mae", "mfe"),
                            "signal"), "mae", "mfe"),
    sql(f"SELECT series, {d('signal')}, mae, mfe FROM trade2 WHERE skip_reason IS NULL", "trade2"))
add("t09_no_overlap",
    lambda s, p: texted(decided(s, p).select("series", "signal", "decision"), "signal"),
    trade_sql(f"SELECT series, {d('signal')}, decision FROM decided"))
add("t10_skip_reasons",
    lambda s, p: trades.skip_reasons(decided(s, p)),
    trade_sql("SELECT decision AS reason, count(*) AS setups FROM decided WHERE decision <> 'TRADE' GROUP BY decision"))
PNL = ("deployed", "gross_pnl", "total_costs", "net_pnl", "gross_return", "net_return")
add("t11_trade_pnl",
    lambda s, p: dbl(texted(taken(s, p).select("series", "signal", "exit_reason", *PNL), "signal"), *PNL),
    trade_sql(f"SELECT series, {d('signal')}, exit_reason, {dbls(*PNL)} FROM taken"))


def _legs(s, p):
    bars = src.bars(s, p)
    turnover = ticks_to_price(F.col("close")) * F.col("volume").cast("decimal(12,0)")
    both = F.explode(F.array(
        F.struct(F.lit("BUY").alias("side"), leg_costs(turnover, "BUY").alias("c")),
        F.struct(F.lit("SELL").alias("side"), leg_costs(turnover, "SELL").alias("c"))))
    rows = bars.select("series", F.col("session").cast("string").alias("session"), both.alias("leg"))
    return dbl(rows.select("series", "session", "leg.side", "leg.c.*"), "turnover", *COMPONENTS, "total_charges")


def _legs_sql(side):
    leg = leg_sql("t", side)
    return (f"SELECT series, {d('session')}, '{side}' AS side, CAST(round(t, 2) AS DOUBLE) AS turnover, "
            + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in leg.items())
            + f", CAST({' + '.join(leg.values())} AS DOUBLE) AS total_charges FROM legs")


part("legs", ("bars",), f"""SELECT series, session,
  CAST({price('close')} * CAST(volume AS DECIMAL(12,0)) AS DECIMAL(22,6)) AS t FROM bars""")
add("c1_leg_costs", _legs, sql(_legs_sql("BUY") + " UNION ALL " + _legs_sql("SELL"), "legs"))
add("c2_cost_totals",
    lambda s, p: dbl(trades.cost_totals(taken(s, p)), *COMPONENTS, "total_charges"),
    trade_sql("SELECT " + ", ".join(
        f"CAST(sum({ENTRY_LEG[c]}) + coalesce(sum({EXIT_LEG[c]}), 0) AS DOUBLE) AS {c}" for c in COMPONENTS)
        + ", CAST(sum(entry_total) + coalesce(sum(exit_total), 0) AS DOUBLE) AS total_charges FROM taken"))
