"""Portfolio tables and risk metrics (R1-R12). Portfolio = series modulo 4; index curves serve the risk metrics."""

from __future__ import annotations

from catalog.lookups import d
from catalog.sql import part, r8, sql
from catalog.statistics import hud
from catalog.trading import dbls, decided, price, trade_sql
from pyspark.sql import functions as F

from tapewright.operators import portfolio as pf
from tapewright.operators import trades as tr
from tapewright.sources import adapters as src

QUERIES, ORACLES = {}, {}
CAPITAL, START, END = "1000000", "1996-01-01", "2001-06-25"


def add(name, query, oracle):
    QUERIES[name], ORACLES[name] = query, oracle


def dec(s, p):
    return decided(s, p).withColumn("portfolio_id", F.col("series") % 4)


def book(s, p):
    """Executed trades with the share counts of their holds."""
    return pf.with_share_steps(tr.executed(dec(s, p)), tr.hold_effects(src.actions(s, p), src.calendar(s, p)))


def out(df, dates=(), doubles=()):
    return df.withColumns({**{c: F.col(c).cast("string") for c in dates},
                           **{c: F.col(c).cast("double") for c in doubles}})


BOOK = f""",
book AS (SELECT *, series % 4 AS portfolio_id, CASE WHEN quantity <> quantity0 THEN CASE WHEN series % 10 = 0
    THEN DATE '1998-06-08' ELSE DATE '1997-04-14' END END AS split_session FROM taken),
events_ AS (
  SELECT DISTINCT portfolio_id, DATE '{START}' AS session, 0 AS rank, CAST(-1 AS BIGINT) AS series, 'INITIAL_CAPITAL' AS event,
         CAST({CAPITAL} AS DECIMAL(24,2)) AS net FROM book
  UNION ALL SELECT portfolio_id, exit_session, 1, series, 'EXIT', CAST(round(exit_turnover, 2) - exit_total AS DECIMAL(24,2))
    FROM book WHERE exit_session IS NOT NULL
  UNION ALL SELECT portfolio_id, entry_session, 2, series, 'ENTRY', CAST(-(deployed + entry_total) AS DECIMAL(24,2)) FROM book),
ledger AS (SELECT *, row_number() OVER w AS sequence, sum(net) OVER w AS balance FROM events_
  WINDOW w AS (PARTITION BY portfolio_id ORDER BY session, rank, series ROWS UNBOUNDED PRECEDING)),
marks AS (
  SELECT b.portfolio_id, b.series, b.signal, c.session,
    coalesce(last_value(CAST({price('t.close')} * CASE WHEN c.session >= split_session THEN quantity ELSE CAST(quantity0 AS DECIMAL(18,6)) END AS DECIMAL(24,6)) IGNORE NULLS)
      OVER (PARTITION BY b.series, b.signal ORDER BY c.session ROWS UNBOUNDED PRECEDING),
      CAST(slipped_entry * CAST(quantity0 AS DECIMAL(12,0)) AS DECIMAL(24,6))) AS value, t.close IS NULL AS stale
  FROM book b JOIN calendar c ON c.session >= b.entry_session AND c.session <= DATE '{END}'
    AND (b.exit_session IS NULL OR c.session < b.exit_session)
  LEFT JOIN bars t ON t.series = b.series AND t.session = c.session AND t.close > 0),
mtm AS (SELECT portfolio_id, session, CAST(round(sum(value), 2) AS DECIMAL(24,2)) AS gross, count(*) AS open_positions,
  count(*) FILTER (WHERE stale) AS stale_marks FROM marks GROUP BY 1, 2),
snap0 AS (
  SELECT p.portfolio_id, c.session, coalesce(m.gross, 0) AS gross, coalesce(open_positions, 0) AS open_positions,
    coalesce(stale_marks, 0) AS stale_marks,
    (SELECT sum(net) FROM events_ e WHERE e.portfolio_id = p.portfolio_id AND e.session <= c.session) AS cash,
    coalesce((SELECT sum(net_pnl) FROM book e WHERE e.portfolio_id = p.portfolio_id AND e.exit_session <= c.session), 0) AS realized,
    coalesce((SELECT sum(exit_total) FROM book e WHERE e.portfolio_id = p.portfolio_id AND e.exit_session = c.session), 0)
     + coalesce((SELECT sum(entry_total) FROM book e WHERE e.portfolio_id = p.portfolio_id AND e.entry_session = c.session), 0) AS daily_costs
  FROM (SELECT DISTINCT portfolio_id FROM book) p CROSS JOIN
    (SELECT session FROM calendar WHERE session BETWEEN DATE '{START}' AND DATE '{END}') c
  LEFT JOIN mtm m ON m.portfolio_id = p.portfolio_id AND m.session = c.session),
snap AS (
  SELECT *, coalesce(cash, 0) + gross AS equity, sum(daily_costs) OVER w AS cumulative_costs,
    coalesce(cash, 0) + gross - {CAPITAL} - realized AS unrealized,
    {r8('CAST(coalesce(cash, 0) + gross AS DOUBLE) / lag(CAST(coalesce(cash, 0) + gross AS DOUBLE)) OVER w - 1e0')} AS daily_return,
    {r8('CAST(coalesce(cash, 0) + gross AS DOUBLE) / max(CAST(coalesce(cash, 0) + gross AS DOUBLE)) OVER w - 1e0')} AS drawdown
  FROM snap0 WINDOW w AS (PARTITION BY portfolio_id ORDER BY session ROWS UNBOUNDED PRECEDING))"""


def book_sql(body):
    return trade_sql(body, "calendar", "bars", more=BOOK)


add("r01_cash_ledger",
    lambda s, p: out(pf.cash_ledger(pf.fills(book(s, p), CAPITAL, START)).drop("rank").withColumn(
        "sequence", F.col("sequence").cast("bigint")), ["session"], ["net", "balance"]),
    book_sql(f"SELECT portfolio_id, {d('session')}, series, event, {dbls('net', 'balance')}, sequence, balance >= 0 AS sound FROM ledger"))
add("r01_ledger_check",
    lambda s, p: out(pf.ledger_check(pf.cash_ledger(pf.fills(book(s, p), CAPITAL, START))), (),
                     ["net_total", "final_balance", "lowest_balance"]),
    book_sql("""SELECT portfolio_id, count(*) AS events, CAST(sum(net) AS DOUBLE) AS net_total,
        CAST(arg_max(balance, sequence) AS DOUBLE) AS final_balance, CAST(min(balance) AS DOUBLE) AS lowest_balance,
        sum(net) = arg_max(balance, sequence) AS reconciles FROM ledger GROUP BY 1"""))


def marks(s, p, b):
    return pf.mark_positions(b, src.bars(s, p), src.calendar(s, p), END)


add("r02_mark_to_market",
    lambda s, p: out(pf.mark_to_market(marks(s, p, book(s, p))), ["session"], ["gross"]),
    book_sql(f"SELECT portfolio_id, {d('session')}, {dbls('gross')}, open_positions, stale_marks FROM mtm"))


def twice(s, p):
    """The share changes of the data, and each once more a week later."""
    once = tr.hold_effects(src.actions(s, p), src.calendar(s, p))
    return once.unionByName(once.withColumn("session", F.date_add("session", 7)))


add("r02_marks_over_two_changes",
    lambda s, p: out(pf.mark_to_market(marks(s, p, pf.with_share_steps(tr.executed(dec(s, p)), twice(s, p)))), ["session"], ["gross"]),
    book_sql(f"""SELECT portfolio_id, {d('session')}, {dbls('gross')}, open_positions, stale_marks FROM (
      SELECT portfolio_id, session, CAST(round(sum(value), 2) AS DECIMAL(24,2)) AS gross, count(*) AS open_positions,
        count(*) FILTER (WHERE stale) AS stale_marks FROM (
        SELECT portfolio_id, series, signal, session, close IS NULL AS stale,
          coalesce(last_value(CAST({price('close')} * CAST(quantity0 * multiple AS DECIMAL(18,6)) AS DECIMAL(24,6)) IGNORE NULLS)
            OVER (PARTITION BY series, signal ORDER BY session ROWS UNBOUNDED PRECEDING),
            CAST(slipped_entry * CAST(quantity0 AS DECIMAL(12,0)) AS DECIMAL(24,6))) AS value FROM (
          SELECT b.portfolio_id, b.series, b.signal, b.slipped_entry, b.quantity0, c.session, t.close, coalesce(product(1 / f), 1) AS multiple
          FROM book b JOIN calendar c ON c.session >= b.entry_session AND c.session <= DATE '{END}'
            AND (b.exit_session IS NULL OR c.session < b.exit_session)
          LEFT JOIN bars t ON t.series = b.series AND t.session = c.session AND t.close > 0
          LEFT JOIN (SELECT e.series, k.session + later AS since, f FROM effects e JOIN cal k USING (idx), (VALUES (0), (7)) v(later) WHERE f IS NOT NULL) e
            ON e.series = b.series AND e.since > b.entry_session AND e.since <= c.session
          GROUP BY ALL))
      GROUP BY 1, 2)"""))


def snapshots(s, p):
    b = book(s, p)
    return pf.equity_snapshots(marks(s, p, b), pf.fills(b, CAPITAL, START), b, src.calendar(s, p), CAPITAL, START, END), b


MONEY = ["cash", "gross", "equity", "realized", "unrealized", "daily_costs", "cumulative_costs"]
add("r03_equity_snapshots",
    lambda s, p: out(snapshots(s, p)[0], ["session"], MONEY),
    book_sql(f"""SELECT portfolio_id, {d('session')}, {dbls(*MONEY)}, open_positions, stale_marks,
        {r8('CASE WHEN equity > 0 THEN CAST(gross AS DOUBLE) / CAST(equity AS DOUBLE) END')} AS exposure,
        {r8('CASE WHEN equity > 0 THEN CAST(cash AS DOUBLE) / CAST(equity AS DOUBLE) END')} AS cash_share,
        daily_return, drawdown FROM snap"""))


def curve(s, p):
    return src.benchmark_prices(s, p).select(
        F.col("index_id").alias("portfolio_id"), "session",
        (F.col("close").cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(24,2)").alias("equity"))


part("curve", ("benchmark_prices",), """SELECT index_id AS portfolio_id, 'ALL' AS label, session,
  CAST(CAST(close AS DECIMAL(20,0)) * 0.01 AS DECIMAL(24,2)) AS equity FROM benchmark_prices""")
part("segments", ("curve",), """SELECT portfolio_id, CASE WHEN session < DATE '1999-01-04' THEN 'IN_SAMPLE'
  ELSE 'OUT_OF_SAMPLE' END AS label, session, equity FROM curve""")


def risk_parts(base):
    part(f"risk0_{base}", (base,), f"""
      SELECT *, row_number() OVER w AS i, max(equity) OVER w AS peak, CASE WHEN lag(equity) OVER w > 0 THEN
        {r8('CAST(equity AS DOUBLE) / CAST(lag(equity) OVER w AS DOUBLE) - 1e0')} END AS r
      FROM {base} WINDOW w AS (PARTITION BY portfolio_id, label ORDER BY session ROWS UNBOUNDED PRECEDING)""")
    part(f"fall_{base}", (f"risk0_{base}",), f"""
      SELECT portfolio_id, label, CAST(equity AS DOUBLE) / CAST(peak AS DOUBLE) - 1e0 AS fall, i AS ti, session AS trough,
             peak, equity FROM risk0_{base} QUALIFY row_number() OVER (PARTITION BY portfolio_id, label
             ORDER BY CAST(equity AS DOUBLE) / CAST(peak AS DOUBLE), i) = 1""")
    part(f"down_{base}", (f"fall_{base}", f"risk0_{base}"), f"""
      SELECT f.portfolio_id, f.label, {r8('f.fall')} AS max_drawdown,
        CASE WHEN fall < 0 THEN CAST(f.peak - f.equity AS DOUBLE) ELSE 0e0 END AS max_drawdown_value,
        CASE WHEN fall < 0 THEN min(r.session) FILTER (WHERE r.equity = f.peak AND r.i <= ti) ELSE min(r.session) END AS peak_date,
        CASE WHEN fall < 0 THEN trough ELSE min(r.session) END AS trough_date,
        min(r.session) FILTER (WHERE fall < 0 AND r.i > ti AND r.equity >= f.peak) AS recovery_date,
        CASE WHEN fall < 0 THEN coalesce(min(r.i) FILTER (WHERE r.i > ti AND r.equity >= f.peak), max(r.i))
          - min(r.i) FILTER (WHERE r.equity = f.peak AND r.i <= ti) ELSE 0 END AS duration_sessions
      FROM fall_{base} f JOIN risk0_{base} r USING (portfolio_id, label) GROUP BY f.portfolio_id, f.label, fall, f.peak, f.equity, trough""")
    rf = 1.05 ** (1.0 / 252) - 1.0
    part(f"stats_{base}", (f"risk0_{base}",), f"""
      SELECT portfolio_id, label, min(session) AS start_date, max(session) AS end_date, count(r) AS n,
        CAST(arg_min(equity, session) AS DOUBLE) AS starting_equity, CAST(arg_max(equity, session) AS DOUBLE) AS ending_equity,
        {r8('stddev_samp(r)')} AS sd, {r8(f'stddev_samp(r - {rf!r})')} AS esd, avg(r - {rf!r}) AS mean,
        sqrt(avg(least(r - {rf!r}, 0e0) * least(r - {rf!r}, 0e0))) AS dd FROM risk0_{base} GROUP BY 1, 2""")
    part(f"risk_{base}", (f"stats_{base}", f"down_{base}"), f"""
      SELECT *, {r8('cagr / nullif(abs(max_drawdown), 0)')} AS calmar FROM (
        SELECT s.*, {r8('ending_equity / starting_equity - 1e0')} AS total_return,
          CASE WHEN end_date > start_date THEN {r8('pow(ending_equity / starting_equity, 365.2425e0 / (end_date - start_date)) - 1e0')} END AS cagr,
          CASE WHEN n >= 2 THEN {r8('sd * sqrt(252e0)')} END AS annualized_volatility,
          CASE WHEN n >= 2 THEN {r8('mean / nullif(esd, 0) * sqrt(252e0)')} END AS sharpe,
          CASE WHEN n >= 2 THEN {r8('mean * sqrt(252e0) / nullif(dd, 0)')} END AS sortino, d.* EXCLUDE (portfolio_id, label)
        FROM stats_{base} s JOIN down_{base} d USING (portfolio_id, label))""")


risk_parts("curve")
risk_parts("segments")
RF = 0.05


def risk(s, p):
    return pf.risk_metrics(curve(s, p), risk_free=RF)


add("r04_drawdown_details",
    lambda s, p: out(pf.drawdown_details(curve(s, p)), ["peak_date", "trough_date", "recovery_date"], ["max_drawdown_value"]),
    sql(f"""SELECT portfolio_id, max_drawdown, max_drawdown_value, {d('peak_date')}, {d('trough_date')}, {d('recovery_date')},
            duration_sessions FROM down_curve""", "down_curve"))
add("r05_cagr",
    lambda s, p: out(risk(s, p).select("portfolio_id", "start_date", "end_date", "starting_equity", "ending_equity",
                                       "total_return", "cagr"), ["start_date", "end_date"], ["starting_equity", "ending_equity"]),
    sql(f"""SELECT portfolio_id, {d('start_date')}, {d('end_date')}, starting_equity, ending_equity, total_return, cagr
            FROM risk_curve""", "risk_curve"))
add("r06_r09_volatility_sharpe_sortino_calmar",
    lambda s, p: risk(s, p).select("portfolio_id", "annualized_volatility", "sharpe", "sortino", "calmar", "warnings"),
    sql("""SELECT portfolio_id, annualized_volatility, sharpe, sortino, calmar, '' AS warnings FROM risk_curve""", "risk_curve"))
add("r10_portfolio_metrics",
    lambda s, p: out(pf.portfolio_metrics(*snapshots(s, p)), (), ["minimum_cash"]),
    book_sql(f"""
      SELECT c.*, t.* EXCLUDE (portfolio_id, mean_), {r8('total_turnover / mean_')} AS portfolio_turnover FROM (
        SELECT portfolio_id, {r8('avg(x)')} AS average_exposure, max(x) AS maximum_exposure, {r8('avg(k)')} AS average_cash_share,
          CAST(min(cash) AS DOUBLE) AS minimum_cash, {r8('avg(open_positions)')} AS average_open_positions,
          max(open_positions) AS maximum_open_positions FROM (SELECT *, {r8('CAST(gross AS DOUBLE) / CAST(equity AS DOUBLE)')} AS x,
          {r8('CAST(cash AS DOUBLE) / CAST(equity AS DOUBLE)')} AS k FROM snap) GROUP BY 1) c
      JOIN (SELECT portfolio_id, CAST(sum(round(entry_turnover, 2) + coalesce(round(exit_turnover, 2), 0)) AS DOUBLE) AS total_turnover,
          CAST(sum(entry_total + coalesce(exit_total, 0)) AS DOUBLE) AS total_costs,
          {r8('CAST(sum(entry_total + coalesce(exit_total, 0)) AS DOUBLE) / CAST(sum(round(entry_turnover, 2) + coalesce(round(exit_turnover, 2), 0)) AS DOUBLE)')} AS cost_drag,
          count(*) AS entry_count, count(net_pnl) AS exit_count, count(*) FILTER (WHERE net_pnl > 0) AS profitable,
          count(*) FILTER (WHERE net_pnl < 0) AS losing, count(*) FILTER (WHERE net_pnl = 0) AS breakeven,
          {r8('count(*) FILTER (WHERE net_pnl > 0) / nullif(count(net_pnl), 0)')} AS win_rate,
          {hud('sum(CAST(round(net_return * 1e8) AS BIGINT)) FILTER (WHERE net_pnl IS NOT NULL)', 'count(net_pnl)')} / 1e8 AS average_return,
          {r8('median(net_return) FILTER (WHERE net_pnl IS NOT NULL)')} AS median_return,
          (SELECT avg(CAST(equity AS DOUBLE)) FROM snap WHERE snap.portfolio_id = book.portfolio_id) AS mean_
          FROM book GROUP BY portfolio_id) t USING (portfolio_id)"""))
SEG = ("total_return", "cagr", "annualized_volatility", "sharpe", "sortino", "max_drawdown")
add("r11_segment_metrics",
    lambda s, p: out(pf.segment_metrics(curve(s, p), "1999-01-04", RF).select(
        "portfolio_id", "label", "start_date", "starting_equity", *SEG), ["start_date"], ["starting_equity"]),
    sql(f"SELECT portfolio_id, label, {d('start_date')}, starting_equity, {', '.join(SEG)} FROM risk_segments", "risk_segments"))
add("r12_rejection_counts",
    lambda s, p: pf.rejection_counts(dec(s, p)),
    trade_sql("""SELECT series % 4 AS portfolio_id, decision AS reason, count(*) AS candidates FROM decided
                 WHERE decision <> 'TRADE' GROUP BY 1, 2"""))
