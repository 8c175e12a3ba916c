"""Trade analytics (N1-N8), regimes and attribution (G1-G7)."""

from __future__ import annotations

from catalog.features import feature_parts
from catalog.lookups import d
from catalog.sql import part, r8, sql
from catalog.trading import decided, trade_sql
from pyspark.sql import functions as F

from tapewright.functions import numbers
from tapewright.functions.fixed_values import REGIMES
from tapewright.operators import analytics, regimes
from tapewright.sources import adapters as src

QUERIES, ORACLES = {}, {}


def add(name, query, oracle):
    QUERIES[name], ORACLES[name] = query, oracle


def hud(a, b):
    """Integer a / b, halves away from zero."""
    return f"(CAST(sign({a}) AS BIGINT) * ((abs({a}) * 2 + ({b})) // nullif(({b}) * 2, 0)))"


CLOSED = """closed AS (SELECT *, CAST(net_pnl * 100 AS BIGINT) AS net, CAST(gross_pnl * 100 AS BIGINT) AS gross,
  CAST(total_costs * 100 AS BIGINT) AS cost, CAST(deployed * 100 AS BIGINT) AS dep,
  CAST(round(net_return * 1e8) AS BIGINT) AS ret, CAST(round(gross_return * 1e8) AS BIGINT) AS gret,
  CAST(round(mae * 1e8) AS BIGINT) AS mae8, CAST(round(mfe * 1e8) AS BIGINT) AS mfe8 FROM taken WHERE net_pnl IS NOT NULL)"""


def tagged(label):
    """Setups, and closed trades, with a label each; `label` is SQL over the setup's columns."""
    return f""",
{CLOSED},
lab AS (SELECT *, {label} AS label FROM decided),
clab AS (SELECT *, {label} AS label FROM closed)"""


def _pct(h):
    pos = f"{h} * (n - 1)"
    lo, frac = f"({pos}) // 100", f"({pos}) % 100"
    a, z = f"v[CAST({lo} + 1 AS BIGINT)]", f"v[CAST(least({lo} + 1, n - 1) + 1 AS BIGINT)]"
    x = f"({a} * 100 + ({z} - {a}) * ({frac}))"
    return f"CAST(sign({x}) AS BIGINT) * ((abs({x}) + 50) // 100) / 1e8"


PCT = ", ".join(f"{_pct(h)} AS percentile_{h:02d}" for h in analytics.PERCENTILES)


def metrics_sql(percentiles=True, labels="(SELECT DISTINCT label FROM lab)"):
    mean8 = lambda c: f"{hud(f'sum({c})', 'count(*)')} / 1e8"
    mean2 = lambda c: f"{hud(f'sum({c})', 'count(*)')} / 1e2"
    gain, loss = "coalesce(sum(net) FILTER (WHERE net > 0), 0)", "sum(net) FILTER (WHERE net < 0)"
    wins, losses = "count(*) FILTER (WHERE net > 0)", "count(*) FILTER (WHERE net < 0)"
    return f"""
SELECT label, signal_count, executed_count, coalesce(closed_count, 0) AS closed_count,
  coalesce(forced_end_count, 0) AS forced_end_count, coalesce(closed_normal_count, 0) AS closed_normal_count,
  coalesce(winning, 0) AS winning, coalesce(losing, 0) AS losing, coalesce(breakeven, 0) AS breakeven,
  win_rate, loss_rate, average_gross_return, average_net_return, average_gross_pnl, average_net_pnl,
  coalesce(total_gross_pnl, 0e0) AS total_gross_pnl, coalesce(total_net_pnl, 0e0) AS total_net_pnl,
  coalesce(total_costs, 0e0) AS total_costs, cost_drag, average_cost, profit_factor, average_net_pnl AS expectancy,
  best_return, worst_return, stddev_net_return, average_holding, maximum_holding, average_mae, average_mfe,
  concat_ws(',', CASE WHEN closed_count IS NULL THEN 'NO_TRADES' WHEN closed_count < 10 THEN 'VERY_LOW_SAMPLE_SIZE'
                      WHEN closed_count < 30 THEN 'LOW_SAMPLE_SIZE' END,
                 CASE WHEN loss_sum IS NOT NULL THEN NULL WHEN winning > 0 THEN 'PROFIT_FACTOR_UNDEFINED_NO_LOSING_TRADES'
                      WHEN closed_count > 0 THEN 'PROFIT_FACTOR_UNDEFINED_NO_GAINS_OR_LOSSES' END,
                 CASE WHEN closed_count = 1 THEN 'INSUFFICIENT_TRADES_STANDARD_DEVIATION' END) AS warnings,
  coalesce(gross_profit, 0e0) AS gross_profit, coalesce(gross_loss, 0e0) AS gross_loss, average_win, average_loss
  {', ' + ', '.join(f'percentile_{h:02d}' for h in analytics.PERCENTILES) if percentiles else ''}
FROM {labels} every
LEFT JOIN (SELECT label, count(*) AS signal_count, count(*) FILTER (WHERE decision = 'TRADE') AS executed_count
           FROM lab GROUP BY label) s USING (label)
LEFT JOIN (
  SELECT label, count(*) AS closed_count, count(*) FILTER (WHERE exit_reason = 'FORCED_END_OF_TEST') AS forced_end_count,
    count(*) FILTER (WHERE exit_reason <> 'FORCED_END_OF_TEST') AS closed_normal_count, {wins} AS winning, {losses} AS losing,
    count(*) FILTER (WHERE net = 0) AS breakeven, {r8(f'{wins} / count(*)')} AS win_rate,
    {r8(f'{losses} / count(*)')} AS loss_rate, {mean8('gret')} AS average_gross_return, {mean8('ret')} AS average_net_return,
    {mean2('gross')} AS average_gross_pnl, {mean2('net')} AS average_net_pnl, sum(gross) / 1e2 AS total_gross_pnl,
    sum(net) / 1e2 AS total_net_pnl, sum(cost) / 1e2 AS total_costs,
    {r8('CAST(sum(cost) AS DOUBLE) / nullif(CAST(sum(dep) AS DOUBLE), 0)')} AS cost_drag, {mean2('cost')} AS average_cost,
    {r8(f'CAST({gain} AS DOUBLE) / nullif(-CAST({loss} AS DOUBLE), 0)')} AS profit_factor, {loss} AS loss_sum,
    max(ret) / 1e8 AS best_return, min(ret) / 1e8 AS worst_return,
    CASE WHEN count(*) >= 2 THEN {r8('stddev_pop(net_return)')} END AS stddev_net_return,
    {hud('sum(held) * 100000000', 'count(*)')} / 1e8 AS average_holding, max(held) AS maximum_holding,
    {mean8('mae8')} AS average_mae, {mean8('mfe8')} AS average_mfe, {gain} / 1e2 AS gross_profit,
    coalesce({loss}, 0) / 1e2 AS gross_loss,
    CASE WHEN {wins} > 0 THEN {hud(gain, wins)} / 1e2 END AS average_win,
    CASE WHEN {losses} > 0 THEN {hud(loss, losses)} / 1e2 END AS average_loss
  FROM clab GROUP BY label) t USING (label)
LEFT JOIN (SELECT label, {PCT} FROM (SELECT label, list_sort(list(ret)) AS v, count(*) AS n FROM clab GROUP BY label)) p
  USING (label)"""


add("n1_trade_analytics",
    lambda s, p: analytics.trade_analytics(decided(s, p)),
    trade_sql(f"SELECT * EXCLUDE (label) FROM ({metrics_sql()})", more=tagged("'ALL'")))


def few(df, keys, *cols):
    return df.select(*keys, *cols)


add("n2_profit_factor",
    lambda s, p: few(analytics.trade_analytics(decided(s, p), ["series"], False),
                     ["series"], "closed_count", "profit_factor", "warnings"),
    trade_sql(f"SELECT CAST(label AS BIGINT) AS series, closed_count, profit_factor, warnings FROM ({metrics_sql()})",
              more=tagged("series")))
PCOLS = [f"percentile_{h:02d}" for h in analytics.PERCENTILES]
add("n3_return_percentiles",
    lambda s, p: analytics.return_percentiles(decided(s, p), ["series"]),
    trade_sql(f"SELECT CAST(label AS BIGINT) AS series, {', '.join(PCOLS)} FROM ({metrics_sql()}) WHERE closed_count > 0",
              more=tagged("series")))
add("n4_n5_stddev_and_sample_warnings",
    lambda s, p: few(analytics.trade_analytics(decided(s, p).withColumn("month", F.date_format("signal", "yyyy-MM")),
                                               ["month"], False), ["month"], "closed_count", "stddev_net_return", "warnings"),
    trade_sql(f"SELECT label AS month, closed_count, stddev_net_return, warnings FROM ({metrics_sql()})",
              more=tagged("strftime(signal, '%Y-%m')")))
add("n6_period_breakdown",
    lambda s, p: analytics.period_breakdown(decided(s, p)),
    trade_sql(metrics_sql(), more=tagged("CAST(year(signal) AS VARCHAR)")))
HOLD = f""",
{CLOSED},
lab AS (SELECT *, CASE WHEN signal < DATE '1999-01-04' THEN 'IN_SAMPLE' ELSE 'OUT_OF_SAMPLE' END AS label FROM decided
        UNION ALL SELECT *, 'OVERALL' FROM decided),
clab AS (SELECT *, CASE WHEN signal < DATE '1999-01-04' THEN 'IN_SAMPLE' ELSE 'OUT_OF_SAMPLE' END AS label FROM closed
        UNION ALL SELECT *, 'OVERALL' FROM closed)"""
add("n7_holdout_split", lambda s, p: analytics.holdout_split(decided(s, p), "1999-01-04"),
    trade_sql(metrics_sql(), more=HOLD))
add("n8_return_histogram",
    lambda s, p: analytics.return_histogram(decided(s, p)),
    trade_sql(f"""SELECT CAST(t.b AS BIGINT) AS bin, {r8('m.low_ + m.wide_ * t.b')} AS lower,
      {r8('m.low_ + m.wide_ * (t.b + 1)')} AS upper,
      (SELECT count(*) FROM closed c WHERE least(floor((c.net_return - m.low_) / m.wide_), 7) = t.b) AS trades
      FROM (SELECT min(net_return) AS low_, (max(net_return) - min(net_return)) / 8 AS wide_ FROM closed) m, range(8) t(b)""",
              more=f",\n{CLOSED}"))

# --- G -----------------------------------------------------------------------------------------------------------
part("index_bars", ("benchmark_prices",), """
  SELECT index_id AS series, session, open, high, low, close, CAST(0 AS BIGINT) AS volume,
         CAST(NULL AS DECIMAL(24,2)) AS traded_value FROM benchmark_prices""")
feature_parts("index_bars")
part("vols", ("averaged_index_bars",), """
  SELECT series AS index_id, session, n_obs, close, "SMA_50" AS s50, "SMA_200" AS s200, close / nullif(c63, 0) - 1e0 AS mom,
         "VOLATILITY_20" AS vol, count("VOLATILITY_20") OVER (PARTITION BY series ORDER BY session
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM averaged_index_bars""")
part("timeline", ("vols",), """
  SELECT *, CASE WHEN s50 IS NULL OR s200 IS NULL OR mom IS NULL OR vol IS NULL OR prior_valid < 126 THEN 'INSUFFICIENT_HISTORY'
    WHEN vol >= threshold THEN 'HIGH_VOLATILITY' WHEN close > s200 AND s50 > s200 AND mom > 0 THEN 'TRENDING_BULL'
    WHEN close < s200 AND s50 < s200 AND mom < 0 THEN 'TRENDING_BEAR' ELSE 'SIDEWAYS' END AS regime
  FROM (SELECT *, least(seen, 252) AS prior_valid, CASE WHEN seen >= 126 THEN
      (SELECT list_sort(list(p.vol))[CAST(ceil(0.80 * count(*)) AS BIGINT)] FROM vols p WHERE p.index_id = v.index_id
        AND p.vol IS NOT NULL AND p.session < v.session AND p.seen >= v.seen - 252) END AS threshold FROM vols v)""")


def timeline(s, p):
    return regimes.regime_timeline(src.benchmark_prices(s, p))


def texted(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


add("g1_vol_threshold",
    lambda s, p: texted(timeline(s, p).select("index_id", "session", F.col("prior_valid").cast("bigint").alias("prior_valid"),
                                              numbers.r8(F.col("threshold")).alias("threshold")), "session"),
    sql(f"SELECT index_id, {d('session')}, prior_valid, {r8('threshold')} AS threshold FROM timeline", "timeline"))
add("g2_regime",
    lambda s, p: texted(timeline(s, p).select("index_id", "session", "regime", F.array_join("reasons", ",").alias("reasons")),
                        "session"),
    sql(f"""SELECT index_id, {d('session')}, regime, CASE regime WHEN 'HIGH_VOLATILITY' THEN
        'VOLATILITY_20_AT_OR_ABOVE_PRIOR_NEAREST_RANK_THRESHOLD' WHEN 'TRENDING_BULL' THEN 'ALL_BULL_CONDITIONS_MET'
        WHEN 'TRENDING_BEAR' THEN 'ALL_BEAR_CONDITIONS_MET' WHEN 'SIDEWAYS' THEN 'NO_HIGH_VOLATILITY_OR_TREND_RULE_MATCH'
        ELSE concat_ws(',', CASE WHEN s50 IS NULL THEN 'MISSING_REQUIRED_INPUT:SMA_50' END,
          CASE WHEN s200 IS NULL THEN 'MISSING_REQUIRED_INPUT:SMA_200' END,
          CASE WHEN mom IS NULL THEN 'MISSING_REQUIRED_INPUT:MOM_3M_63D' END,
          CASE WHEN vol IS NULL THEN 'MISSING_REQUIRED_INPUT:VOLATILITY_20' END,
          CASE WHEN prior_valid < 126 THEN 'PRIOR_VOLATILITY_HISTORY_BELOW_126' END) END AS reasons FROM timeline""",
        "timeline"))
part("regime_runs", ("timeline",), """
  SELECT index_id, regime, grp, min(session) AS start, count(*) AS sessions FROM (
    SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY session)
            - row_number() OVER (PARTITION BY index_id, regime ORDER BY session) AS grp FROM timeline)
  GROUP BY index_id, regime, grp""")
add("g3_regime_transitions",
    lambda s, p: texted(regimes.regime_transitions(timeline(s, p)), "transition_date"),
    sql("""SELECT index_id, CAST(start AS VARCHAR) AS transition_date, previous, new, previous_sessions FROM (
             SELECT index_id, start, regime AS new, lag(regime) OVER w AS previous, lag(sessions) OVER w AS previous_sessions
             FROM regime_runs WINDOW w AS (PARTITION BY index_id ORDER BY start)) WHERE previous IS NOT NULL""", "regime_runs"))
CLASSES = ", ".join(f"('{r}')" for r in REGIMES)
add("g4_regime_distribution",
    lambda s, p: regimes.regime_distribution(timeline(s, p)),
    sql(f"""SELECT i.index_id, c.regime, count(t.session) AS sessions, CASE WHEN c.regime <> 'INSUFFICIENT_HISTORY' THEN
        {r8("count(t.session) / nullif((SELECT count(*) FROM timeline x WHERE x.index_id = i.index_id AND x.regime <> 'INSUFFICIENT_HISTORY'), 0)")} END AS share
        FROM (SELECT DISTINCT index_id FROM timeline) i CROSS JOIN (VALUES {CLASSES}) c(regime)
        LEFT JOIN timeline t ON t.index_id = i.index_id AND t.regime = c.regime GROUP BY i.index_id, c.regime""", "timeline"))
add("g5_current_regime",
    lambda s, p: texted(regimes.current_regime(timeline(s, p)), "start"),
    sql(f"""SELECT index_id, regime, {d('start')}, sessions FROM (SELECT *, row_number() OVER (PARTITION BY index_id
            ORDER BY start DESC) AS k FROM regime_runs) WHERE k = 1""", "regime_runs"))
add("g6_regime_coverage",
    lambda s, p: texted(regimes.regime_coverage(timeline(s, p)), "first_session", "last_session", "first_classified"),
    sql("""SELECT index_id, CAST(min(session) AS VARCHAR) AS first_session, CAST(max(session) AS VARCHAR) AS last_session,
           count(*) AS sessions, CAST(min(session) FILTER (WHERE regime <> 'INSUFFICIENT_HISTORY') AS VARCHAR) AS first_classified
           FROM timeline GROUP BY index_id""", "timeline"))
ATTRIBUTED = f""",
{CLOSED},
asia AS (SELECT session, regime FROM timeline WHERE index_id = 'ASIA'),
lab AS (SELECT x.*, coalesce(regime, 'INSUFFICIENT_HISTORY') AS label FROM decided x LEFT JOIN asia ON asia.session = x.signal
        UNION ALL SELECT *, 'OVERALL' FROM decided),
clab AS (SELECT x.*, coalesce(regime, 'INSUFFICIENT_HISTORY') AS label FROM closed x LEFT JOIN asia ON asia.session = x.signal
        UNION ALL SELECT *, 'OVERALL' FROM closed)"""


def attributed(s, p):
    return regimes.regime_attribution(decided(s, p), timeline(s, p).where(F.col("index_id") == "ASIA"))


ATT = ("signal_count", "executed_count", "winning", "losing", "breakeven", "win_rate", "gross_profit", "gross_loss",
       "total_net_pnl", "average_net_return", "percentile_50", "average_holding", "profit_factor", "expectancy",
       "average_win", "average_loss")
ATT_SQL = metrics_sql(labels=f"(SELECT label FROM (VALUES {CLASSES}, ('OVERALL')) v(label))")
add("g7_regime_attribution",
    lambda s, p: attributed(s, p).select("classification", *ATT),
    trade_sql(f"""SELECT label AS classification, coalesce(signal_count, 0) AS signal_count,
        coalesce(executed_count, 0) AS executed_count, {', '.join(ATT[2:])} FROM ({ATT_SQL})""", "timeline", more=ATTRIBUTED))
add("g7_attribution_reconciles",
    lambda s, p: regimes.attribution_reconciles(attributed(s, p)),
    trade_sql(f"""SELECT sum(executed_count) FILTER (WHERE label <> 'OVERALL') AS attributed_trades,
        sum(executed_count) FILTER (WHERE label = 'OVERALL') AS trades,
        {r8("sum(total_net_pnl) FILTER (WHERE label <> 'OVERALL')")} AS attributed_pnl,
        {r8("sum(total_net_pnl) FILTER (WHERE label = 'OVERALL')")} AS pnl,
        true AS trades_reconciled, true AS pnl_reconciled FROM ({ATT_SQL})""", "timeline", more=ATTRIBUTED))
ALL_INDICES = f""",
{CLOSED},
named AS (SELECT DISTINCT index_id FROM timeline),
lab AS (SELECT x.*, n.index_id || '/' || coalesce(t.regime, 'INSUFFICIENT_HISTORY') AS label FROM decided x CROSS JOIN named n
          LEFT JOIN timeline t ON t.index_id = n.index_id AND t.session = x.signal
        UNION ALL SELECT x.*, n.index_id || '/OVERALL' FROM decided x CROSS JOIN named n),
clab AS (SELECT x.*, n.index_id || '/' || coalesce(t.regime, 'INSUFFICIENT_HISTORY') AS label FROM closed x CROSS JOIN named n
           LEFT JOIN timeline t ON t.index_id = n.index_id AND t.session = x.signal
         UNION ALL SELECT x.*, n.index_id || '/OVERALL' FROM closed x CROSS JOIN named n)"""
ALL_SQL = metrics_sql(labels=f"(SELECT index_id || '/' || label AS label FROM named, (VALUES {CLASSES}, ('OVERALL')) v(label))")
add("g7_attribution_by_index",
    lambda s, p: regimes.attribution_by_index(decided(s, p), timeline(s, p)).select("index_id", "classification", *ATT),
    trade_sql(f"""SELECT split_part(label, '/', 1) AS index_id, split_part(label, '/', 2) AS classification, coalesce(signal_count, 0) AS signal_count,
        coalesce(executed_count, 0) AS executed_count, {', '.join(ATT[2:])} FROM ({ALL_SQL})""", "timeline", more=ALL_INDICES))
