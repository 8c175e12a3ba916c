"""Point-in-time look-ups (P) and corporate-action adjustment (A)."""

from __future__ import annotations

from catalog.features import out_columns, rounded, with_features
from catalog.sql import part, r8, sql
from pyspark.sql import functions as F

from tapewright.functions import numbers
from tapewright.operators import actions as act
from tapewright.operators import asof_features as af
from tapewright.operators import pit
from tapewright.sources import adapters as src

AS_OF = "1998-07-01 10:00:00"
SHORT = ("RET_20D", "SMA_20", "SMA_200", "EMA_20", "RSI_14", "ATR_PCT_14", "AVG_VOLUME_20", "BREAKOUT_PCT_20",
         "ABOVE_SMA_50")


def ts(text):
    return F.lit(text).cast("timestamp")


def text(df, *columns):
    """Dates and times as ISO text, so that both engines print them alike."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") if dict(df.dtypes)[c].startswith("timestamp")
                           else F.col(c).cast("string") for c in columns})


def iso(name):
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"


def d(name):
    return f"CAST({name} AS VARCHAR) AS {name}"


QUERIES, ORACLES = {}, {}


def register(name, query, oracle=None):
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


BAR_OUT = f"series, {d('session')}, open, high, low, close, volume"

register(
    "p01_prices_range",
    lambda s, p: text(pit.prices_range(src.bars(s, p), "1997-01-01", "1998-12-31").select(
        "series", "session", "open", "high", "low", "close", "volume"), "session"),
    sql(f"SELECT {BAR_OUT} FROM bars WHERE session BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'", "bars"))
register(
    "p02_latest_price_date",
    lambda s, p: text(pit.latest_price_date(src.bars(s, p)), "latest_session"),
    sql("SELECT CAST(max(session) AS VARCHAR) AS latest_session FROM bars", "bars"))
MEMBER = f"index_id, series, {d('valid_from')}, {d('valid_to')}"
register(
    "p03_members_as_of",
    lambda s, p: text(pit.members_as_of(src.memberships(s, p), "1999-07-05"), "valid_from", "valid_to"),
    sql(f"SELECT {MEMBER} FROM memberships WHERE valid_from <= DATE '1999-07-05' "
        "AND (valid_to IS NULL OR valid_to >= DATE '1999-07-05')", "memberships"))
register(
    "p04_memberships_between",
    lambda s, p: text(pit.memberships_between(src.memberships(s, p), "1999-07-05", "1999-12-27"), "valid_from",
                      "valid_to"),
    sql(f"SELECT {MEMBER} FROM memberships WHERE valid_from <= DATE '1999-12-27' "
        "AND (valid_to IS NULL OR valid_to >= DATE '1999-07-05')", "memberships"))
register(
    "p05_members_by_session",
    lambda s, p: text(pit.members_by_session(src.memberships(s, p), src.calendar(s, p)), "session"),
    sql(f"SELECT DISTINCT index_id, series, {d('session')} FROM memberships JOIN calendar c ON c.session >= valid_from "
        "AND (valid_to IS NULL OR c.session <= valid_to)", "memberships", "calendar"))
register(
    "p06_coverage_guard",
    lambda s, p: text(pit.coverage_guard(src.memberships(s, p), "1995-01-09"), "first_snapshot"),
    sql("SELECT index_id, CAST(min(valid_from) AS VARCHAR) AS first_snapshot, CASE WHEN min(valid_from) > "
        "DATE '1995-01-09' THEN 'HISTORICAL_MEMBERSHIP_NOT_COVERED' ELSE 'COVERED' END AS status "
        "FROM memberships GROUP BY index_id", "memberships"))
ACT = f"id, series, type, {d('ex_date')}, CAST(num AS DOUBLE) AS num, {iso('available_at')}, supersedes_id"


def action_out(df):
    return text(df.select("id", "series", "type", "ex_date", F.col("num").cast("double").alias("num"), "available_at",
                          "supersedes_id"), "ex_date", "available_at")


part("known_actions", ("actions",), f"""
  SELECT * FROM actions a WHERE available_at <= TIMESTAMP '{AS_OF}' AND NOT EXISTS (
    SELECT 1 FROM actions b WHERE b.supersedes_id = a.id AND b.available_at <= TIMESTAMP '{AS_OF}')""")
register(
    "p07_actions_as_of",
    lambda s, p: action_out(act.actions_as_of(src.actions(s, p), ts(AS_OF), "1997-01-01", "1998-06-30")),
    sql(f"SELECT {ACT} FROM known_actions WHERE ex_date > DATE '1997-01-01' AND ex_date <= DATE '1998-06-30'",
        "known_actions"))
register(
    "p08_resolve_revisions", lambda s, p: action_out(act.resolve_revisions(src.actions(s, p))),
    sql(f"SELECT {ACT} FROM actions WHERE id NOT IN (SELECT supersedes_id FROM actions WHERE supersedes_id IS NOT NULL)",
        "actions"))


def _broken_actions(s, p):
    rows = src.actions(s, p)
    k = F.col("series")
    return rows.withColumn("supersedes_id", F.when((F.col("type") == "DIVIDEND") & (k % 30 == 0), F.col("id"))
                           .when((F.col("type") == "BONUS") & (k % 20 == 5), (k + 10) * 10 + 2)
                           .when((F.col("type") == "STOCK_SPLIT") & (k % 20 == 0) & (F.col("id") % 10 == 0), k * 10 + 1)
                           .otherwise(F.col("supersedes_id")))


part("broken", ("actions",), """
  SELECT * REPLACE (CASE WHEN type = 'DIVIDEND' AND series % 30 = 0 THEN id
                         WHEN type = 'BONUS' AND series % 20 = 5 THEN (series + 10) * 10 + 2
                         WHEN type = 'STOCK_SPLIT' AND series % 20 = 0 AND id % 10 = 0 THEN series * 10 + 1
                         ELSE supersedes_id END AS supersedes_id) FROM actions""")
register(
    "p08_revision_violations",
    lambda s, p: act.revision_violations(_broken_actions(s, p)),
    sql("""SELECT id, 'SELF_LINK' AS violation FROM broken WHERE id = supersedes_id
           UNION ALL SELECT a.id, 'SERIES_CHANGED' FROM broken a JOIN broken b ON a.supersedes_id = b.id
             WHERE a.series <> b.series
           UNION ALL SELECT id, 'CYCLE' FROM broken WHERE id = supersedes_id
             OR (type = 'STOCK_SPLIT' AND series % 20 = 0)""", "broken"))
def _linked(s, p):
    """Actions whose later ones of the same series revise the earlier ones, giving chains of up to three."""
    rows = src.actions(s, p)
    k = F.col("series")
    return rows.withColumn("supersedes_id", F.when((F.col("type") == "DIVIDEND") & (k % 10 == 5), k * 10 + 2)
                           .when((F.col("type") == "DIVIDEND") & (k % 20 == 0), k * 10 + 1)
                           .otherwise(F.col("supersedes_id")))


part("linked", ("actions",), """
  SELECT * REPLACE (CASE WHEN type = 'DIVIDEND' AND series % 10 = 5 THEN series * 10 + 2
                         WHEN type = 'DIVIDEND' AND series % 20 = 0 THEN series * 10 + 1
                         ELSE supersedes_id END AS supersedes_id),
         CASE WHEN series % 10 = 5 AND type IN ('BONUS', 'DIVIDEND') THEN series * 10 + 2
              WHEN series % 20 = 0 THEN series * 10 ELSE id END AS root FROM actions""")
register(
    "p09_action_chain_closure",
    lambda s, p: action_out(act.chain_closure(_linked(s, p), "1997-12-31")),
    sql(f"""SELECT {ACT} FROM linked WHERE root IN (SELECT root FROM linked GROUP BY root
            HAVING min(ex_date) <= DATE '1997-12-31')""", "linked"))


register(
    "p10_report_as_of",
    lambda s, p: text(pit.report_as_of(src.reports(s, p), "1999-06-15"), "period_end", "reported_on", "effective_on"),
    sql(f"""SELECT entity, {d('period_end')}, {d('reported_on')}, {d('effective_on')}, cents FROM (SELECT *,
            row_number() OVER (PARTITION BY entity ORDER BY period_end DESC, effective_on DESC) AS k FROM reports
            WHERE reported_on <= DATE '1999-06-15' AND effective_on <= DATE '1999-06-15') WHERE k = 1""", "reports"))
part("eligible", ("filings",), """
  SELECT * FROM filings a WHERE available_at <= TIMESTAMP '2000-06-30 12:00:00' AND NOT EXISTS (
    SELECT 1 FROM filings b WHERE b.supersedes_id = a.filing_id AND b.available_at <= TIMESTAMP '2000-06-30 12:00:00')""")
FILING = f"filing_id, entity, {d('period_end')}, fiscal_year, fiscal_quarter, scope, {iso('available_at')}, cents"


def filing_out(df, *more):
    return text(df.select("filing_id", "entity", "period_end", "fiscal_year", "fiscal_quarter", "scope",
                          "available_at", "cents", *more), "period_end", "available_at")


def eligible(s, p):
    return pit.filings_as_of(src.filings(s, p), ts("2000-06-30 12:00:00"))


register("p11_filings_as_of", lambda s, p: filing_out(eligible(s, p)), sql(f"SELECT {FILING} FROM eligible", "eligible"))
part("scoped", ("eligible",), """
  SELECT *, NOT ex AS fallback_used FROM (
    SELECT *, bool_or(scope = 'CONSOLIDATED') OVER (PARTITION BY entity) AS ex FROM eligible)
  WHERE (ex AND scope = 'CONSOLIDATED') OR (NOT ex AND scope = 'STANDALONE')""")
register("p12_scope_fallback", lambda s, p: filing_out(pit.scope_fallback(eligible(s, p)), "fallback_used"),
         sql(f"SELECT {FILING}, fallback_used FROM scoped", "scoped"))
register(
    "p13_classification_as_of",
    lambda s, p: text(pit.classification_as_of(src.classifications(s, p), "2000-01-04", ts("2000-01-04 09:00:00")).drop(
        "available_at"), "snapshot_date"),
    sql(f"""SELECT series, macro, sector, industry, basic_industry, {d('snapshot_date')} FROM (SELECT *, row_number()
            OVER (PARTITION BY series ORDER BY snapshot_date DESC, available_at DESC) AS k FROM classifications
            WHERE snapshot_date <= DATE '2000-01-04' AND available_at <= TIMESTAMP '2000-01-04 09:00:00') WHERE k = 1""",
        "classifications"))
register(
    "p14_index_history_as_of",
    lambda s, p: text(pit.index_history_as_of(src.benchmark_prices(s, p), "OFFICIAL", ts("1999-03-08 12:00:00")).drop(
        "available_at"), "session"),
    sql(f"""SELECT index_id, {d('session')}, open, high, low, close, source_mode FROM benchmark_prices
            WHERE source_mode = 'OFFICIAL' AND available_at <= TIMESTAMP '1999-03-08 12:00:00'""", "benchmark_prices"))
register(
    "p15_index_coverage",
    lambda s, p: text(pit.index_coverage(src.benchmark_prices(s, p)), "first_session", "last_session", "nth_session"),
    sql(f"""SELECT index_id, source_mode, CAST(min(session) AS VARCHAR) AS first_session,
            CAST(max(session) AS VARCHAR) AS last_session, count(*) AS sessions,
            CAST(min(session) FILTER (WHERE k = 200) AS VARCHAR) AS nth_session FROM (SELECT *, row_number() OVER (
            PARTITION BY index_id, source_mode ORDER BY session) AS k FROM benchmark_prices) GROUP BY 1, 2""",
        "benchmark_prices"))
register(
    "p16_trading_days",
    lambda s, p: text(pit.trading_days(src.full_calendar(s, p), "1996-01-01", "1999-12-31").select(
        "exchange", "session"), "session"),
    sql(f"""SELECT exchange, {d('session')} FROM full_calendar WHERE is_trading_day
            AND session BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""", "full_calendar"))


def _neighbours(s, p):
    days = src.table(s, p, "orders").select(F.lit("X").alias("exchange"), F.to_date("o_orderdate").alias("day"))
    return text(pit.session_neighbours(days, src.full_calendar(s, p)), "day", "prev_session", "next_session")


register("p17_session_neighbours", _neighbours, sql("""
  SELECT 'X' AS exchange, CAST(day AS VARCHAR) AS day, coalesce((SELECT is_trading_day FROM full_calendar c
         WHERE c.session = day), false) AS is_session,
         CAST((SELECT max(session) FROM full_calendar c WHERE is_trading_day AND c.session < day) AS VARCHAR) AS prev_session,
         CAST((SELECT min(session) FROM full_calendar c WHERE is_trading_day AND c.session > day) AS VARCHAR) AS next_session
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)""", "full_calendar"))
register(
    "p18_session_index",
    lambda s, p: text(pit.session_index(src.full_calendar(s, p), "1996-01-01").select("exchange", "session", F.col(
        "idx").cast("bigint").alias("idx")), "session"),
    sql(f"""SELECT exchange, {d('session')}, row_number() OVER (PARTITION BY exchange ORDER BY session) - 1 AS idx
            FROM full_calendar WHERE is_trading_day AND session >= DATE '1996-01-01'""", "full_calendar"))
part("timed", ("bars", "calendar"), """
  SELECT b.*, session + to_seconds(coalesce(open_s, 33300)) - INTERVAL 330 MINUTE AS opens_at,
         session + to_seconds(coalesce(close_s, 86399)) - INTERVAL 330 MINUTE AS available_at
  FROM bars b LEFT JOIN calendar USING (session)""")
register(
    "p19_available_at",
    lambda s, p: text(pit.with_session_times(src.bars(s, p).select("series", "session"), src.calendar(s, p), "X"),
                      "session", "opens_at", "available_at"),
    sql(f"SELECT series, {d('session')}, {iso('opens_at')}, {iso('available_at')} FROM timed", "timed"))
register(
    "p20_knowledge_gate",
    lambda s, p: action_out(pit.known_by(src.actions(s, p), ts("1998-05-25 04:30:00"), naive=True)),
    sql(f"SELECT {ACT} FROM actions WHERE available_at - INTERVAL 330 MINUTE <= TIMESTAMP '1998-05-25 04:30:00'",
        "actions"))
register(
    "p21_security_search",
    lambda s, p: pit.security_search(src.securities(s, p), "s00000000", 1, 5).select("series", "symbol", "total"),
    sql("""SELECT series, symbol, (SELECT count(*) FROM securities WHERE symbol ILIKE '%s00000000%'
           OR company_name ILIKE '%s00000000%') AS total FROM securities WHERE symbol ILIKE '%s00000000%'
           OR company_name ILIKE '%s00000000%' ORDER BY symbol LIMIT 5""", "securities"))
register(
    "p22_latest_run",
    lambda s, p: text(pit.latest_run(src.runs(s, p), ["purchase_TYPE_1", "purchase_TYPE_2"]).select(
        "run_id", "dataset_code", "status", "completed_at"), "completed_at"),
    sql(f"""SELECT run_id, dataset_code, status, {iso('completed_at')} FROM runs WHERE status IN ('SUCCEEDED', 'PARTIAL')
            ORDER BY CASE WHEN dataset_code IN ('purchase_TYPE_1', 'purchase_TYPE_2') THEN 0 ELSE 1 END,
            runs.completed_at DESC, started_at DESC LIMIT 1""", "runs"))
register(
    "p23_latest_per_group",
    lambda s, p: text(pit.latest_per_group(src.artifact_log(s, p), ["provider", "artifact_type"], F.col("imported_at"),
                                           F.col("artifact_id")).select(
        "provider", "artifact_type", "artifact_id", "imported_at", "status"), "imported_at"),
    sql(f"""SELECT provider, artifact_type, artifact_id, {iso('imported_at')}, status FROM (SELECT *, row_number() OVER (
            PARTITION BY provider, artifact_type ORDER BY imported_at DESC, artifact_id DESC) AS k FROM artifact_log)
            WHERE k = 1""", "artifact_log"))
register(
    "p24_lookup_by_name",
    lambda s, p: pit.lookup_by_name(src.securities(s, p), "SUPPLIER#000000007", "symbol", "company_name").select(
        "series", "symbol", "company_name", "sector"),
    sql("""SELECT series, symbol, company_name, sector FROM securities WHERE lower(symbol) = lower('SUPPLIER#000000007')
           OR lower(company_name) = lower('SUPPLIER#000000007')""", "securities"))

# --- A: adjustment --------------------------------------------------------------------------------------------
FACTOR_SQL = """CASE type WHEN 'STOCK_SPLIT' THEN CAST(den AS DOUBLE) / CAST(num AS DOUBLE)
  WHEN 'BONUS' THEN CAST(den AS DOUBLE) / (CAST(den AS DOUBLE) + CAST(num AS DOUBLE)) ELSE 1e0 END"""
register(
    "a1_action_factor",
    lambda s, p: act.action_factor(src.actions(s, p)).select(
        "id", "series", "type", numbers.r8(F.col("factor").cast("double")).alias("factor")),
    sql(f"SELECT id, series, type, {r8(FACTOR_SQL)} AS factor FROM actions", "actions"))


def adjusted_part(name, base, acts, cond="true"):
    part(name, (base, acts), f"""
      SELECT * REPLACE (CAST(floor(open * f + 0.5e0) AS BIGINT) AS open, CAST(floor(high * f + 0.5e0) AS BIGINT) AS high,
                        CAST(floor(low * f + 0.5e0) AS BIGINT) AS low, CAST(floor(close * f + 0.5e0) AS BIGINT) AS close,
                        CAST(floor(volume / f + 0.5e0) AS BIGINT) AS volume)
      FROM (SELECT b.*, coalesce((SELECT product({FACTOR_SQL}) FROM {acts} a WHERE a.series = b.series
            AND type IN ('STOCK_SPLIT', 'BONUS') AND b.session < a.ex_date AND {cond}), 1e0) AS f FROM {base} b)""")


part("resolved_actions", ("actions",), """
  SELECT * FROM actions WHERE id NOT IN (SELECT supersedes_id FROM actions WHERE supersedes_id IS NOT NULL)""")
adjusted_part("adjusted", "bars", "resolved_actions")
register(
    "a2_adjust_prices",
    lambda s, p: text(act.adjust_prices(src.bars(s, p), act.resolve_revisions(src.actions(s, p))).select(
        "series", "session", "open", "high", "low", "close", "volume",
        numbers.r8(F.col("adjustment_factor").cast("double")).alias("factor")), "session"),
    sql(f"SELECT {BAR_OUT}, {r8('f')} AS factor FROM adjusted", "adjusted"))
part("shown", ("bars",), "SELECT *, min(session) OVER (PARTITION BY series) AS lo, max(session) OVER (PARTITION BY series)"
     " AS hi FROM bars WHERE session BETWEEN DATE '1997-03-01' AND DATE '1998-12-31'")
adjusted_part("shown_adjusted", "shown", "known_actions", "a.ex_date > b.lo AND a.ex_date <= b.hi")
register(
    "a3_adjusted_view",
    lambda s, p: text(act.adjusted_view(src.bars(s, p), src.actions(s, p), ts(AS_OF), "1997-03-01", "1998-12-31").select(
        "series", "session", "open", "high", "low", "close", "volume"), "session"),
    sql(f"SELECT {BAR_OUT} FROM shown_adjusted", "shown_adjusted"))


# one regime number per (series, what counts that day); history repeated per regime, folded into the key
REGIMES = f"""
  SELECT t.*, coalesce((SELECT string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY a.ex_date, a.available_at, a.id)
           FROM actions a WHERE a.series = t.series AND a.type IN ('STOCK_SPLIT', 'BONUS') AND a.ex_date <= t.session
             AND a.available_at <= t.available_at AND NOT EXISTS (SELECT 1 FROM actions b WHERE b.supersedes_id = a.id
             AND b.available_at <= t.available_at)), '') AS regime
  FROM timed t"""
part("regimes", ("timed", "actions"), REGIMES)
part("regimes_request", ("timed", "known_actions"), f"""
  SELECT t.*, coalesce((SELECT string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY a.ex_date, a.available_at, a.id)
           FROM known_actions a WHERE a.series = t.series AND a.type IN ('STOCK_SPLIT', 'BONUS')
           AND a.ex_date <= t.session), '') AS regime
  FROM timed t WHERE session <= DATE '1998-07-01'""")


def exploded(name, source):
    part(f"{name}_list", (source,), f"""
      SELECT series AS s, regime AS r, max(session) AS until, row_number() OVER (ORDER BY series, regime) AS rid
      FROM {source} GROUP BY series, regime""")
    part(name, (source, f"{name}_list", "actions"), f"""
      SELECT * EXCLUDE (series, open, high, low, close, volume, regime, available_at, opens_at, s, r, until), rid AS series,
             CAST(floor(open * f + 0.5e0) AS BIGINT) AS open, CAST(floor(high * f + 0.5e0) AS BIGINT) AS high,
             CAST(floor(low * f + 0.5e0) AS BIGINT) AS low, CAST(floor(close * f + 0.5e0) AS BIGINT) AS close,
             CAST(floor(volume / f + 0.5e0) AS BIGINT) AS volume
      FROM (SELECT t.*, l.*, coalesce((SELECT product({FACTOR_SQL}) FROM actions a WHERE a.series = t.series
              AND list_contains(string_split(l.r, ','), CAST(a.id AS VARCHAR)) AND t.session < a.ex_date), 1e0) AS f
            FROM {source} t JOIN {name}_list l ON l.s = t.series AND t.session <= l.until)""")


exploded("per_regime", "regimes")
exploded("per_regime_request", "regimes_request")


def pit_sql(name, source, where="true"):
    return with_features(f"""
      SELECT t.series, CAST(t.session AS VARCHAR) AS session, f.n_obs, {iso('available_at')}, {out_columns(SHORT)}
      FROM features f JOIN {name}_list l ON f.series = l.rid JOIN {source} t
        ON t.series = l.s AND t.regime = l.r AND t.session = f.session WHERE {where}""", base=name)


def pit_out(df):
    return rounded(text(df, "session", "available_at"), SHORT)


register(
    "a4_fx6_historical_features",
    lambda s, p: pit_out(af.historical_features(src.bars(s, p), src.calendar(s, p), src.actions(s, p),
                                                start="1995-01-01", end="2001-12-31", codes=SHORT).drop("regime_id")),
    pit_sql("per_regime", "regimes"))
register(
    "fx2_feature_series",
    lambda s, p: pit_out(af.feature_series(src.bars(s, p), src.calendar(s, p), src.actions(s, p), as_of=ts(AS_OF),
                                           start="1997-06-01", codes=SHORT).drop("regime_id")),
    pit_sql("per_regime_request", "regimes_request",
            f"t.session >= DATE '1997-06-01' AND available_at <= TIMESTAMP '{AS_OF}'"))
part("usable", ("timed",), f"""SELECT *, max(session) OVER (PARTITION BY series) AS hi FROM timed
     WHERE session <= DATE '1998-07-01' AND available_at <= TIMESTAMP '{AS_OF}'""")
adjusted_part("usable_adjusted", "usable", "known_actions", "a.ex_date <= b.hi")
register(
    "fx3_latest_features",
    lambda s, p: pit_out(af.latest_features(src.bars(s, p), src.calendar(s, p), src.actions(s, p), as_of=ts(AS_OF),
                                            codes=SHORT)),
    with_features(f"""
      SELECT f.series, CAST(f.session AS VARCHAR) AS session, f.n_obs, {iso('available_at')}, {out_columns(SHORT)}
      FROM features f JOIN usable u ON u.series = f.series AND u.session = f.session WHERE f.session = hi""",
        base="usable_adjusted"))
register(
    "fx5_missing_session_warning",
    lambda s, p: af.missing_session_warning(src.bars(s, p), src.calendar(s, p)).select(
        "series", F.col("missing").cast("bigint").alias("missing"), "warning"),
    sql("""SELECT series, count(*) AS missing, 'Missing expected trading sessions: ' ||
             array_to_string(list_slice(list(CAST(session AS VARCHAR) ORDER BY session), 1, 8), ', ') ||
             CASE WHEN count(*) > 8 THEN ' (+' || CAST(count(*) - 8 AS VARCHAR) || ' more)' ELSE '' END AS warning
           FROM (SELECT series, c.session FROM (SELECT series, min(session) AS lo FROM bars GROUP BY series) x
                 JOIN calendar c ON c.session >= lo EXCEPT SELECT series, session FROM bars) GROUP BY series""",
        "bars", "calendar"))
