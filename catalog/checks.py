"""Quality and coverage (Q1-Q16). Defects are injected by rule, so both engines see the same ones."""

from __future__ import annotations

from catalog.lookups import d, iso
from catalog.sql import part, sql
from pyspark.sql import functions as F

from tapewright.operators import quality as q
from tapewright.sources import adapters as src

QUERIES, ORACLES = {}, {}


def add(name, query, oracle):
    QUERIES[name], ORACLES[name] = query, oracle


def text(df, *columns):
    types = dict(df.dtypes)
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") if types[c].startswith("timestamp")
                           else F.col(c).cast("string") for c in columns})


def dirty(s, p):
    """Bars with broken rows and repeated keys."""
    bars = src.bars(s, p).select("series", "session", "open", "high", "low", "close", "volume")
    k = F.col("series") * 7 + F.datediff("session", src.day(src.FIRST_MONDAY)) / 7
    k = k.cast("bigint")
    bad = bars.withColumns({
        "high": F.when(k % 97 == 1, F.col("low") - 1).otherwise(F.col("high")),
        "open": F.when(k % 89 == 2, -F.col("open")).otherwise(F.col("open")),
        "volume": F.when(k % 83 == 3, -F.col("volume")).otherwise(F.col("volume")),
    })
    return bad.unionByName(bad.where(k % 101 == 4))


part("dirty0", ("bars",), """SELECT *, series * 7 + (session - DATE '1995-01-02') // 7 AS k FROM bars""")
part("dirty1", ("dirty0",), """SELECT series, session, CASE WHEN k % 89 = 2 THEN -open ELSE open END AS open,
  CASE WHEN k % 97 = 1 THEN low - 1 ELSE high END AS high, low, close, CASE WHEN k % 83 = 3 THEN -volume ELSE volume END AS volume, k
  FROM dirty0""")
part("dirty", ("dirty1",), "SELECT * FROM dirty1 UNION ALL SELECT * FROM dirty1 WHERE k % 101 = 4")


def check_sql(name, count, bad, body, *needs):
    return f"SELECT '{name}' AS \"check\", CASE WHEN ({count}) > 0 THEN '{bad}' ELSE 'HEALTHY' END AS status, CAST({count} AS BIGINT) AS issue_count {body}"


FLAGS = """coalesce(sum(CAST(open < 0 OR high < 0 OR low < 0 OR close < 0 AS INTEGER) + CAST(high < low AS INTEGER)
  + CAST(open < low OR open > high AS INTEGER) + CAST(close < low OR close > high AS INTEGER) + CAST(volume < 0 AS INTEGER)), 0)"""
Q1 = check_sql("OHLC validation", FLAGS, "FAILED", "FROM dirty")
Q2 = check_sql("Duplicate detection", "count(*)", "FAILED",
               "FROM (SELECT series, session FROM dirty GROUP BY ALL HAVING count(*) > 1)")
part("missing_per", ("bars", "securities", "full_calendar"), """
  SELECT series, greatest(0, (SELECT count(*) FROM full_calendar c WHERE is_trading_day AND c.session BETWEEN lo AND hi) - seen) AS missing
  FROM (SELECT b.series, min(b.session) AS lo, max(b.session) AS hi, count(c.session) AS seen FROM bars b
        JOIN securities s ON s.series = b.series AND is_active LEFT JOIN full_calendar c ON c.session = b.session AND c.is_trading_day
        GROUP BY b.series)""")
Q3 = check_sql("Session coverage", "coalesce(sum(missing), 0)", "WARNING", "FROM missing_per")
Q4 = check_sql("Calendar evidence", "count(DISTINCT session)", "WARNING",
               "FROM bars WHERE session NOT IN (SELECT session FROM full_calendar)")
Q5 = """SELECT 'Freshness' AS "check", CASE WHEN cal IS NULL THEN 'FAILED' WHEN DATE '{day}' - cal > 7 THEN 'WARNING'
  WHEN stale > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS status,
  CASE WHEN cal IS NULL OR DATE '{day}' - cal > 7 THEN 1 ELSE stale END AS issue_count FROM (
  SELECT max(session) AS cal, count(*) FILTER (WHERE session > (SELECT max(session) FROM {bars})) AS stale
  FROM full_calendar WHERE is_trading_day AND session <= DATE '{day}')"""
part("early", ("bars",), "SELECT * FROM bars WHERE session < DATE '2001-09-03'")
add("q01_ohlc_violations", lambda s, p: q.ohlc_violations(dirty(s, p)), sql(Q1, "dirty"))
add("q02_duplicate_keys", lambda s, p: q.duplicate_keys(dirty(s, p)), sql(Q2, "dirty"))
add("q03_missing_sessions", lambda s, p: q.missing_sessions(src.bars(s, p), src.securities(s, p), src.full_calendar(s, p)),
    sql(Q3, "missing_per"))
add("q03_missing_per_series",
    lambda s, p: q.missing_per_series(src.bars(s, p), src.securities(s, p), src.full_calendar(s, p)),
    sql("SELECT series, missing FROM missing_per", "missing_per"))
add("q04_unknown_calendar", lambda s, p: q.unknown_calendar(src.bars(s, p), src.securities(s, p), src.full_calendar(s, p)),
    sql(Q4, "bars", "full_calendar"))
add("q05_freshness",
    lambda s, p: q.freshness(src.bars(s, p).where("session < '2001-09-03'"), src.full_calendar(s, p), "2001-11-01"),
    sql(Q5.format(day="2001-11-01", bars="early"), "early", "full_calendar"))


def issues(s, p):
    e = src.table(s, p, "events")
    codes = F.array(*[F.lit(c) for c in (*q.MEMBERSHIP_ISSUES, *q.ACTION_ISSUES, "INVALID_OHLCV_ROW")])
    return e.select(F.col("event_id").alias("issue_id"), F.element_at(codes, (F.col("event_id") % 9 + 1).cast("int")).alias("code"),
                    F.col("ts").cast("timestamp").alias("created_at"))


def action_origins(s, p):
    return src.actions(s, p).select(
        F.when(F.col("series") % 4 == 0, "DEMO").otherwise("OFFICIAL").alias("origin"),
        F.when(F.col("id") % 10 != 3, F.col("available_at")).alias("available_at"))


ISSUE_CODES = ", ".join(f"'{c}'" for c in (*q.MEMBERSHIP_ISSUES, *q.ACTION_ISSUES, "INVALID_OHLCV_ROW"))
part("issues", (), f"SELECT event_id AS issue_id, [{ISSUE_CODES}][event_id % 9 + 1] AS code, ts AS created_at FROM events")
part("action_origins", ("actions",), """SELECT CASE WHEN series % 4 = 0 THEN 'DEMO' ELSE 'OFFICIAL' END AS origin,
  CASE WHEN id % 10 <> 3 THEN available_at END AS available_at FROM actions""")


def health(s, p):
    return q.artifact_health(src.artifact_log(s, p)).unionByName(q.issue_health(issues(s, p), action_origins(s, p)))


def inlist(codes):
    return ", ".join(f"'{c}'" for c in codes)


BARE = "(SELECT count(*) FROM action_origins WHERE origin = 'OFFICIAL' AND available_at IS NULL)"
Q6 = f"""
  SELECT 'Source artifacts' AS "check", CASE WHEN count(*) FILTER (WHERE status IN ('FAILED', 'CONFLICT')) > 0 THEN 'FAILED'
    WHEN count(*) FILTER (WHERE status = 'PARTIAL') > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS status,
    count(*) FILTER (WHERE status IN ('FAILED', 'CONFLICT', 'PARTIAL')) AS issue_count FROM artifact_log
  UNION ALL {check_sql('Index membership ingestion', f"count(*) FILTER (WHERE code IN ({inlist(q.MEMBERSHIP_ISSUES)}))", 'WARNING', 'FROM issues')}
  UNION ALL SELECT 'Corporate-action PIT coverage', CASE WHEN {BARE} > 0 THEN 'FAILED' WHEN count(*) > 0 THEN 'WARNING' ELSE 'HEALTHY' END,
    {BARE} + count(*) FROM issues WHERE code IN ({inlist(q.ACTION_ISSUES)})"""
add("q06_ingest_health", health, sql(Q6, "artifact_log", "issues", "action_origins"))


def _overall(s, p):
    bars, sec, cal = src.bars(s, p), src.securities(s, p), src.full_calendar(s, p)
    return q.overall_status(
        q.ohlc_violations(bars), q.duplicate_keys(bars), q.missing_sessions(bars, sec, cal), q.unknown_calendar(bars, sec, cal),
        q.freshness(bars, cal, "2001-11-08"), q.artifact_health(src.artifact_log(s, p).where("status <> 'FAILED'")))


Q7 = " UNION ALL ".join([
    check_sql("OHLC validation", FLAGS, "FAILED", "FROM bars"),
    check_sql("Duplicate detection", "count(*)", "FAILED", "FROM (SELECT series, session FROM bars GROUP BY ALL HAVING count(*) > 1)"),
    Q3, Q4, Q5.format(day="2001-11-08", bars="bars"),
    """SELECT 'Source artifacts', CASE WHEN count(*) FILTER (WHERE status = 'CONFLICT') > 0 THEN 'FAILED' ELSE 'WARNING' END, 1
       FROM artifact_log WHERE status <> 'FAILED'"""])
add("q07_overall_status", _overall, sql(f"""
  SELECT CASE max(CASE status WHEN 'FAILED' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAILED' WHEN 1 THEN 'WARNING'
    ELSE 'HEALTHY' END AS status, count(*) AS checks, count(*) FILTER (WHERE status <> 'HEALTHY') AS not_healthy FROM ({Q7})""",
    "missing_per", "bars", "full_calendar", "artifact_log"))
add("q08_origin_mode", lambda s, p: q.origin_mode(src.securities(s, p), action_origins(s, p)), sql("""
  SELECT count(*) FILTER (WHERE origin = 'OFFICIAL') AS official, count(*) FILTER (WHERE origin = 'DEMO') AS demo,
    count(*) FILTER (WHERE origin = 'UNKNOWN') AS "unknown", 'MIXED' AS mode
  FROM (SELECT origin FROM securities UNION ALL SELECT origin FROM action_origins)""", "securities", "action_origins"))
add("q09_price_coverage",
    lambda s, p: text(q.price_coverage(src.bars(s, p), src.securities(s, p)), "first_session", "last_session"), sql("""
  SELECT count(*) AS rows, count(DISTINCT session) AS sessions, CAST(min(session) AS VARCHAR) AS first_session,
    CAST(max(session) AS VARCHAR) AS last_session, count(DISTINCT series) AS series FROM bars JOIN securities USING (series)
  WHERE origin = 'OFFICIAL'""", "bars", "securities"))


def _gaps(s, p):
    bars = src.bars(s, p).where(F.dayofmonth("session") % 7 != 3)
    index = src.benchmark_prices(s, p).where(F.dayofmonth("session") % 11 != 5)
    return q.session_gaps(bars, src.full_calendar(s, p), index)


part("few_days", ("bars",), "SELECT DISTINCT session FROM bars WHERE day(session) % 7 <> 3")
part("index_days", ("benchmark_prices",), "SELECT DISTINCT session FROM benchmark_prices WHERE day(session) % 11 <> 5")
add("q10_session_gaps", _gaps, sql("""
  SELECT (SELECT count(*) FROM full_calendar c WHERE is_trading_day AND NOT EXISTS (SELECT 1 FROM few_days x WHERE x.session = c.session))
      AS sessions_without_prices,
    (SELECT count(*) FROM index_days i WHERE NOT EXISTS (SELECT 1 FROM few_days x WHERE x.session = i.session)) AS benchmark_without_prices,
    (SELECT count(*) FROM full_calendar c WHERE is_trading_day AND c.session BETWEEN (SELECT min(session) FROM index_days)
      AND (SELECT max(session) FROM index_days) AND NOT EXISTS (SELECT 1 FROM index_days x WHERE x.session = c.session))
      AS sessions_without_benchmark""", "full_calendar", "few_days", "index_days"))
add("q11_member_history_depth",
    lambda s, p: q.member_history_depth(src.memberships(s, p), src.bars(s, p), "1995-01-09"), sql("""
  SELECT m.index_id, count(*) AS members, count(*) FILTER (WHERE n > 0) AS with_any, count(*) FILTER (WHERE n >= 200) AS with_200,
    count(*) FILTER (WHERE n >= 252) AS with_252, count(*) FILTER (WHERE lo <= DATE '1995-01-09' AND hi = (SELECT max(session) FROM bars))
      AS with_target, count(*) FILTER (WHERE (SELECT count(DISTINCT session) FROM bars) >= 20
      AND n < floor((SELECT count(DISTINCT session) FROM bars) * 0.95)) AS significant_gaps
  FROM (SELECT DISTINCT index_id, series FROM memberships x WHERE valid_from = (SELECT max(valid_from) FROM memberships y
        WHERE y.index_id = x.index_id)) m
  LEFT JOIN (SELECT series, count(*) AS n, min(session) AS lo, max(session) AS hi FROM bars GROUP BY series) b USING (series)
  GROUP BY m.index_id""", "memberships", "bars"))


def _fund(s, p):
    return text(q.fundamental_coverage(src.filings(s, p), src.facts(s, p), F.col("source_concept") != "Order Backlog"),
                "first_period", "last_period", "first_available", "last_available")


add("q12_fundamental_coverage", _fund, sql(f"""
  SELECT count(*) AS filings, count(DISTINCT entity) AS entities, count(*) FILTER (WHERE scope = 'CONSOLIDATED') AS consolidated,
    count(*) FILTER (WHERE scope = 'STANDALONE') AS standalone, CAST(min(period_end) AS VARCHAR) AS first_period,
    CAST(max(period_end) AS VARCHAR) AS last_period, strftime(min(available_at), '%Y-%m-%d %H:%M:%S') AS first_available,
    strftime(max(available_at), '%Y-%m-%d %H:%M:%S') AS last_available, (SELECT count(*) FROM facts) AS facts,
    (SELECT count(*) FROM facts WHERE source_concept <> 'Order Backlog') AS mapped,
    (SELECT count(*) FROM facts WHERE source_concept = 'Order Backlog') AS unmapped FROM filings""", "filings", "facts"))


def _benchmarks(s, p):
    return src.table(s, p, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("sector"))


add("q13_classification_coverage",
    lambda s, p: text(q.classification_coverage(src.classifications(s, p), src.memberships(s, p).where("valid_to IS NULL"),
                                                _benchmarks(s, p)), "last_snapshot"), sql("""
  SELECT count(*) AS rows, count(DISTINCT series) AS classified, CAST(max(snapshot_date) AS VARCHAR) AS last_snapshot,
    (SELECT count(DISTINCT series) FROM classifications WHERE series IN (SELECT series FROM memberships WHERE valid_to IS NULL))
      AS members_classified,
    (SELECT count(*) FROM classifications WHERE sector IN (SELECT n_name FROM nation WHERE n_nationkey % 3 = 0)) AS benchmark_mappings
  FROM classifications""", "classifications", "memberships"))
add("q14_membership_coverage",
    lambda s, p: text(q.membership_coverage(src.memberships(s, p)), "first_snapshot", "last_snapshot"), sql("""
  SELECT index_id, CAST(min(valid_from) AS VARCHAR) AS first_snapshot, CAST(max(valid_from) AS VARCHAR) AS last_snapshot,
    count(DISTINCT valid_from) AS snapshots, count(*) FILTER (WHERE valid_from = hi) AS latest_members,
    CASE WHEN count(DISTINCT valid_from) = 1 THEN 'CURRENT_SNAPSHOT_ONLY' ELSE 'BOUNDED_SNAPSHOT_SEQUENCE' END AS kind
  FROM (SELECT *, max(valid_from) OVER (PARTITION BY index_id) AS hi FROM memberships) GROUP BY index_id""", "memberships"))


def named_indices(s, p):
    """Regions and nations: every one of them could be an index; only regions have members."""
    rows = src.securities(s, p)
    return rows.select(F.col("macro").alias("index_id")).unionByName(rows.select(F.col("sector").alias("index_id")))


add("q14_coverage_of_named_indices",
    lambda s, p: text(q.membership_coverage(src.memberships(s, p), named_indices(s, p)), "first_snapshot", "last_snapshot"), sql("""
  SELECT i.index_id, CAST(min(valid_from) AS VARCHAR) AS first_snapshot, CAST(max(valid_from) AS VARCHAR) AS last_snapshot,
    count(DISTINCT valid_from) AS snapshots, count(*) FILTER (WHERE valid_from = hi) AS latest_members,
    CASE count(DISTINCT valid_from) WHEN 0 THEN 'NONE' WHEN 1 THEN 'CURRENT_SNAPSHOT_ONLY' ELSE 'BOUNDED_SNAPSHOT_SEQUENCE' END AS kind
  FROM (SELECT macro AS index_id FROM securities UNION SELECT sector FROM securities) i
  LEFT JOIN (SELECT *, max(valid_from) OVER (PARTITION BY index_id) AS hi FROM memberships) m ON m.index_id = i.index_id GROUP BY i.index_id""", "memberships", "securities"))
READY_RULES = {
    "SECURITY_MASTER": ("n > 0 AND share = 1", "n > 0"), "MEMBERSHIP": ("n >= 2 AND share >= 0.5", "n > 0"),
    "EQUITY_EOD": ("n >= 252", "n > 0"), "BENCHMARK": ("n >= 252 AND share >= 0.75", "n > 0 AND share > 0")}


def measured(s, p):
    """n and share of each data set: active master rows, indices with several snapshots, sessions with prices, official benchmark rows."""
    part_of = lambda cond: (F.count_if(cond) / F.count(F.lit(1))).alias("share")
    code = lambda df, name: df.select(F.lit(name).alias("code"), "n", "share")
    one = F.count(F.lit(1)).alias("n")
    several = q.membership_coverage(src.memberships(s, p)).agg(one, part_of(F.col("snapshots") > 1))
    sessions = src.bars(s, p).agg(F.count_distinct("session").alias("n"), F.lit(1.0).alias("share"))
    return (code(src.securities(s, p).agg(one, part_of(F.col("is_active"))), "SECURITY_MASTER").unionByName(code(several, "MEMBERSHIP"))
            .unionByName(code(sessions, "EQUITY_EOD")).unionByName(code(src.benchmark_prices(s, p).agg(one, part_of(F.col("source_mode") == "OFFICIAL")), "BENCHMARK")))


add("q15_readiness_by_own_rules",
    lambda s, p: q.dataset_readiness(measured(s, p), READY_RULES).select("code", "n", "status"), sql("""
  SELECT code, n, CASE WHEN full_ THEN 'READY' WHEN some_ THEN 'PARTIAL' ELSE 'UNAVAILABLE' END AS status FROM (
    SELECT 'SECURITY_MASTER' AS code, count(*) AS n, count(*) > 0 AND bool_and(is_active) AS full_, count(*) > 0 AS some_ FROM securities
    UNION ALL SELECT 'MEMBERSHIP', count(*), count(*) >= 2 AND 2 * count(*) FILTER (WHERE k > 1) >= count(*), count(*) > 0
      FROM (SELECT index_id, count(DISTINCT valid_from) AS k FROM memberships GROUP BY index_id)
    UNION ALL SELECT 'EQUITY_EOD', count(DISTINCT session), count(DISTINCT session) >= 252, count(DISTINCT session) > 0 FROM bars
    UNION ALL SELECT 'BENCHMARK', count(*), count(*) >= 252 AND 4 * count(*) FILTER (WHERE source_mode = 'OFFICIAL') >= 3 * count(*),
      count(*) FILTER (WHERE source_mode = 'OFFICIAL') > 0 FROM benchmark_prices)""", "securities", "memberships", "bars", "benchmark_prices"))


def _ready(s, p):
    counts = [
        src.securities(s, p).where("origin = 'OFFICIAL'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("SECURITY_MASTER").alias("code"), "n"),
        src.memberships(s, p).where("valid_to IS NULL").agg(F.count(F.lit(1)).alias("n")).select(F.lit("MEMBERSHIP").alias("code"), "n"),
        src.bars(s, p).agg(F.count(F.lit(1)).alias("n")).select(F.lit("EQUITY_EOD").alias("code"), "n"),
        src.benchmark_prices(s, p).where("source_mode = 'NONE'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("BENCHMARK").alias("code"), "n"),
    ]
    rows = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
    sets = q.readiness(rows, F.col("n") >= 252, F.col("n") > 0)
    whole = q.overall_readiness(sets).select(F.lit("OVERALL").alias("code"), F.col("datasets").alias("n"), "status")
    return sets.unionByName(whole)


add("q15_dataset_readiness", _ready, sql("""
  SELECT * FROM sets UNION ALL SELECT 'OVERALL', count(*), CASE WHEN count(*) = count(*) FILTER (WHERE status = 'READY') THEN 'READY'
    WHEN count(*) = count(*) FILTER (WHERE status = 'UNAVAILABLE') THEN 'UNAVAILABLE' ELSE 'PARTIAL' END FROM sets""", "sets")
    if part("sets", ("securities", "memberships", "bars", "benchmark_prices"), """
  SELECT code, n, CASE WHEN n >= 252 THEN 'READY' WHEN n > 0 THEN 'PARTIAL' ELSE 'UNAVAILABLE' END AS status FROM (
    SELECT 'SECURITY_MASTER' AS code, count(*) AS n FROM securities WHERE origin = 'OFFICIAL'
    UNION ALL SELECT 'MEMBERSHIP', count(*) FROM memberships WHERE valid_to IS NULL
    UNION ALL SELECT 'EQUITY_EOD', count(*) FROM bars
    UNION ALL SELECT 'BENCHMARK', count(*) FROM benchmark_prices WHERE source_mode = 'NONE')""") is None else "")
add("q16_recent_log_rows",
    lambda s, p: text(q.recent_rows(issues(s, p), "created_at", "issue_id"), "created_at"),
    sql(f"SELECT issue_id, code, {iso('created_at')} FROM issues ORDER BY issues.created_at DESC, issue_id DESC LIMIT 25", "issues"))
