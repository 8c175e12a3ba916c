"""The adapters of `tapewright.sources.adapters` once more, as DuckDB common table expressions."""

from __future__ import annotations

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: tuple[str, ...], body: str) -> None:
    PARTS[name] = (needs, body)


def sql(body: str, *needs: str, recursive: str = "") -> str:
    """`body` behind the WITH list it needs, dependencies first; `recursive` is one more, recursive, entry."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in PARTS[name][0]:
            visit(dep)
        order.append(name)

    for name in needs:
        visit(name)
    entries = [f"{n} AS ({PARTS[n][1]})" for n in order]
    if recursive:
        return "WITH RECURSIVE " + ",\n".join([*entries, recursive]) + "\n" + body
    return ("WITH " + ",\n".join(entries) + "\n" if entries else "") + body


def r8(expr: str) -> str:
    return f"floor(({expr}) * 1e8 + 0.5e0) / 1e8"


part("bars0", (), """
  SELECT l_suppkey AS series, CAST(date_trunc('week', l_shipdate) AS DATE) AS session,
         CAST(floor(l_extendedprice * 10000 / l_quantity + 0.5) AS BIGINT) AS tick,
         CAST(l_quantity AS BIGINT) AS qty, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents,
         row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS place
  FROM lineitem""")
part("bars", ("bars0",), """
  SELECT series, session, min_by(tick, place) AS open, max(tick) AS high, min(tick) AS low,
         max_by(tick, place) AS close, CAST(sum(qty) AS BIGINT) AS volume,
         CASE WHEN sum(qty) % 53 <> 0 THEN CAST(CAST(sum(cents) AS DECIMAL(22,0)) * 0.01 AS DECIMAL(24,2)) END
           AS traded_value, count(*) AS n
  FROM bars0 GROUP BY series, session""")
part("calendar", (), """
  SELECT DISTINCT 'X' AS exchange, CAST(date_trunc('week', l_shipdate) AS DATE) AS session, true AS is_trading_day,
         33300 AS open_s,
         CASE WHEN ((CAST(date_trunc('week', l_shipdate) AS DATE) - DATE '1995-01-02') // 7) % 13 <> 5
              THEN 55800 END AS close_s
  FROM lineitem""")
part("full_calendar", ("calendar",), """
  SELECT * FROM calendar WHERE ((session - DATE '1995-01-02') // 7) % 37 <> 11
  UNION ALL
  SELECT exchange, session + 1, false, NULL, NULL FROM calendar WHERE ((session - DATE '1995-01-02') // 7) % 10 = 0""")
part("securities", (), """
  SELECT s_suppkey AS series, 'S' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS symbol, s_name AS company_name,
         'IN' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS isin, 'X' AS exchange, 'EQ' AS board,
         s_acctbal >= 0 AS is_active,
         CASE WHEN s_suppkey % 7 = 0 THEN 'DEMO' WHEN s_suppkey % 13 = 0 THEN 'UNKNOWN' ELSE 'OFFICIAL' END AS origin,
         r_name AS macro, n_name AS sector, n_name || '/' || CAST(s_suppkey % 3 AS VARCHAR) AS industry,
         n_name || '/' || CAST(s_suppkey % 3 AS VARCHAR) || '/' || CAST(s_suppkey % 2 AS VARCHAR) AS basic_industry
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
part("memberships", ("securities",), """
  SELECT macro AS index_id, series, CAST(DATE '1995-01-02' + CAST(series % 4 * 7 AS INTEGER) AS DATE) AS valid_from,
         CASE WHEN series % 6 = 0 THEN DATE '1999-06-06' WHEN series % 11 = 5 THEN DATE '1998-01-04' END AS valid_to
  FROM securities
  UNION ALL
  SELECT macro, series, DATE '2000-01-03', NULL FROM securities WHERE series % 6 = 0""")
part("actions", (), """
  SELECT s_suppkey * 10 + o AS id, s_suppkey AS series, type, ex_date, CAST(num AS DECIMAL(18,8)) AS num,
         CAST(den AS DECIMAL(18,8)) AS den, known + INTERVAL 10 HOUR AS available_at,
         CASE WHEN o = 1 THEN s_suppkey * 10 END AS supersedes_id
  FROM supplier JOIN (VALUES
    (10, 0, 0, 'STOCK_SPLIT', DATE '1998-06-08', 2, 1, DATE '1998-05-25'),
    (20, 0, 1, 'STOCK_SPLIT', DATE '1998-06-08', 5, 2, DATE '1998-07-20'),
    (10, 5, 2, 'BONUS', DATE '1997-04-14', 1, 1, DATE '1997-04-11'),
    (15, 0, 3, 'DIVIDEND', DATE '1999-03-01', 1, 1, DATE '1999-02-01')
  ) v(m, r, o, type, ex_date, num, den, known) ON s_suppkey % m = r""")
part("benchmark_prices", ("bars", "securities"), """
  SELECT macro AS index_id, session, CAST(floor(sum(open) / count(*) + 0.5) AS BIGINT) AS open,
         CAST(floor(sum(high) / count(*) + 0.5) AS BIGINT) AS high,
         CAST(floor(sum(low) / count(*) + 0.5) AS BIGINT) AS low,
         CAST(floor(sum(close) / count(*) + 0.5) AS BIGINT) AS close,
         CASE WHEN macro = 'MIDDLE EAST' THEN 'DEMO' ELSE 'OFFICIAL' END AS source_mode,
         session + INTERVAL 55800 SECOND AS available_at
  FROM bars JOIN securities USING (series) GROUP BY macro, session""")
part("filings0", (), """
  SELECT CAST(c_nationkey AS BIGINT) AS entity, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_start,
         CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
part("filings1", ("filings0",), """
  SELECT entity, cents, period_start, CAST(period_start + INTERVAL 3 MONTH AS DATE) - 1 AS period_end,
         CAST(year(period_start + INTERVAL 9 MONTH) AS BIGINT) AS fiscal_year,
         CAST(quarter(period_start + INTERVAL 9 MONTH) AS BIGINT) AS fiscal_quarter
  FROM filings0""")
part("filings2", ("filings1",), """
  SELECT entity * 1000000 + fiscal_year * 10 + fiscal_quarter AS filing_id, entity, period_start, period_end,
         fiscal_year, fiscal_quarter, 'QUARTERLY' AS frequency,
         CASE WHEN entity % 5 = 0 THEN 'STANDALONE' ELSE 'CONSOLIDATED' END AS scope,
         period_end + 20 + INTERVAL 18 HOUR AS available_at, CAST(NULL AS BIGINT) AS supersedes_id, cents
  FROM filings1""")
part("filings", ("filings2",), """
  SELECT * FROM filings2
  UNION ALL
  SELECT filing_id + 500000, entity, period_start, period_end, fiscal_year, fiscal_quarter, frequency, scope,
         period_end + 80 + INTERVAL 18 HOUR, filing_id, cents + cents // 10
  FROM filings2 WHERE filing_id % 7 = 0""")
part("facts", ("filings",), """
  SELECT filing_id, source_concept, CAST(CAST(value AS DECIMAL(28,0)) * 0.01 AS DECIMAL(30,8)) AS value, fact_kind,
         nature, CASE WHEN fact_kind = 'INSTANT' THEN period_end ELSE period_start END AS fact_start,
         period_end AS fact_end
  FROM (
    SELECT *, 'Revenue From Operations' AS source_concept, 'DURATION' AS fact_kind, 'QUARTERLY' AS nature,
           cents AS value FROM filings
    UNION ALL SELECT *, 'Profit After Tax', 'DURATION', 'QUARTERLY', cents // 10 - entity * 100000 FROM filings
    UNION ALL SELECT *, 'Basic EPS', 'DURATION', 'QUARTERLY', cents // 100000 - 500 FROM filings
    UNION ALL SELECT *, 'Total Equity', 'INSTANT', 'INSTANT', cents // 3 + entity FROM filings
    UNION ALL SELECT *, 'Total Borrowings', 'INSTANT', 'INSTANT',
                     CASE WHEN entity % 4 = 0 THEN NULL ELSE cents // 5 END FROM filings
    UNION ALL SELECT *, 'Net Cash From Operating Activities', 'DURATION', 'QUARTERLY', cents // 8 FROM filings
    UNION ALL SELECT *, 'Capital Expenditure', 'DURATION', 'QUARTERLY',
                     CASE WHEN entity % 3 = 0 THEN NULL ELSE cents // 20 END FROM filings
    UNION ALL SELECT *, 'Order Backlog', 'INSTANT', 'INSTANT', cents // 2 FROM filings
  )""")
part("artifact_log", (), """
  SELECT event_id AS artifact_id, event_type AS provider, 'TYPE_' || CAST(user_id % 8 AS VARCHAR) AS artifact_type,
         CAST(ts AS DATE) AS source_date, ts AS imported_at,
         sha256(event_type || '|' || CAST(user_id % 8 AS VARCHAR) || '|' || props) AS sha256,
         CASE WHEN event_id % 17 = 0 THEN 'FAILED' WHEN event_id % 19 = 0 THEN 'CONFLICT'
              WHEN event_id % 5 = 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS status,
         CAST(floor(value * 10) AS BIGINT) AS inserted, event_id % 3 AS unchanged,
         CASE WHEN event_id % 5 = 0 THEN event_id % 7 ELSE 0 END AS rejected,
         CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS conflicts,
         CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END AS warnings
  FROM events""")
part("classifications", ("securities",), """
  SELECT series, macro, sector, industry, basic_industry, DATE '1996-01-01' AS snapshot_date,
         TIMESTAMP '1996-01-02 10:00:00' AS available_at FROM securities
  UNION ALL
  SELECT series, macro, CASE WHEN series % 9 = 0 THEN sector || '_B' ELSE sector END, industry, basic_industry,
         DATE '2000-01-03', TIMESTAMP '2000-01-04 10:00:00' FROM securities""")
part("reports", ("filings",), """
  SELECT entity, period_end, CAST(available_at AS DATE) AS reported_on,
         CAST(available_at AS DATE) + CAST(entity % 5 AS INTEGER) AS effective_on, cents FROM filings""")
part("runs", ("artifact_log",), """
  SELECT artifact_id AS run_id, provider || '_' || artifact_type AS dataset_code, status, imported_at AS started_at,
         date_trunc('second', imported_at) + to_seconds(inserted % 600) AS completed_at, artifact_type AS experiment,
         sha256, sha256(provider || '|' || CAST(inserted % 5 AS VARCHAR)) AS result_sha
  FROM artifact_log""")
