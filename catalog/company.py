"""Fundamentals, peers and relative strength (U1-U18). Entity = nation; sector benchmark = region of the nation."""

from __future__ import annotations

from catalog.lookups import d, eligible
from catalog.sql import part, r8, sql
from pyspark.sql import functions as F

from tapewright.functions.fixed_values import CONCEPT_LABELS, RS_WINDOWS
from tapewright.functions.numbers import r8 as r8c
from tapewright.operators import fundamentals as fu
from tapewright.operators import pit
from tapewright.sources import adapters as src

QUERIES, ORACLES = {}, {}


def add(name, query, oracle):
    QUERIES[name], ORACLES[name] = query, oracle


def fold(t):
    return "".join(c for c in t.upper() if c.isalnum())


LABELS = ", ".join(f"('{fold(a)}', '{c}')" for c, al in CONCEPT_LABELS.items() for a in (c, *al))
part("labels_", (), f"SELECT DISTINCT * FROM (VALUES {LABELS}) v(k, concept)")
part("rows_", ("facts", "scoped", "labels_"), """
  SELECT f.*, concept, entity, fiscal_year, fiscal_quarter, frequency, available_at FROM facts f
  JOIN labels_ ON k = regexp_replace(upper(source_concept), '[^A-Z0-9]', '', 'g') JOIN scoped USING (filing_id)
  WHERE f.value IS NOT NULL""")
part("ranked_", ("rows_",), """SELECT *, row_number() OVER (PARTITION BY entity, concept ORDER BY fact_end DESC,
  available_at DESC, filing_id DESC) AS k FROM rows_""")
part("quarter_", ("ranked_",), """SELECT *, row_number() OVER (PARTITION BY entity, concept ORDER BY k) AS qk FROM ranked_
  WHERE nature = 'QUARTERLY' AND fact_end - fact_start BETWEEN 70 AND 100""")
part("latest_q", ("quarter_",), "SELECT entity, concept, value, fact_end FROM quarter_ WHERE qk = 1")
part("yoy_", ("quarter_",), """
  SELECT n.entity, n.concept, n.fact_end, p.fact_end AS prior_end, CASE WHEN p.value <> 0 THEN
    CAST(n.value AS DOUBLE) / CAST(p.value AS DOUBLE) - 1e0 END AS value FROM quarter_ n LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY entity, concept, fiscal_year, fiscal_quarter ORDER BY qk) AS pk FROM quarter_) p
    ON p.entity = n.entity AND p.concept = n.concept AND p.fiscal_year = n.fiscal_year - 1 AND p.fiscal_quarter = n.fiscal_quarter
    AND p.pk = 1 WHERE n.qk = 1""")
part("ttm_", ("quarter_",), """
  SELECT entity, concept, count(*) AS n, CASE WHEN count(*) = 4 AND NOT bool_or(coalesce(fact_end >= later, false)) THEN sum(value) END AS value,
    string_agg(CAST(fact_end AS VARCHAR), ',' ORDER BY fact_end) AS periods FROM (
    SELECT *, lag(fact_start) OVER (PARTITION BY entity, concept ORDER BY fact_end DESC) AS later,
      row_number() OVER (PARTITION BY entity, concept ORDER BY fact_end DESC) AS t FROM (
      SELECT *, row_number() OVER (PARTITION BY entity, concept, fact_end ORDER BY qk) AS dk FROM quarter_ WHERE frequency = 'QUARTERLY')
    WHERE dk = 1) WHERE t <= 4 GROUP BY 1, 2""")
part("latest_", ("ranked_",), "SELECT entity, concept, value, fact_end FROM ranked_ WHERE k = 1")


def rows(s, p):
    return fu.mapped_facts(pit.scope_fallback(eligible(s, p)), src.facts(s, p))


def texted(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def joined(df):
    return df.withColumn("periods", F.array_join(F.transform("periods", lambda x: x.cast("string")), ","))


add("u01_map_concept",
    lambda s, p: src.facts(s, p).withColumn("concept", fu.map_concept(F.col("source_concept"))).groupBy(
        "source_concept", "concept").agg(F.count(F.lit(1)).alias("facts")),
    sql("""SELECT source_concept, concept, count(*) AS facts FROM facts LEFT JOIN labels_
           ON k = regexp_replace(upper(source_concept), '[^A-Z0-9]', '', 'g') GROUP BY 1, 2""", "facts", "labels_"))
add("u02_facts_ranked",
    lambda s, p: texted(fu.facts_ranked(rows(s, p)).select("entity", "concept", "filing_id", "fact_end", F.col("k").cast(
        "bigint").alias("k"), F.col("value").cast("double").alias("value")), "fact_end"),
    sql(f"SELECT entity, concept, filing_id, {d('fact_end')}, k, CAST(value AS DOUBLE) AS value FROM ranked_", "ranked_"))
add("u03_latest_quarter",
    lambda s, p: joined(fu.latest_quarter(rows(s, p))).select("entity", "concept", F.col("value").cast("double").alias("value"), "periods"),
    sql("SELECT entity, concept, CAST(value AS DOUBLE) AS value, CAST(fact_end AS VARCHAR) AS periods FROM latest_q", "latest_q"))
add("u04_yoy_growth",
    lambda s, p: joined(fu.yoy_growth(rows(s, p))).select("entity", "concept", r8c(F.col("value")).alias("value"), "periods", "reason"),
    sql(f"""SELECT entity, concept, {r8('value')} AS value, CASE WHEN value IS NOT NULL THEN CAST(prior_end AS VARCHAR) || ',' ELSE '' END
        || CAST(fact_end AS VARCHAR) AS periods, CASE WHEN value IS NULL THEN 'COMPARABLE_PRIOR_YEAR_QUARTER_REQUIRED' END AS reason
        FROM yoy_""", "yoy_"))
add("u05_ttm",
    lambda s, p: joined(fu.ttm(rows(s, p))).select("entity", "concept", F.col("value").cast("double").alias("value"), "periods", "reason"),
    sql("""SELECT entity, concept, CAST(value AS DOUBLE) AS value, periods, CASE WHEN n < 4 THEN 'FOUR_INDEPENDENT_QUARTERS_REQUIRED'
           WHEN value IS NULL THEN 'QUARTERLY_PERIODS_OVERLAP' END AS reason FROM ttm_""", "ttm_"))
add("u06_latest_value",
    lambda s, p: joined(fu.latest_value(rows(s, p))).select("entity", "concept", F.col("value").cast("double").alias("value"), "periods"),
    sql("SELECT entity, concept, CAST(value AS DOUBLE) AS value, CAST(fact_end AS VARCHAR) AS periods FROM latest_", "latest_"))


def closes(s, p):
    """Last close known of the first series of each nation (entity)."""
    owner = src.table(s, p, "supplier").groupBy(F.col("s_nationkey").cast("bigint").alias("entity")).agg(
        F.min("s_suppkey").alias("series"))
    known = src.bars(s, p).where("session <= '2000-06-26'")
    return pit.latest_per_group(known, ["series"], F.col("session")).join(owner, "series").select(
        "entity", (F.col("close").cast("double") / 10000).alias("close"))


def metrics(s, p):
    return fu.fundamental_metrics(pit.scope_fallback(eligible(s, p)), src.facts(s, p), closes(s, p))


part("closes_", ("bars",), """
  SELECT entity, CAST(arg_max(close, session) AS DOUBLE) / 10000 AS close FROM bars JOIN (
    SELECT CAST(s_nationkey AS BIGINT) AS entity, min(s_suppkey) AS series FROM supplier GROUP BY 1) USING (series)
  WHERE session <= DATE '2000-06-26' GROUP BY entity""")


def pick(rel, concept):
    return f"(SELECT CAST(value AS DOUBLE) FROM {rel} x WHERE x.entity = e.entity AND x.concept = '{concept}')"


_Q = {"REVENUE": "REVENUE", "PAT": "PROFIT_AFTER_TAX", "EPS": "EPS_BASIC"}
_THEN = """(SELECT CAST(arg_max(value, fact_end) AS DOUBLE) FROM (SELECT * FROM ranked_ r QUALIFY row_number() OVER (PARTITION BY entity, concept, fact_end ORDER BY k) = 1) r
  WHERE r.entity = e.entity AND r.concept = 'TOTAL_EQUITY' AND (SELECT max(fact_end) FROM latest_ l WHERE l.entity = e.entity
  AND l.concept = 'TOTAL_EQUITY') - r.fact_end >= 300)"""
EXPR = {
    **{f"{s_}_LATEST_QUARTER": (pick("latest_q", c), "'LATEST_INDEPENDENT_QUARTER_REQUIRED'") for s_, c in _Q.items()},
    **{f"{s_}_YOY": (pick("yoy_", c), f"CASE WHEN EXISTS (SELECT 1 FROM yoy_ x WHERE x.entity = e.entity AND x.concept = '{c}') "
       "THEN 'COMPARABLE_PRIOR_YEAR_QUARTER_REQUIRED' ELSE 'LATEST_INDEPENDENT_QUARTER_REQUIRED' END") for s_, c in _Q.items()},
    **{f"{s_}_TTM": (pick("ttm_", c), "'FOUR_INDEPENDENT_QUARTERS_REQUIRED'") for s_, c in _Q.items()},
    "NET_MARGIN_TTM": (f"{pick('ttm_', 'PROFIT_AFTER_TAX')} / nullif({pick('ttm_', 'REVENUE')}, 0)", "'NONZERO_REVENUE_TTM_REQUIRED'"),
    "DEBT_TO_EQUITY": (f"{pick('latest_', 'TOTAL_BORROWINGS')} / nullif({pick('latest_', 'TOTAL_EQUITY')}, 0)",
                       f"CASE WHEN {pick('latest_', 'TOTAL_BORROWINGS')} IS NULL THEN 'TOTAL_BORROWINGS_REQUIRED' ELSE 'NONZERO_EQUITY_REQUIRED' END"),
    "ROE_TTM": (f"{pick('ttm_', 'PROFIT_AFTER_TAX')} / nullif(({pick('latest_', 'TOTAL_EQUITY')} + {_THEN}) / 2e0, 0)",
                "'PAT_TTM_AND_TWO_NONZERO_EQUITY_PERIODS_REQUIRED'"),
    "FCF_TTM": (f"{pick('ttm_', 'CASH_FLOW_FROM_OPERATIONS')} - {pick('ttm_', 'CAPITAL_EXPENDITURE')}",
                "'FOUR_INDEPENDENT_QUARTERS_REQUIRED'"),
    "PE_TTM": (f"CASE WHEN {pick('ttm_', 'EPS_BASIC')} > 0 THEN (SELECT close FROM closes_ c WHERE c.entity = e.entity) / {pick('ttm_', 'EPS_BASIC')} END",
               "'POSITIVE_EPS_TTM_AND_POINT_IN_TIME_CLOSE_REQUIRED'"),
}


def metric_sql(codes):
    body = " UNION ALL ".join(
        f"SELECT entity, '{c}' AS code, {r8(EXPR[c][0])} AS value, {EXPR[c][1]} AS why FROM (SELECT DISTINCT entity FROM scoped) e"
        for c in codes)
    return sql(f"""SELECT entity, code, value, CASE WHEN value IS NULL THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS status,
        CASE WHEN value IS NULL THEN why END AS reason FROM ({body})""", "scoped", "latest_q", "yoy_", "ttm_", "latest_", "ranked_", "closes_")


def _metric(*codes):
    return lambda s, p: metrics(s, p).where(F.col("code").isin(*codes)).drop("periods")


for _name, _codes in (("u07_net_margin", ["NET_MARGIN_TTM"]), ("u08_debt_to_equity", ["DEBT_TO_EQUITY"]), ("u09_roe_ttm", ["ROE_TTM"]),
                      ("u10_fcf_ttm", ["FCF_TTM"]), ("u11_pe_ttm", ["PE_TTM"]), ("u12_metric_long", list(EXPR))):
    add(_name, _metric(*_codes), metric_sql(_codes))


def classified(s, p):
    return pit.classification_as_of(src.classifications(s, p), "2000-06-30", F.lit("2000-06-30 12:00:00").cast("timestamp"))


part("classified", ("classifications",), """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY
  snapshot_date DESC, available_at DESC) AS k FROM classifications) WHERE k = 1""")
add("u13_peers", lambda s, p: fu.peers(classified(s, p), 3), sql(" UNION ALL ".join(
    f"SELECT '{c}' AS level, series FROM classified WHERE series <> 3 AND {c} = (SELECT {c} FROM classified WHERE series = 3)"
    for c in fu.LEVELS), "classified"))
add("u13_peers_of_a_set", lambda s, p: fu.peers_of(classified(s, p), src.securities(s, p).where("origin = 'DEMO'")), sql(" UNION ALL ".join(
    f"SELECT a.series, '{c}' AS level, b.series AS peer FROM classified a JOIN securities o ON o.series = a.series AND o.origin = 'DEMO' JOIN classified b ON b.{c} = a.{c} AND b.series <> a.series"
    for c in fu.LEVELS), "classified", "securities"))
add("u13_peer_counts", lambda s, p: fu.peer_counts(classified(s, p)), sql("SELECT series, " + ", ".join(
    f"count(*) OVER (PARTITION BY {c}) - 1 AS {c}_peers" for c in fu.LEVELS) + " FROM classified", "classified"))
MAP = {"NATION_0": "AFRICA", "NATION_3": "ASIA", "NATION_6": "EUROPE", "NATION_9_B": "AMERICA"}
MAP_SQL = "CASE trim(sector) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MAP.items()) + " END"
add("u14_sector_benchmark",
    lambda s, p: classified(s, p).select("series", "sector", fu.sector_benchmark(F.col("sector"), MAP).alias("benchmark")),
    sql(f"SELECT series, sector, {MAP_SQL} AS benchmark FROM classified", "classified"))


def links(s, p):
    return pit.members_as_of(src.memberships(s, p), "2001-06-04").select("series", "index_id")


def strength(s, p):
    bars = src.bars(s, p).where("session <= '2001-06-04'")
    return fu.relative_strength(bars, links(s, p), src.benchmark_prices(s, p))


def strength_sql(links_rel):
    part(f"common_{links_rel}", ("bars", links_rel, "benchmark_prices"), f"""
      SELECT b.series, l.index_id, b.session, b.close, i.close AS ic, row_number() OVER (PARTITION BY b.series, l.index_id
        ORDER BY b.session DESC) AS k FROM bars b JOIN {links_rel} l USING (series) JOIN benchmark_prices i
        ON i.index_id = l.index_id AND i.session = b.session WHERE b.session <= DATE '2001-06-04'""")
    part(f"strength_{links_rel}", (f"common_{links_rel}",), " UNION ALL ".join(f"""
      SELECT l.series, l.index_id, '{c}' AS code, z.close / nullif(a.close, 0) - 1e0 AS series_return, z.ic / nullif(a.ic, 0) - 1e0 AS index_return,
        (z.close / nullif(a.close, 0) - 1e0) - (z.ic / nullif(a.ic, 0) - 1e0) AS value, a.session AS "start", CASE WHEN a.session IS NOT NULL THEN z.session END AS "end"
      FROM (SELECT DISTINCT series, index_id FROM {links_rel}) l LEFT JOIN common_{links_rel} z ON z.series = l.series AND z.index_id = l.index_id AND z.k = 1
      LEFT JOIN common_{links_rel} a ON a.series = l.series AND a.index_id = l.index_id AND a.k = {n + 1}""" for c, n in RS_WINDOWS.items()))
    return f"strength_{links_rel}"


part("links_", ("memberships",), """SELECT series, index_id FROM memberships WHERE valid_from <= DATE '2001-06-04'
  AND (valid_to IS NULL OR valid_to >= DATE '2001-06-04')""")
STRENGTH = strength_sql("links_")
RS_COLS = ("value", "series_return", "index_return")


def rs_out(df, *more):
    return texted(df.select("series", "index_id", "code", *[r8c(F.col(c)).alias(c) for c in RS_COLS], "start", "end", *more), "start", "end")


RS_SQL = f"""series, index_id, code, {', '.join(f'{r8(c)} AS {c}' for c in RS_COLS)}, CAST("start" AS VARCHAR) AS "start", CAST("end" AS VARCHAR) AS "end" """
add("u15_relative_strength", lambda s, p: rs_out(strength(s, p)), sql(f"SELECT {RS_SQL} FROM {STRENGTH}", STRENGTH))
add("u16_rs_percentile",
    lambda s, p: fu.rs_percentile(strength(s, p)).select("series", "index_id", "code", r8c(F.col("percentile")).alias("percentile"), "eligible"),
    sql(f"""SELECT series, index_id, code, CASE WHEN value IS NOT NULL THEN {r8('cd * 100')} END AS percentile,
        CASE WHEN value IS NOT NULL THEN n END AS eligible FROM (SELECT *, cume_dist() OVER (PARTITION BY index_id, code, value IS NULL
        ORDER BY floor(value * 1e8 + 0.5)) AS cd, count(*) OVER (PARTITION BY index_id, code, value IS NULL) AS n FROM {STRENGTH})""", STRENGTH))


def sector_links(s, p):
    return classified(s, p).select("series", fu.sector_benchmark(F.col("sector"), MAP).alias("index_id")).where("index_id IS NOT NULL")


part("sector_links", ("classified",), f"SELECT series, index_id FROM (SELECT series, {MAP_SQL} AS index_id FROM classified) WHERE index_id IS NOT NULL")
SECTOR = strength_sql("sector_links")
add("u17_rs_vs_sector",
    lambda s, p: rs_out(fu.relative_strength(src.bars(s, p).where("session <= '2001-06-04'"), sector_links(s, p), src.benchmark_prices(s, p))),
    sql(f"SELECT {RS_SQL} FROM {SECTOR}", SECTOR))
part("rs_wide", (STRENGTH,), f"SELECT series, bool_or(value IS NOT NULL) AS ok, " + ", ".join(
    f"{r8(f'''max(value) FILTER (WHERE code = '{c}')''')} AS \"{c}\"" for c in RS_WINDOWS) + f" FROM {STRENGTH} GROUP BY series")
part("last_", ("bars",), """SELECT * FROM (SELECT series, session, close, lag(close) OVER w AS before, row_number() OVER (PARTITION BY series
  ORDER BY session DESC) AS k FROM bars WHERE session <= DATE '2001-06-04' WINDOW w AS (PARTITION BY series ORDER BY session)) WHERE k = 1""")
add("u18_research_summary",
    lambda s, p: texted(fu.research_summary(src.securities(s, p), src.bars(s, p).where("session <= '2001-06-04'"), classified(s, p),
                                            strength(s, p), MAP), "session"),
    sql(f"""SELECT s.series, s.symbol, CAST(session AS VARCHAR) AS session, close, {r8('close / nullif(before, 0) - 1e0')} AS one_day_return,
        c.macro, c.sector, c.industry, c.basic_industry, {', '.join(f'"{c}"' for c in RS_WINDOWS)},
        {MAP_SQL.replace('sector', 'c.sector')} AS sector_benchmark, 'READY' AS classification_status,
        CASE WHEN coalesce(ok, false) THEN 'READY' ELSE 'UNAVAILABLE' END AS relative_strength_status,
        CASE WHEN {MAP_SQL.replace('sector', 'c.sector')} IS NULL THEN 'SECTOR_BENCHMARK_MAPPING_UNAVAILABLE' ELSE '' END AS warnings
        FROM securities s LEFT JOIN last_ USING (series) LEFT JOIN classified c USING (series) LEFT JOIN rs_wide USING (series)""",
        "securities", "last_", "classified", "rs_wide"))
