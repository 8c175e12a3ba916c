"""Scans, rule sets and consensus (S1-S15)."""

from __future__ import annotations

from catalog.features import with_features
from catalog.lookups import d
from catalog.sql import part, r8
from pyspark.sql import functions as F

from tapewright.functions import numbers
from tapewright.operators import asof_features as af
from tapewright.operators import pit, scan
from tapewright.sources import adapters as src

QUERIES, ORACLES = {}, {}
DATE, AS_OF = "2001-06-04", "2001-06-04 20:00:00"
FILTERS = [("MOM_3M_63D", ">", "-0.5"), ("RSI_14", "between", "30", "70"), ("ABOVE_SMA_50", "=", True),
           ("CLOSE_LOCATION", ">=", "0.1")]
LOOSE = {
    "MOMENTUM_TREND": {"min_momentum_3m": "-1", "min_momentum_6m": "-1", "min_volume_ratio_20": "0.5"},
    "BREAKOUT_20D": {"min_breakout_pct_20": "-1", "min_volume_ratio_20": "0", "min_close_location": "0",
                     "max_atr_pct_14": "2"},
    "MEAN_REVERSION_PULLBACK": {"max_rsi_14": "100", "max_distance_sma_20": "2", "max_return_5d": "5",
                                "max_atr_pct_14": "2"},
}
RULES = {n: scan.rules_for(n, o) for n, o in LOOSE.items()}


def latest(s, p, codes):
    return af.latest_features(src.bars(s, p), src.calendar(s, p), src.actions(s, p),
                              as_of=F.lit(AS_OF).cast("timestamp"), observation_date=DATE, policy="RAW", codes=codes)


def history(s, p, codes):
    return af.historical_features(src.bars(s, p), src.calendar(s, p), src.actions(s, p), start="1995-01-01",
                                  end="2001-12-31", policy="RAW", codes=codes)


def members(s, p):
    return pit.members_as_of(src.memberships(s, p), DATE)


MEMBERS = f"""members AS (SELECT DISTINCT index_id, series FROM memberships WHERE valid_from <= DATE '{DATE}'
  AND (valid_to IS NULL OR valid_to >= DATE '{DATE}'))"""
OBSERVED = "observed AS (SELECT m.index_id, m.series, f.* EXCLUDE (series) FROM members m LEFT JOIN on_date f ON f.series = m.series)"
ON_DATE = f"on_date AS (SELECT * FROM features WHERE session = DATE '{DATE}')"
SCAN = f""",
{MEMBERS}, {ON_DATE},
scanned AS (
  SELECT m.index_id, m.series, "MOM_3M_63D", "RSI_14", "ABOVE_SMA_50", "CLOSE_LOCATION",
    CASE WHEN f.series IS NULL OR "MOM_3M_63D" IS NULL OR "RSI_14" IS NULL OR "ABOVE_SMA_50" IS NULL
           OR "CLOSE_LOCATION" IS NULL THEN 'UNAVAILABLE'
         WHEN "MOM_3M_63D" > -0.5e0 AND "RSI_14" BETWEEN 30 AND 70 AND "ABOVE_SMA_50" AND "CLOSE_LOCATION" >= 0.1e0
           THEN 'MATCHED' ELSE 'NOT_MATCHED' END AS status
  FROM members m LEFT JOIN on_date f ON f.series = m.series)"""


def scanned(s, p):
    codes = [f[0] for f in FILTERS]
    return scan.market_scan(members(s, p), latest(s, p, codes), FILTERS, DATE)


def tidy(df, *codes):
    return df.withColumns({c: numbers.r8(F.col(c)) for c in codes})


NUM = ("MOM_3M_63D", "RSI_14", "CLOSE_LOCATION")
SCAN_OUT = ", ".join(f'{r8(chr(34) + c + chr(34))} AS "{c}"' for c in NUM)
QUERIES["s01_s02_market_scan"] = lambda s, p: tidy(scanned(s, p), *NUM)
ORACLES["s01_s02_market_scan"] = with_features(
    f'SELECT index_id, series, {SCAN_OUT}, "ABOVE_SMA_50", status FROM scanned', "memberships", more=SCAN)
QUERIES["s02_scan_results"] = lambda s, p: tidy(scan.scan_results(scanned(s, p), src.securities(s, p)), *NUM)
ORACLES["s02_scan_results"] = with_features(
    f'SELECT s.index_id, s.series, symbol, {SCAN_OUT}, "ABOVE_SMA_50", status FROM scanned s JOIN securities '
    "USING (series) WHERE status = 'MATCHED' ORDER BY lower(symbol), series", "memberships", more=SCAN)
QUERIES["s02_scan_summary"] = lambda s, p: scan.scan_summary(scanned(s, p))
ORACLES["s02_scan_summary"] = with_features(
    """SELECT index_id, count(*) AS members, count(*) FILTER (WHERE status <> 'UNAVAILABLE') AS evaluated,
       count(*) FILTER (WHERE status = 'UNAVAILABLE') AS unavailable, count(*) FILTER (WHERE status = 'MATCHED') AS matched
       FROM scanned GROUP BY index_id""", "memberships", more=SCAN)


def literal(v):
    return ("true" if v else "false") if isinstance(v, bool) else f"{float(v)!r}e0"


def passes(rule):
    f, op, v = rule
    return f'"{f}" {op} {literal(v)}'


def status_sql(rules):
    null = " OR ".join(f'"{c}" IS NULL' for c in scan.required_codes(rules))
    return (f"CASE WHEN {null} THEN '{scan.INSUFFICIENT}' WHEN {' AND '.join(passes(r) for r in rules)} "
            "THEN 'MATCHED' ELSE 'NOT_MATCHED' END")


def _conditions(name):
    def run(s, p):
        rules = RULES[name]
        rows = scan.observed_on(members(s, p), latest(s, p, scan.required_codes(rules)), DATE)
        e = scan.evaluate_rules(rows, rules, name).select(
            "series", "matched", F.size("missing").cast("bigint").alias("missing"), F.posexplode("conditions").alias("k", "c"))
        return e.select("series", F.col("k").cast("bigint").alias("k"), "matched", "missing", "c.feature", "c.operator",
                        numbers.r8(F.col("c.expected")).alias("expected"), numbers.r8(F.col("c.actual")).alias("actual"),
                        "c.passed")
    return run


def _conditions_sql(name):
    rules = RULES[name]
    missing = " + ".join(f'CAST("{c}" IS NULL AS BIGINT)' for c in scan.required_codes(rules))
    matched = " AND ".join(f"coalesce({passes(r)}, false)" for r in rules)
    rows = " UNION ALL ".join(
        f"""SELECT series, {k} AS k, {matched} AS matched, {missing} AS missing, '{f}' AS feature, '{op}' AS operator,
            {r8(repr(float(v)) + 'e0')} AS expected, {r8(f'CAST("{f}" AS DOUBLE)')} AS actual,
            coalesce({passes((f, op, v))}, false) AS passed FROM observed"""
        for k, (f, op, v) in enumerate(rules))
    return with_features(rows, "memberships", more=f",\n{MEMBERS}, {ON_DATE}, {OBSERVED}")


for _key, _name in (("s03_s07_momentum_trend", "MOMENTUM_TREND"), ("s03_s08_breakout_20d", "BREAKOUT_20D"),
                    ("s03_s09_mean_reversion_pullback", "MEAN_REVERSION_PULLBACK")):
    QUERIES[_key] = _conditions(_name)
    ORACLES[_key] = _conditions_sql(_name)


def _match(s, p):
    rules = RULES["BREAKOUT_20D"]
    rows = scan.observed_on(members(s, p), latest(s, p, scan.required_codes(rules)), DATE)
    return scan.evaluate_rules(rows, rules, "BREAKOUT_20D").select(
        "series", "matched", F.col("passed_count").cast("bigint").alias("passed_count"),
        F.array_join("missing", ",").alias("missing"),
        F.regexp_replace("explanation", "[0-9.,]+ while the rule requires (.*) [-0-9.,]+$", "# while the rule requires $1 #")
        .alias("explanation"))


def _match_sql():
    rules = RULES["BREAKOUT_20D"]
    ok = [f"coalesce({passes(r)}, false)" for r in rules]
    count = " + ".join(f"CAST({o} AS BIGINT)" for o in ok)
    first = " ".join(
        f"""WHEN NOT {o} THEN CASE WHEN "{r[0]}" IS NULL THEN 'Not matched because required feature history was unavailable.'
            ELSE 'Not matched because {r[0]} was ' || CASE WHEN CAST("{r[0]}" AS DOUBLE) < 0 THEN '-' ELSE '' END
                 || '# while the rule requires {r[1]} #' END"""
        for o, r in zip(ok, rules))
    missing = ", ".join(f"""CASE WHEN "{c}" IS NULL THEN '{c}' END""" for c in scan.required_codes(rules))
    return with_features(f"""
      SELECT series, {' AND '.join(ok)} AS matched, {count} AS passed_count, concat_ws(',', {missing}) AS missing,
        CASE WHEN {' AND '.join(ok)} THEN 'Matched because ' || CAST({count} AS VARCHAR) || ' of {len(rules)} BREAKOUT_20D conditions passed.'
             {first} END AS explanation
      FROM observed""", "memberships", more=f",\n{MEMBERS}, {ON_DATE}, {OBSERVED}")


QUERIES["s04_s05_strategy_match"] = _match
ORACLES["s04_s05_strategy_match"] = _match_sql()


def _params(s, p):
    """Effective parameters of the three rule sets beside the number of rows that pass each alone."""
    codes = scan.required_codes(*RULES.values())
    rows = history(s, p, codes)
    counts = rows.agg(*[
        F.count_if(F.coalesce(scan.predicate(*r), F.lit(False))).alias(f"{n}|{i}")
        for n, rules in RULES.items() for i, r in enumerate(rules)
    ])
    entries = F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule_set"), F.lit(r[0]).alias("feature"), F.lit(r[1]).alias("operator"),
                 F.lit(float(r[2])).alias("expected"), F.col(f"{n}|{i}").alias("rows_passing"))
        for n, rules in RULES.items() for i, r in enumerate(rules)
    ]))
    return counts.select(entries.alias("e")).select("e.*")


QUERIES["s06_params_effective"] = _params
ORACLES["s06_params_effective"] = with_features(" UNION ALL ".join(
    f"""SELECT '{n}' AS rule_set, '{r[0]}' AS feature, '{r[1]}' AS operator, {float(r[2])!r}e0 AS expected,
        count(*) FILTER (WHERE {passes(r)}) AS rows_passing FROM features"""
    for n, rules in RULES.items() for r in rules))

STATUS_COLS = ", ".join(f"{status_sql(r)} AS status_{n.lower()}" for n, r in RULES.items())
_M = " + ".join(f"CAST(status_{n.lower()} = 'MATCHED' AS INTEGER)" for n in RULES)
_I = " + ".join(f"CAST(status_{n.lower()} = '{scan.INSUFFICIENT}' AS INTEGER)" for n in RULES)
CONSENSUS = (f"{_M} AS matched_count, {_I} AS insufficient_count, CASE WHEN {_M} >= 2 THEN 'MATCHED' WHEN {_M} + {_I} >= 2 "
             f"THEN '{scan.INSUFFICIENT}' ELSE 'NOT_MATCHED' END AS status")


def _composition(s, p):
    codes = scan.required_codes(*RULES.values())
    rows = scan.observed_on(members(s, p), latest(s, p, codes), DATE)
    return scan.evaluate_composition(rows, RULES, 2).select(
        "index_id", "series", *[f"status_{n.lower()}" for n in RULES],
        F.col("matched_count").cast("bigint").alias("matched_count"),
        F.col("insufficient_count").cast("bigint").alias("insufficient_count"), "status")


QUERIES["s10_s11_component_consensus"] = _composition
ORACLES["s10_s11_component_consensus"] = with_features(f"""
  SELECT index_id, series, {', '.join(f'status_{n.lower()}' for n in RULES)}, {CONSENSUS} FROM (
    SELECT *, {STATUS_COLS} FROM observed)""",
    "memberships", more=f",\n{MEMBERS}, {ON_DATE}, {OBSERVED}")
QUERIES["s12_composition_summary"] = lambda s, p: _composition(s, p).groupBy("index_id", "status").agg(
    F.count(F.lit(1)).alias("members"))
ORACLES["s12_composition_summary"] = with_features(f"""
  SELECT index_id, status, count(*) AS members FROM (SELECT index_id, {CONSENSUS} FROM (
    SELECT *, {STATUS_COLS} FROM observed))
  GROUP BY 1, 2""", "memberships", more=f",\n{MEMBERS}, {ON_DATE}, {OBSERVED}")

GRID = """grid AS (SELECT DISTINCT index_id, series, session FROM memberships JOIN calendar c ON c.session >= valid_from
  AND (valid_to IS NULL OR c.session <= valid_to))"""


def grid(s, p):
    return pit.members_by_session(src.memberships(s, p), src.calendar(s, p))


def _signals(s, p):
    rules = RULES["BREAKOUT_20D"]
    rows = scan.historical_signals(history(s, p, scan.required_codes(rules)), grid(s, p), rules)
    return rows.select("index_id", "series", F.col("session").cast("string").alias("session"))


QUERIES["s13_historical_signals"] = _signals
ORACLES["s13_historical_signals"] = with_features(f"""
  SELECT index_id, series, {d('session')} FROM grid JOIN features USING (series, session)
  WHERE {status_sql(RULES['BREAKOUT_20D'])} = 'MATCHED'""", "memberships", "calendar", more=f",\n{GRID}")


def outcomes(s, p):
    codes = scan.required_codes(*RULES.values())
    return scan.historical_composition(history(s, p, codes), grid(s, p), RULES, 2)


OUTCOMES = f""",
{GRID},
outcomes AS (SELECT index_id, series, session, {CONSENSUS} FROM (
  SELECT g.index_id, g.series, g.session, {STATUS_COLS} FROM grid g LEFT JOIN features f
    ON f.series = g.series AND f.session = g.session))"""
QUERIES["s14_historical_composition"] = lambda s, p: outcomes(s, p).select(
    "index_id", "series", F.col("session").cast("string").alias("session"),
    F.col("matched_count").cast("bigint").alias("matched_count"),
    F.col("insufficient_count").cast("bigint").alias("insufficient_count"), "status")
ORACLES["s14_historical_composition"] = with_features(
    f"SELECT index_id, series, {d('session')}, matched_count, insufficient_count, status FROM outcomes",
    "memberships", "calendar", more=OUTCOMES)
QUERIES["s15_signal_diagnostics"] = lambda s, p: scan.signal_diagnostics(outcomes(s, p))
ORACLES["s15_signal_diagnostics"] = with_features(
    f"""SELECT count(*) AS evaluated, count(*) FILTER (WHERE status = 'MATCHED') AS matched,
        count(*) FILTER (WHERE status = 'NOT_MATCHED') AS non_matches,
        count(*) FILTER (WHERE status = '{scan.INSUFFICIENT}') AS insufficient FROM outcomes""",
    "memberships", "calendar", more=OUTCOMES)

PREVIEW = 250  # the feature's own limit
QUERIES["s15_signal_preview"] = lambda s, p: scan.signal_preview(outcomes(s, p), PREVIEW).select(
    "index_id", "series", F.col("session").cast("string").alias("session"), F.col("matched_count").cast("bigint").alias("matched_count"), "status", "truncated")
ORACLES["s15_signal_preview"] = with_features(
    f"""SELECT index_id, series, {d('session')}, matched_count, status, (SELECT count(*) FROM outcomes) > {PREVIEW} AS truncated FROM outcomes
        ORDER BY outcomes.session, series, index_id LIMIT {PREVIEW}""", "memberships", "calendar", more=OUTCOMES)
