"""Reproducibility (H1-H8)."""

from __future__ import annotations

from catalog.lookups import d, iso
from catalog.sql import part, sql
from pyspark.sql import functions as F

from tapewright.operators import pit, repro
from tapewright.sources import adapters as src

QUERIES, ORACLES = {}, {}
COLS = ("series", "session", "open", "high", "low", "close", "volume", "traded_value")


def add(name, query, oracle):
    QUERIES[name], ORACLES[name] = query, oracle


def texted(df, *columns):
    types = dict(df.dtypes)
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") if types[c].startswith("timestamp")
                           else F.col(c).cast("string") for c in columns})


def bars(s, p):
    return src.bars(s, p).drop("n")


VALUE = r"coalesce(regexp_replace(regexp_replace(CAST(traded_value AS VARCHAR), '(\.\d*?)0+$', '\1'), '\.$', ''), '~')"
part("hashed", ("bars",), f"""SELECT *, sha256('close=' || close || '|high=' || high || '|low=' || low || '|open=' || open || '|series=' || series || '|session=' || session
  || '|traded_value=' || {VALUE} || '|volume=' || volume) AS fp FROM bars""")
part("per_series", ("hashed",), "SELECT series, sha256(string_agg(fp, ',' ORDER BY fp)) AS fp FROM hashed GROUP BY series")
part("whole", ("per_series",), """SELECT sha256(string_agg(fp, ',' ORDER BY fp)) AS fp FROM (SELECT sha256(string_agg(fp, ',' ORDER BY fp)) AS fp FROM per_series
  GROUP BY substr(fp, 1, 3))""")
add("h1_row_fingerprint", lambda s, p: texted(repro.row_fingerprint(bars(s, p), COLS).select("series", "session", "fingerprint"), "session"),
    sql(f"SELECT series, {d('session')}, fp AS fingerprint FROM hashed", "hashed"))
add("h2_series_fingerprint", lambda s, p: repro.series_fingerprint(bars(s, p), COLS),
    sql("SELECT series, fp AS fingerprint FROM per_series", "per_series"))
add("h2_dataset_fingerprint", lambda s, p: repro.whole_fingerprint(repro.series_fingerprint(bars(s, p), COLS)),
    sql("SELECT fp AS fingerprint FROM whole", "whole"))
part("numbered", ("hashed",), "SELECT series, session, fp, row_number() OVER (PARTITION BY series ORDER BY session) AS k FROM hashed")
add("h3_prefix_fingerprint",
    lambda s, p: texted(repro.prefix_fingerprint(bars(s, p), COLS).select("series", "session", "prefix_fingerprint"), "session"),
    sql(f"SELECT series, {d('session')}, pf AS prefix_fingerprint FROM chain", "numbered", recursive="""chain AS (
      SELECT series, session, k, sha256(fp) AS pf FROM numbered WHERE k = 1
      UNION ALL SELECT n.series, n.session, n.k, sha256(c.pf || n.fp) FROM chain c JOIN numbered n ON n.series = c.series AND n.k = c.k + 1)"""))


def results(s, p):
    rows = bars(s, p).select("series", "session", (F.col("close") > F.col("open")).alias("matched"))
    return repro.result_fingerprint(rows, "UP_DAY v1", ("series", "session", "matched"))


part("results", ("bars",), """SELECT series, session, sha256('UP_DAY v1|matched=' || CASE WHEN close > open THEN 'true' ELSE 'false' END || '|series=' || series
  || '|session=' || session) AS rf FROM bars""")
add("h4_result_fingerprint", lambda s, p: texted(results(s, p).select("series", "session", "result_fingerprint"), "session"),
    sql(f"SELECT series, {d('session')}, rf AS result_fingerprint FROM results", "results"))
add("h5_run_fingerprint",
    lambda s, p: repro.run_fingerprint("hold=5", repro.whole_fingerprint(repro.series_fingerprint(bars(s, p), COLS)), results(s, p)),
    sql("""SELECT sha256('hold=5|' || (SELECT fp FROM whole) || '|' || (SELECT sha256(string_agg(fp, ',' ORDER BY fp)) FROM (
           SELECT sha256(string_agg(rf, ',' ORDER BY rf)) AS fp FROM results GROUP BY substr(rf, 1, 3)))) AS run_fingerprint""", "whole", "results"))


def _drift(s, p):
    runs = src.runs(s, p)
    new = runs.where("run_id % 6 = 1").select("run_id", "experiment", "sha256", "result_sha")
    return repro.run_drift(new, runs.where("run_id % 6 <> 1 AND experiment <> 'TYPE_7'")).select("run_id", "reference_run", "drift")


add("h6_run_drift", _drift, sql("""
  SELECT n.run_id, o.run_id AS reference_run, CASE WHEN o.run_id IS NULL THEN 'NO_REFERENCE_RUN' WHEN n.sha256 <> o.sha256 THEN 'DATASET_DRIFT'
    WHEN n.result_sha <> o.result_sha THEN 'ENGINE_OR_RESULT_DRIFT' ELSE 'REPRODUCED' END AS drift
  FROM runs n LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY started_at DESC, run_id DESC) AS k FROM runs
    WHERE run_id % 6 <> 1 AND experiment <> 'TYPE_7') WHERE k = 1) o USING (experiment) WHERE n.run_id % 6 = 1""", "runs"))
add("h7_run_log_page", lambda s, p: texted(repro.run_page(src.runs(s, p), "TYPE_3", 2, 20).select("run_id", "status", "started_at"), "started_at"),
    sql(f"SELECT run_id, status, {iso('started_at')} FROM runs WHERE experiment = 'TYPE_3' ORDER BY runs.started_at DESC, run_id DESC LIMIT 20 OFFSET 20", "runs"))
add("h7_newest_run",
    lambda s, p: texted(pit.latest_per_group(src.runs(s, p).select("experiment", "run_id", "status", "started_at"), ["experiment"], F.col("started_at"),
                                             F.col("run_id")), "started_at"),
    sql(f"""SELECT experiment, run_id, status, {iso('started_at')} FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY started_at DESC, run_id DESC) AS k
            FROM runs) WHERE k = 1""", "runs"))
add("h8_dataset_counts",
    lambda s, p: repro.dataset_counts(src.securities(s, p), src.bars(s, p), src.actions(s, p), src.memberships(s, p), src.calendar(s, p)),
    sql("""SELECT (SELECT count(*) FROM securities) AS securities, (SELECT count(*) FROM bars) AS price_rows, (SELECT count(*) FROM actions) AS action_revisions,
           (SELECT count(*) FROM memberships) AS membership_intervals, (SELECT count(*) FROM calendar) AS sessions""",
        "securities", "bars", "actions", "memberships", "calendar"))


def digest(fp, over=""):
    parts = [f"sum(CAST('0x' || substr({fp}, {1 + 15 * i}, 15) AS BIGINT)) {over}" for i in range(4)]
    return f"sha256(CAST(count(*) {over} AS VARCHAR) || " + " || ".join(f"'|' || CAST(coalesce({x}, 0) AS VARCHAR)" for x in parts) + ")"


add("h2_series_digest", lambda s, p: repro.multiset_digest(repro.row_fingerprint(bars(s, p), COLS), ["series"]),
    sql(f"SELECT series, {digest('fp')} AS digest FROM hashed GROUP BY series", "hashed"))
add("h3_prefix_digest", lambda s, p: texted(repro.prefix_digest(bars(s, p), COLS), "session"),
    sql(f"""SELECT series, {d('session')}, {digest('fp', 'OVER (PARTITION BY series ORDER BY session ROWS UNBOUNDED PRECEDING)')} AS prefix_digest FROM hashed""", "hashed"))
add("h5_run_digest", lambda s, p: repro.run_digest("hold=5", repro.row_fingerprint(bars(s, p), COLS), results(s, p)),
    sql(f"""SELECT sha256('hold=5|' || (SELECT {digest('fp')} FROM hashed) || '|' || (SELECT {digest('rf')} FROM results)) AS run_digest""", "hashed", "results"))


def appended(s, p):
    """Logged: a third of the runs, some of them with another result; the batch is all runs, one in seven of them twice."""
    runs = src.runs(s, p).select("run_id", "experiment", "status", "started_at", "result_sha")
    other = F.when(F.col("run_id") % 5 == 1, "changed").otherwise(F.col("result_sha"))
    log = runs.where("run_id % 3 = 0").withColumn("result_sha", other)
    return repro.append_run(log, runs.unionByName(runs.where("run_id % 7 = 2")))


add("h7_append_run", lambda s, p: appended(s, p).groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("rows")),
    sql("""SELECT run_id, outcome, count(*) AS rows FROM (
      SELECT run_id, CASE WHEN run_id % 3 = 0 AND run_id % 5 = 1 THEN 'RUN_ID_CONFLICT' WHEN run_id % 3 = 0 OR copy = 2 THEN 'ALREADY_LOGGED' ELSE 'APPENDED' END AS outcome
      FROM runs JOIN (VALUES (1), (2)) v(copy) ON copy = 1 OR run_id % 7 = 2) GROUP BY ALL""", "runs"))
