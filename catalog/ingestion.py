"""Normalisation and merging (I1-I30) on text rows spelled out from the driver's tables, with defects by rule."""

from __future__ import annotations

from catalog.company import MAP, MAP_SQL
from catalog.lookups import d, iso
from catalog.sql import part, sql
from pyspark.sql import functions as F

from tapewright.functions import parsing
from tapewright.functions.fixed_values import CONCEPT_LABELS
from tapewright.operators import ingest, merge, pit
from tapewright.sources import adapters as src
from tapewright.sources import artifacts

QUERIES, ORACLES = {}, {}


def add(name, query, oracle=None):
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def s_(col):
    return col.cast("string")


def texted(df, *columns):
    types = dict(df.dtypes)
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") if types[c].startswith("timestamp")
                           else F.col(c).cast("string") for c in columns})


def outcome(df, *more):
    return df.select("artifact_id", "row_no", F.col("issue.code").alias("code"), *more)


NUM = r"'^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$'"
DAY = """coalesce(try_cast(CASE WHEN regexp_full_match({c}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN {c} END AS DATE),
  CAST(try_strptime({c}, ['%d-%b-%Y', '%d/%m/%Y', '%d %b %Y', '%d %B %Y', '%d-%m-%Y', '%Y%m%d']) AS DATE))"""


def day_sql(c):
    return DAY.format(c=c)


# --- I1, I2, I15 with two keys: securities ------------------------------------------------------------------------
def raw_securities(s, p):
    k = F.col("s_suppkey")
    rows = src.table(s, p, "supplier").select(
        F.concat(F.lit("SM"), s_(k % 3)).alias("artifact_id"), k.alias("row_no"), k.alias("k"),
        F.concat(F.lit("s"), F.lpad(s_(k), 9, "0")).alias("TckrSymb"),
        F.when(k % 23 == 0, "BE").otherwise(" eq ").alias("SctySrs"),
        F.when(k % 31 == 2, "  ").otherwise(F.col("s_name")).alias("Company Name"),
        F.concat(F.when(k % 29 == 1, F.lit("XX")).otherwise("IN"), F.lpad(s_(k), 10, "0")).alias("isin-code"),
        F.when(k % 37 == 3, "31/31/2020").when(k % 2 == 0, "-").otherwise("05-Jan-2001").alias("Date of Listing"),
        F.when(k % 6 == 0, "Suspended").otherwise("Active").alias("Status"))
    again = rows.where("k % 10 = 4").withColumns({
        "row_no": F.col("row_no") + 1000000, "isin-code": F.concat(F.lit("IN9"), F.lpad(s_(F.col("k")), 9, "0"))})
    other = rows.where("k % 10 = 6").withColumns({
        "row_no": F.col("row_no") + 2000000, "TckrSymb": F.concat(F.lit("T"), F.lpad(s_(F.col("k")), 9, "0"))})
    return rows.unionByName(again).unionByName(other).drop("k")


part("sec_text0", (), """
  SELECT 'SM' || CAST(s_suppkey % 3 AS VARCHAR) AS artifact_id, s_suppkey AS row_no, s_suppkey AS k,
    'S' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS symbol, CASE WHEN s_suppkey % 23 = 0 THEN 'BE' ELSE 'EQ' END AS series,
    CASE WHEN s_suppkey % 31 = 2 THEN '' ELSE s_name END AS name,
    CASE WHEN s_suppkey % 29 = 1 THEN 'XX' ELSE 'IN' END || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS isin,
    s_suppkey % 37 = 3 AS bad_date, s_suppkey % 6 <> 0 AS is_active FROM supplier""")
part("sec_text", ("sec_text0",), """
  SELECT * FROM sec_text0
  UNION ALL SELECT * REPLACE (row_no + 1000000 AS row_no, 'IN9' || lpad(CAST(k AS VARCHAR), 9, '0') AS isin) FROM sec_text0 WHERE k % 10 = 4
  UNION ALL SELECT * REPLACE (row_no + 2000000 AS row_no, 'T' || lpad(CAST(k AS VARCHAR), 9, '0') AS symbol) FROM sec_text0 WHERE k % 10 = 6""")
part("sec_checked", ("sec_text",), """
  SELECT *, CASE WHEN series <> 'EQ' THEN 'UNSUPPORTED_EQUITY_SERIES' WHEN NOT regexp_full_match(isin, 'IN[A-Z0-9]{10}') OR name = '' OR bad_date
    THEN 'MALFORMED_SECURITY_IDENTIFIER' END AS c0 FROM sec_text""")
part("sec_norm", ("sec_checked",), """
  SELECT artifact_id, row_no, symbol, isin, is_active, CASE WHEN c0 IS NOT NULL THEN c0
    WHEN row_no > min(row_no) FILTER (WHERE c0 IS NULL) OVER (PARTITION BY artifact_id, symbol) THEN 'DUPLICATE_SYMBOL_SERIES'
    WHEN row_no > min(row_no) FILTER (WHERE c0 IS NULL) OVER (PARTITION BY artifact_id, isin) THEN 'DUPLICATE_ISIN_CONFLICT' END AS code
  FROM sec_checked""")


def securities_norm(s, p):
    return ingest.norm_securities(artifacts.resolve_headers(raw_securities(s, p), "securities"))


add("i01_resolve_headers",
    lambda s, p: artifacts.resolve_headers(raw_securities(s, p), "securities").select(
        "artifact_id", "row_no", F.upper("symbol").alias("symbol"), F.upper("series").alias("series"), "isin"),
    sql("SELECT artifact_id, row_no, symbol, series, isin FROM sec_text", "sec_text"))
add("i02_norm_securities", lambda s, p: outcome(securities_norm(s, p), "symbol", "isin", "is_active"),
    sql("SELECT artifact_id, row_no, code, symbol, isin, is_active FROM sec_norm", "sec_norm"))


# --- I3, I12-I15: prices ---------------------------------------------------------------------------------------------
def raw_prices(s, p):
    text = lambda c: s_((F.col(c).cast("decimal(14,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(18,4)"))
    k = (F.col("series") * 7 + F.datediff("session", src.day(src.FIRST_MONDAY)) / 7).cast("bigint")
    shown = F.when(k % 79 == 4, F.date_add("session", 1)).otherwise(F.col("session"))
    date = F.when(k % 3 == 0, s_(shown)).when(k % 3 == 1, F.date_format(shown, "dd-MMM-yyyy")).otherwise(
        F.date_format(shown, "dd/MM/yyyy"))
    rows = src.bars(s, p).withColumn("k", k).select(
        F.concat(F.lit("EOD "), s_(F.col("session"))).alias("artifact_id"), F.col("series").alias("row_no"), "k",
        F.col("session").alias("expected_date"), date.alias("TradDt"), F.lit("CM").alias("Sgmt"),
        F.concat(F.lit("S"), F.lpad(s_(F.col("series")), 9, "0")).alias("TckrSymb"),
        F.when(k % 67 == 7, "GS").otherwise("EQ").alias("SctySrs"), F.lit("").alias("ISIN"),
        F.when(k % 89 == 2, "abc").otherwise(text("open")).alias("OpnPric"),
        F.when(k % 97 == 1, "0").otherwise(text("high")).alias("HghPric"), text("low").alias("LwPric"),
        F.when(k % 73 == 5, F.concat(text("close"), F.lit("5"))).otherwise(text("close")).alias("ClsPric"),
        F.when(k % 83 == 3, "12.5").otherwise(s_(F.col("volume"))).alias("TtlTradgVol"),
        F.coalesce(s_(F.col("traded_value")), F.lit("-")).alias("TtlTrfVal"))
    return rows.unionByName(rows.where("k % 71 = 6").withColumn("row_no", F.col("row_no") + 1000000)).drop("k")


def _price_text(c):
    return f"CAST(CAST(CAST({c} AS DECIMAL(14,0)) * 0.0001 AS DECIMAL(18,4)) AS VARCHAR)"


part("price_text0", ("bars",), f"""
  SELECT 'EOD ' || CAST(session AS VARCHAR) AS artifact_id, series AS row_no, series, session, series * 7 + (session - DATE '1995-01-02') // 7 AS k,
    'S' || lpad(CAST(series AS VARCHAR), 9, '0') AS symbol, {_price_text('open')} AS o, {_price_text('high')} AS h,
    {_price_text('low')} AS l, {_price_text('close')} AS c, volume, traded_value FROM bars""")
part("price_text", ("price_text0",), """
  SELECT * REPLACE (CASE WHEN k % 89 = 2 THEN 'abc' ELSE o END AS o, CASE WHEN k % 97 = 1 THEN '0' ELSE h END AS h,
    CASE WHEN k % 73 = 5 THEN c || '5' ELSE c END AS c), CASE WHEN k % 83 = 3 THEN '12.5' ELSE CAST(volume AS VARCHAR) END AS v
  FROM (SELECT * FROM price_text0 UNION ALL SELECT * REPLACE (row_no + 1000000 AS row_no) FROM price_text0 WHERE k % 71 = 6)""")
part("price_checked", ("price_text",), f"""
  SELECT *, CASE WHEN k % 67 = 7 THEN 'UNSUPPORTED_EQUITY_SERIES' WHEN k % 79 = 4 OR NOT regexp_full_match(o, {NUM}) OR v LIKE '%.%'
    OR length(split_part(c, '.', 2)) > 4 OR h = '0' THEN 'INVALID_OHLCV_ROW' END AS c0 FROM price_text""")
part("price_norm", ("price_checked",), """
  SELECT *, CASE WHEN c0 IS NOT NULL THEN c0 WHEN row_no > min(row_no) FILTER (WHERE c0 IS NULL) OVER (PARTITION BY artifact_id, symbol)
    THEN 'DUPLICATE_ARTIFACT_ROW' END AS code FROM price_checked""")


def prices_norm(s, p):
    return ingest.norm_prices(artifacts.resolve_headers(raw_prices(s, p), "prices", ("artifact_id", "row_no", "expected_date")))


add("i03_norm_prices",
    lambda s, p: outcome(prices_norm(s, p), "symbol"),
    sql("SELECT artifact_id, row_no, code, symbol FROM price_norm", "price_norm"))
add("i12_multi_format_date",
    lambda s, p: raw_prices(s, p).groupBy(s_(parsing.multi_format_date(F.col("TradDt"))).alias("day")).agg(F.count(F.lit(1)).alias("rows")),
    sql("SELECT CAST(CASE WHEN k % 79 = 4 THEN session + 1 ELSE session END AS VARCHAR) AS day, count(*) AS rows FROM price_text GROUP BY 1", "price_text"))
add("i13_numeric_guard",
    lambda s, p: raw_prices(s, p).select(F.explode(F.array("OpnPric", "HghPric", "ClsPric", "TtlTradgVol")).alias("t")).groupBy(
        parsing.number(F.col("t")).isNotNull().alias("readable"),
        F.coalesce(parsing.storage_problem(F.col("t"), 14, 4), F.lit(False)).alias("out_of_range")).agg(F.count(F.lit(1)).alias("cells")),
    sql(f"""SELECT regexp_full_match(t, {NUM}) AS readable, regexp_full_match(t, {NUM}) AND length(split_part(t, '.', 2)) > 4 AS out_of_range,
        count(*) AS cells FROM (SELECT unnest([o, h, c, v]) AS t FROM price_text) GROUP BY 1, 2""", "price_text"))
add("i14_split_rejects",
    lambda s, p: ingest.issue_counts(ingest.rejected(prices_norm(s, p))),
    sql("SELECT artifact_id, count(*) AS rejected, 0 AS warnings FROM price_norm WHERE code IS NOT NULL GROUP BY 1", "price_norm"))
add("i14_issue_sample",
    lambda s, p: ingest.issue_sample(ingest.rejected(prices_norm(s, p)), 3).select("artifact_id", "row_no", "code"),
    sql("""SELECT artifact_id, row_no, code FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY row_no) AS r FROM price_norm
           WHERE code IS NOT NULL) WHERE r <= 3""", "price_norm"))
add("i15_dedupe_first_in_file",
    lambda s, p: ingest.accepted(prices_norm(s, p)).select("artifact_id", "row_no", "symbol", F.col("close").cast("double").alias("close"), "volume"),
    sql("SELECT artifact_id, row_no, symbol, CAST(c AS DOUBLE) AS close, volume FROM price_norm WHERE code IS NULL", "price_norm"))


# --- I4: index history as JSON -----------------------------------------------------------------------------------------
def index_documents(s, p):
    """One JSON document per index, month and request: a chunk is bounded by the calendar."""
    b = src.benchmark_prices(s, p)
    cell = lambda c: s_((F.col(c).cast("decimal(20,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(20,4)"))
    n = F.datediff("session", src.day(src.FIRST_MONDAY)) / 7
    row = F.struct(
        F.when(n % 41 == 7, "OTHER").otherwise("Index One").alias("INDEX_NAME"), F.date_format("session", "dd MMM yyyy").alias("HistoricalDate"),
        cell("open").alias("OPEN"), F.when(n % 43 == 9, "x").otherwise(cell("high")).alias("HIGH"), cell("low").alias("LOW"), cell("close").alias("CLOSE"))
    rows = b.groupBy("index_id", F.trunc("session", "month").alias("m")).agg(F.array_sort(F.collect_list(F.struct("session", row.alias("r")))).alias("a"))
    body = F.to_json(F.transform("a", lambda x: x["r"]))
    wrapped = F.when(F.month("m") % 3 == 0, F.concat(F.lit('{"d":'), F.to_json(F.struct(body.alias("x"))).substr(F.lit(6), F.length(F.to_json(
        F.struct(body.alias("x")))) - 6), F.lit("}"))).when(F.month("m") % 3 == 1, F.concat(F.lit('{"data":'), body, F.lit("}"))).otherwise(body)
    return rows.select(F.concat("index_id", F.lit(" "), s_(F.col("m"))).alias("artifact_id"), wrapped.alias("content"))


part("index_rows", ("benchmark_prices",), """
  SELECT index_id || ' ' || CAST(CAST(date_trunc('month', session) AS DATE) AS VARCHAR) AS artifact_id, session, close,
    row_number() OVER (PARTITION BY index_id, date_trunc('month', session) ORDER BY session) AS row_no, (session - DATE '1995-01-02') // 7 AS n
  FROM benchmark_prices""")
INDEX_CODE = """CASE WHEN n % 41 = 7 OR n % 43 = 9 OR session < DATE '1996-01-01' OR session > DATE '2001-06-30' THEN 'INVALID_INDEX_OHLC_ROW' END"""
add("i04_norm_index_history",
    lambda s, p: outcome(texted(ingest.norm_index_history(artifacts.json_rows(index_documents(s, p)), "INDEX  one", "1996-01-01", "2001-06-30"),
                                "trade_date"), F.col("trade_date").alias("session"), F.col("close").cast("double").alias("close")),
    sql(f"SELECT artifact_id, row_no, {INDEX_CODE} AS code, {d('session')}, close / 10000 AS close FROM index_rows", "index_rows"))


# --- I5, I6, I7, I8, I9 --------------------------------------------------------------------------------------------------
def raw_constituents(s, p):
    k = F.col("series")
    rows = src.securities(s, p).select(
        F.col("macro").alias("artifact_id"), k.alias("row_no"), F.lower("symbol").alias("Symbol"), F.when(k % 17 == 3, "BE").otherwise("EQ").alias("Series"),
        F.when(k % 19 == 4, "IN12").otherwise(F.col("isin")).alias("ISIN Code"), F.when(k % 13 == 5, " ").otherwise(F.col("company_name")).alias("Company Name"),
        F.when(k % 2 == 0, F.col("industry")).otherwise("").alias("Industry"))
    return rows.unionByName(rows.where("row_no % 9 = 1").withColumn("row_no", F.col("row_no") + 1000000))


part("cons", ("securities",), """
  SELECT macro AS artifact_id, row_no, symbol, CASE WHEN series % 2 = 0 THEN industry END AS industry,
    CASE WHEN series % 19 = 4 OR series % 17 = 3 OR series % 13 = 5 THEN 'INVALID_CONSTITUENT' WHEN row_no > 1000000 OR (series = 0 AND row_no = 1000000)
      THEN 'DUPLICATE_INDEX_MEMBER' END AS code
  FROM (SELECT *, series AS row_no FROM securities UNION ALL SELECT *, series + 1000000 FROM securities WHERE series % 9 = 1)""")
add("i05_norm_constituents",
    lambda s, p: outcome(ingest.norm_constituents(artifacts.resolve_headers(raw_constituents(s, p), "constituents")), "symbol", "industry"),
    sql("SELECT artifact_id, row_no, code, symbol, industry FROM cons", "cons"))
PURPOSES = [
    "Bonus Issue - 1:2", "BONUS 3 : 1", "Face Value Split From Rs.10 To Rs 2", "Sub-Division from Rs 10 to Rs 3", "Stock split announced",
    "Interim Dividend", "SUB DIVISION FROM 5.00 TO 1.00 per share", "Split From 2 To 10", "bonus debentures",
]
KIND = ["BONUS", "BONUS", "STOCK_SPLIT", None, None, None, "STOCK_SPLIT", None, None]
RATIO = [(1, 2), (3, 1), (5, 1), None, None, None, (5, 1), None, None]


def raw_actions(s, p):
    o = src.table(s, p, "orders")
    k = F.col("o_orderkey")
    texts = F.array(*[F.lit(t) for t in PURPOSES])
    return o.select(
        F.concat(F.lit("CA "), F.date_format("o_orderdate", "yyyy-MM")).alias("artifact_id"), k.alias("row_no"),
        F.concat(F.lit("C"), s_(F.col("o_custkey"))).alias("Symbol"), F.when(k % 21 == 4, "BE").otherwise("EQ").alias("Series"),
        F.element_at(texts, (k % 9 + 1).cast("int")).alias("Purpose"),
        F.when(k % 25 == 1, "someday").otherwise(F.date_format("o_orderdate", "d MMMM yyyy")).alias("Ex Date"),
        F.when(k % 27 == 2, "2020-13-01").otherwise("NA").alias("Record Date"),
        F.when(k % 4 == 0, "").when(k % 22 == 5, "2000-01-01T10:00:00").otherwise("2000-01-01T10:00:00+05:30").alias("Broadcast Timestamp"))


def _arr(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


part("act0", (), f"""
  SELECT 'CA ' || strftime(o_orderdate, '%Y-%m') AS artifact_id, o_orderkey AS row_no, o_orderkey AS k, o_custkey, CAST(o_orderdate AS DATE) AS ex,
    o_orderkey % 9 AS i, {_arr(KIND)}[o_orderkey % 9 + 1] AS kind, {_arr([r and r[0] for r in RATIO])}[o_orderkey % 9 + 1] AS num,
    {_arr([r and r[1] for r in RATIO])}[o_orderkey % 9 + 1] AS den FROM orders""")
part("act1", ("act0",), """
  SELECT *, CASE WHEN k % 21 = 4 THEN 'UNSUPPORTED_EQUITY_SERIES' WHEN i IN (3, 4, 7, 8) THEN 'AMBIGUOUS_ACTION_RATIO'
    WHEN i = 5 THEN 'UNSUPPORTED_CORPORATE_ACTION' WHEN k % 25 = 1 OR k % 27 = 2 OR (k % 4 <> 0 AND k % 22 = 5) THEN 'MALFORMED_CORPORATE_ACTION' END AS c0 FROM act0""")
part("act2", ("act1",), """
  SELECT *, CASE WHEN c0 IS NOT NULL THEN c0 WHEN row_no > min(row_no) FILTER (WHERE c0 IS NULL) OVER (PARTITION BY artifact_id, o_custkey, i, ex)
    THEN 'DUPLICATE_CORPORATE_ACTION' WHEN k % 4 = 0 THEN 'AVAILABILITY_TIMESTAMP_UNKNOWN' END AS code FROM act1""")
add("i06_norm_corporate_actions",
    lambda s, p: outcome(ingest.norm_corporate_actions(artifacts.resolve_headers(raw_actions(s, p), "corporate_actions")), F.when(
        F.col("issue.code").isNull(), F.col("action_type")).alias("kind"), F.when(F.col("issue.code").isNull(), F.col("num").cast("double")).alias("num"),
        F.when(F.col("issue.code").isNull(), F.col("den").cast("double")).alias("den")),
    sql("""SELECT artifact_id, row_no, code, CASE WHEN code IS NULL THEN kind END AS kind, CASE WHEN code IS NULL THEN CAST(num AS DOUBLE) END AS num,
           CASE WHEN code IS NULL THEN CAST(den AS DOUBLE) END AS den FROM act2""", "act2"))


def raw_holidays(s, p):
    k = F.col("event_id")
    return src.table(s, p, "events").select(
        F.col("event_type").alias("artifact_id"), k.alias("row_no"),
        F.when(k % 14 == 1, "no date").otherwise(F.date_format("ts", "yyyyMMdd")).alias("Holiday Date"), F.when(k % 15 == 2, "").otherwise("closed").alias("Reason"))


add("i07_norm_holidays",
    lambda s, p: outcome(texted(ingest.norm_holidays(artifacts.resolve_headers(raw_holidays(s, p), "holidays")), "date"), "date"),
    sql("""SELECT artifact_id, row_no, CASE WHEN bad THEN 'MALFORMED_HOLIDAY' WHEN row_no > min(row_no) FILTER (WHERE NOT bad) OVER (
             PARTITION BY artifact_id, "date") THEN 'DUPLICATE_HOLIDAY' END AS code, "date" FROM (
             SELECT event_type AS artifact_id, event_id AS row_no, event_id % 14 = 1 OR event_id % 15 = 2 AS bad,
               CASE WHEN event_id % 14 <> 1 THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS "date" FROM events)"""))


def raw_facts(s, p):
    k = F.col("filing_id") % 1000
    f = src.filings(s, p).drop("cents").join(src.facts(s, p).drop("nature", "fact_kind"), "filing_id")
    return f.select(
        F.concat(F.lit("FR "), s_(F.col("entity"))).alias("artifact_id"),
        (F.col("filing_id") * 100 + F.length("source_concept")).alias("row_no"), F.concat(F.lit("E"), s_(F.col("entity"))).alias("Symbol"),
        F.lit("EQ").alias("Series"), F.concat(F.lit("IN"), F.lpad(s_(F.col("entity")), 10, "0")).alias("ISIN"), s_(F.col("filing_id")).alias("Filing ID"),
        s_(F.col("supersedes_id")).alias("Supersedes Filing ID"), F.lit("results").alias("Filing Type"),
        F.when(k % 19 == 3, "WEEKLY").otherwise("quarterly").alias("Frequency"), s_(F.col("period_start")).alias("Period Start"),
        F.when(k % 23 == 4, "1990-01-01").otherwise(s_(F.col("period_end"))).alias("Period End"), s_(F.col("fiscal_year")).alias("Fiscal Year"),
        F.when(k % 13 == 5, "5").otherwise(s_(F.col("fiscal_quarter"))).alias("Quarter"), F.col("scope").alias("Scope"), F.lit("").alias("Audit Status"),
        F.date_format("available_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Submitted At"), F.col("source_concept").alias("Particulars"),
        F.coalesce(s_(F.col("value")), F.lit("-")).alias("Value"), F.lit("INR").alias("Unit"), F.when(k % 11 == 6, "13").otherwise("0").alias("Scale"),
        F.lit("duration").alias("Fact Kind"), F.lit("quarterly").alias("Value Nature"))


part("fact_rows", ("filings", "facts"), """
  SELECT 'FR ' || CAST(entity AS VARCHAR) AS artifact_id, f.filing_id * 100 + length(source_concept) AS row_no, f.filing_id AS fid, f.filing_id % 1000 AS k, source_concept,
    f.value, h.* EXCLUDE (filing_id) FROM facts f JOIN filings h ON h.filing_id = f.filing_id""")
add("i08_norm_fundamental_facts",
    lambda s, p: outcome(ingest.norm_fundamental_facts(artifacts.resolve_headers(raw_facts(s, p), "fundamental_facts")), "source_filing_id", F.when(
        F.col("issue.code").isNull(), F.col("value").cast("double")).alias("value"), "audit_status"),
    sql("""SELECT artifact_id, row_no, code, CAST(fid AS VARCHAR) AS source_filing_id, CASE WHEN code IS NULL THEN CAST(value AS DOUBLE) END AS value,
           'UNKNOWN' AS audit_status FROM (SELECT *, CASE WHEN k % 19 = 3 OR k % 23 = 4 OR k % 13 = 5 OR k % 11 = 6 THEN 'MALFORMED_FUNDAMENTAL_FACT' END AS code
           FROM fact_rows)""", "fact_rows"))


def raw_classes(s, p):
    k = F.col("series")
    return src.classifications(s, p).select(
        F.lit("IC").alias("artifact_id"), (F.col("series") + F.year("snapshot_date").cast("bigint") * 10000000).alias("row_no"), F.concat(F.lit("S"), s_(k)).alias("Symbol"),
        F.lit("EQ").alias("Series"), F.concat(F.lit("IN"), F.lpad(s_(k), 10, "0")).alias("ISIN"), F.col("macro").alias("Macro-Economic Sector"),
        F.col("sector").alias("Sector"), F.when(k % 8 == 3, "").otherwise(F.col("industry")).alias("Industry"), F.col("basic_industry").alias("Basic Industry"))


add("i09_norm_classification",
    lambda s, p: outcome(ingest.norm_classification(artifacts.resolve_headers(raw_classes(s, p), "classification")), "sector"),
    sql("""SELECT 'IC' AS artifact_id, series + year(snapshot_date) * 10000000 AS row_no, CASE WHEN series % 8 = 3 THEN 'MALFORMED_INDUSTRY_CLASSIFICATION'
           WHEN year(snapshot_date) = 2000 THEN 'DUPLICATE_INDUSTRY_CLASSIFICATION' END AS code, sector FROM classifications""", "classifications"))


# --- I10, I11, I30: filings as XML documents spelled from the quarterly facts -----------------------------------------------
XML_HEAD = ('<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:t="urn:example:facts"><context id="OneD"><period><startDate>%s</startDate>'
            '<endDate>%s</endDate></period></context><context id="OneI"><period><instant>%s</instant></period></context>')


def xml_files(s, p):
    """One document per filing; a filing has a handful of facts."""
    f = src.facts(s, p).where("value IS NOT NULL")
    tag = F.regexp_replace("source_concept", " ", "")
    ctx = F.when(F.col("fact_kind") == "INSTANT", "OneI").otherwise("OneD")
    line = F.format_string('<t:%s contextRef="%s" unitRef="INR">%s</t:%s>', tag, ctx, s_(F.col("value")), tag)
    body = f.groupBy("filing_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("body"))
    h = src.filings(s, p).join(body, "filing_id")
    told = F.when(F.col("filing_id") % 11 == 3, "OTHER").otherwise(F.concat(F.lit("E"), s_(F.col("entity"))))
    identity = F.format_string(
        '<t:Symbol contextRef="OneD">%s</t:Symbol><t:ISIN contextRef="OneD">%s</t:ISIN><t:NatureOfReportStandaloneConsolidated '
        'contextRef="OneD">%s</t:NatureOfReportStandaloneConsolidated>', told, F.concat(F.lit("IN"), F.lpad(s_(F.col("entity")), 10, "0")), "scope")
    text = F.concat(F.format_string(XML_HEAD, s_(F.col("period_start")), s_(F.col("period_end")), s_(F.col("period_end"))), identity, "body", F.lit("</xbrl>"))
    return h.select(F.concat(s_(F.col("filing_id")), F.lit(".xml")).alias("file_name"), F.encode(text, "UTF-8").alias("content"),
                    F.concat(F.lit("E"), s_(F.col("entity"))).alias("symbol"), "scope", "period_end", "filing_id", "available_at", "entity")


def listing(s, p):
    """Listing rows: one in thirteen filings is missing a row, one in seventeen has two, one extra row has no file."""
    x = xml_files(s, p).drop("content").withColumn("broadcast_at", F.col("available_at"))
    rows = x.where("filing_id % 13 <> 5").select("file_name", "symbol", "scope", "period_end", "broadcast_at", "filing_id", "entity")
    extra = rows.where("filing_id % 17 = 6")
    lost = rows.where("filing_id % 29 = 7").withColumn("file_name", F.concat(F.lit("lost-"), "file_name"))
    return rows.unionByName(extra).unionByName(lost).drop("filing_id", "entity")


def linked(s, p):
    return artifacts.link_listing_to_files(listing(s, p), xml_files(s, p))


def file_facts(s, p):
    ok = linked(s, p).where("link = 'LINKED'").select("file_name", "symbol", "scope", "period_end")
    return artifacts.xbrl_facts(xml_files(s, p).select("file_name", "content").join(ok, "file_name"), ("urn:example:facts",))


part("lst0", ("filings",), "SELECT *, CAST(filing_id AS VARCHAR) || '.xml' AS file_name FROM filings")
part("lst", ("lst0",), """SELECT * FROM lst0 WHERE filing_id % 13 <> 5 UNION ALL SELECT * FROM lst0 WHERE filing_id % 13 <> 5 AND filing_id % 17 = 6
  UNION ALL SELECT * REPLACE ('lost-' || file_name AS file_name) FROM lst0 WHERE filing_id % 13 <> 5 AND filing_id % 29 = 7""")
part("lnk", ("lst", "lst0"), """
  SELECT coalesce(l.file_name, f.file_name) AS file_name, l.scope, l.available_at AS broadcast_at, l.filing_id, CASE WHEN l.file_name IS NULL THEN 'UNLINKED' WHEN f.file_name IS NULL
    THEN 'MISSING_FILE' WHEN count(*) OVER (PARTITION BY l.file_name) > 1 THEN 'AMBIGUOUS_LISTING_LINK' ELSE 'LINKED' END AS link, l.file_name AS listing_file
  FROM lst l FULL JOIN lst0 f ON f.file_name = l.file_name""")
part("xfacts", ("lnk", "facts", "lst0"), """
  SELECT k.file_name, CASE WHEN k.filing_id % 11 = 3 THEN 'symbol does not match the listing' END AS error, replace(source_concept, ' ', '') AS concept,
    nature, value, fact_start FROM lnk k JOIN facts f USING (filing_id) WHERE link = 'LINKED' AND f.value IS NOT NULL""")
add("i10_xbrl_facts",
    lambda s, p: texted(file_facts(s, p).select("file_name", "error", "concept", "nature", F.col("value").cast("double").alias("value"), "fact_start"), "fact_start"),
    sql(f"""SELECT file_name, error, concept, nature, CAST(value AS DOUBLE) AS value, {d('fact_start')} FROM xfacts WHERE error IS NULL
            UNION ALL SELECT DISTINCT file_name, error, NULL, NULL, NULL, NULL FROM xfacts WHERE error IS NOT NULL""", "xfacts"))
add("i11_link_listing_to_files",
    lambda s, p: linked(s, p).select("file_name", "link", "scope"),
    sql("SELECT file_name, link, scope FROM lnk", "lnk"))
add("i30_filing_batch_report",
    lambda s, p: texted(merge.filing_batch_report(linked(s, p), file_facts(s, p).where("error IS NULL")), "first_available", "last_available"),
    sql(f"""SELECT count(listing_file) AS listing_rows, count(*) FILTER (WHERE link = 'LINKED') AS matched,
        count(*) FILTER (WHERE link IN ('UNLINKED', 'AMBIGUOUS_LISTING_LINK')) AS rejected, count(*) FILTER (WHERE link = 'MISSING_FILE') AS missing_files,
        strftime(min(broadcast_at) FILTER (WHERE link = 'LINKED'), '%Y-%m-%d %H:%M:%S') AS first_available,
        strftime(max(broadcast_at) FILTER (WHERE link = 'LINKED'), '%Y-%m-%d %H:%M:%S') AS last_available,
        array_to_string(list_sort(list(DISTINCT scope) FILTER (WHERE link = 'LINKED')), ',') AS scopes,
        (SELECT count(*) FROM xfacts WHERE error IS NULL) AS facts,
        (SELECT count(*) FROM xfacts WHERE error IS NULL AND concept <> 'OrderBacklog') AS mapped,
        (SELECT count(*) FROM xfacts WHERE error IS NULL AND concept = 'OrderBacklog') AS unmapped FROM lnk""", "lnk", "xfacts"))


# --- I16-I18 ---------------------------------------------------------------------------------------------------------------
def master(s, p):
    return src.securities(s, p).where("series % 20 <> 7").withColumn("board", F.when(F.col("series") % 25 == 8, "BE").otherwise("EQ"))


def incoming_rows(s, p):
    k = F.col("series")
    return src.securities(s, p).select(
        k.alias("k"), "symbol", F.when(k % 3 == 0, F.lit(None)).when(k % 22 == 5, F.concat(F.lit("IN"), F.lpad(s_(k + 1), 10, "0"))).otherwise(
            F.col("isin")).alias("isin"), F.lit("EQ").alias("board"), F.when(k % 9 == 4, "New Name").otherwise(F.col("company_name")).alias("company_name"))


part("master", ("securities",), "SELECT * REPLACE (CASE WHEN series % 25 = 8 THEN 'BE' ELSE 'EQ' END AS board) FROM securities WHERE series % 20 <> 7")
part("inc", ("securities",), """SELECT series AS k, symbol, CASE WHEN series % 3 = 0 THEN NULL WHEN series % 22 = 5 THEN 'IN' || lpad(CAST(series + 1 AS VARCHAR), 10, '0')
  ELSE isin END AS isin, CASE WHEN series % 9 = 4 THEN 'New Name' ELSE company_name END AS company_name FROM securities""")
add("i16_resolve_identity",
    lambda s, p: merge.resolve_identity(incoming_rows(s, p), master(s, p)).select("k", "key", "identity_issue"),
    sql("""SELECT k, CASE WHEN why IS NULL THEN k1 END AS key, why AS identity_issue FROM (SELECT i.k, a.series AS k1, CASE WHEN a.series IS NULL THEN
        'SECURITY_NOT_IN_MASTER' WHEN (i.isin IS NOT NULL AND a.series IS DISTINCT FROM b.series) OR a.board <> 'EQ' THEN 'AMBIGUOUS_SECURITY' END AS why
        FROM inc i LEFT JOIN master a ON a.symbol = i.symbol LEFT JOIN master b ON b.isin = i.isin)""", "inc", "master"))


def stored_prices(s, p):
    b = src.bars(s, p).where("session < '2000-01-03'")
    k = F.col("series") + F.dayofmonth("session")
    return b.withColumns({"close": F.when(k % 53 == 1, F.col("close") + 1).otherwise(F.col("close")),
                          "origin": F.when(k % 59 == 2, "DEMO").otherwise("OFFICIAL")}).drop("n")


def price_merge(s, p):
    return merge.merge_prices(src.bars(s, p).drop("n"), stored_prices(s, p), _holidays(s, p))


def _holidays(s, p):
    return src.calendar(s, p).withColumn("is_trading_day", F.dayofyear("session") % 50 != 3)


part("pmerge", ("bars",), """
  SELECT series, session, CASE WHEN dayofyear(session) % 50 = 3 THEN 'CONFLICT' WHEN session >= DATE '2000-01-03' THEN 'INSERT'
    WHEN k % 59 = 2 OR k % 53 = 1 THEN 'CONFLICT' ELSE 'UNCHANGED' END AS action,
    CASE WHEN dayofyear(session) % 50 = 3 THEN 'CALENDAR_CONFLICT' WHEN session < DATE '2000-01-03' AND (k % 59 = 2 OR k % 53 = 1)
    THEN 'HISTORICAL_DATA_CONFLICT' END AS code FROM (SELECT *, series + day(session) AS k FROM bars)""")
add("i17_merge_prices", lambda s, p: texted(price_merge(s, p).select("series", "session", "action", "code"), "session"),
    sql(f"SELECT series, {d('session')}, action, code FROM pmerge", "pmerge"))
add("i17_conflict_hashes",
    lambda s, p: texted(price_merge(s, p).where("action = 'CONFLICT'").select("series", "session", "code", "existing_hash", "incoming_hash"), "session"),
    sql(f"""SELECT series, {d('session')}, code, CASE WHEN session < DATE '2000-01-03' THEN sha256(concat_ws('|', open, high, low,
          close + CASE WHEN (series + day(session)) % 53 = 1 THEN 1 ELSE 0 END, volume, traded_value)) END AS existing_hash,
        sha256(concat_ws('|', open, high, low, close, volume, traded_value)) AS incoming_hash
        FROM pmerge JOIN bars USING (series, session) WHERE action = 'CONFLICT'""", "pmerge", "bars"))
add("i17_confirmed_sessions",
    lambda s, p: texted(merge.confirmed_sessions(price_merge(s, p), _holidays(s, p).where("session < '2001-01-01'")).select("exchange", "session"), "session"),
    sql(f"""SELECT DISTINCT 'X' AS exchange, {d('session')} FROM pmerge WHERE action IN ('INSERT', 'UNCHANGED') AND session NOT IN (
            SELECT session FROM calendar WHERE session < DATE '2001-01-01')""", "pmerge", "calendar"))
add("i18_merge_securities",
    lambda s, p: merge.merge_securities(incoming_rows(s, p), master(s, p)).select("k", "action", "code"),
    sql("""SELECT k, CASE WHEN k1 IS NULL AND k2 IS NULL THEN 'INSERT' WHEN k1 IS DISTINCT FROM k2 OR board <> 'EQ' THEN 'CONFLICT' ELSE 'UNCHANGED' END AS action,
        CASE WHEN k1 IS NULL AND k2 IS NULL THEN NULL WHEN k1 IS DISTINCT FROM k2 OR board <> 'EQ' THEN 'SECURITY_IDENTITY_CONFLICT'
             WHEN n <> company_name THEN 'SECURITY_METADATA_DRIFT' END AS code
        FROM (SELECT i.*, a.series AS k1, a.board, a.company_name AS n, b.series AS k2 FROM inc i LEFT JOIN master a ON a.symbol = i.symbol
              LEFT JOIN master b ON b.isin = i.isin)""", "inc", "master"))


# --- I19-I24 -----------------------------------------------------------------------------------------------------------------
def snapshots(s, p):
    """Two yearly snapshots per index; one lacks members, one lists an unknown member."""
    m = src.securities(s, p).select(F.col("macro").alias("index_id"), "series")
    rows = m.select("index_id", "series", F.explode(F.array(src.day("2001-01-01"), src.day("2002-01-07"))).alias("snapshot_date"))
    second = F.col("snapshot_date") == src.day("2002-01-07")
    rows = rows.where(~((F.col("index_id") == "AFRICA") & second & (F.col("series") % 5 == 0)))
    gone = (F.col("index_id") == "ASIA") & second & (F.col("series") % 7 == 1)
    return rows.select("index_id", "snapshot_date", F.when(~gone, F.col("series")).alias("key"))


def stored_members(s, p):
    same = src.securities(s, p).where("macro = 'EUROPE' OR (macro = 'AMERICA' AND series % 6 <> 2)").select(
        F.col("macro").alias("index_id"), "series", src.day("2001-01-01").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return src.memberships(s, p).unionByName(same)


def status(s, p):
    sizes = src.securities(s, p).groupBy(F.col("macro").alias("index_id")).agg(F.count(F.lit(1)).alias("expected"))
    return merge.snapshot_status(snapshots(s, p), stored_members(s, p), sizes)


part("snaps", ("securities",), """SELECT macro AS index_id, sd AS snapshot_date, CASE WHEN NOT (macro = 'ASIA' AND sd = DATE '2002-01-07' AND series % 7 = 1)
  THEN series END AS key FROM securities, (VALUES (DATE '2001-01-01'), (DATE '2002-01-07')) v(sd)
  WHERE NOT (macro = 'AFRICA' AND sd = DATE '2002-01-07' AND series % 5 = 0)""")
part("stored_members", ("memberships", "securities"), """SELECT * FROM memberships UNION ALL SELECT macro, series, DATE '2001-01-01', NULL FROM securities
  WHERE macro = 'EUROPE' OR (macro = 'AMERICA' AND series % 6 <> 2)""")
part("snap_status", ("snaps", "stored_members", "securities"), """
  SELECT index_id, snapshot_date, members, CASE WHEN unresolved > 0 OR members <> expected THEN 'REJECT' WHEN have = 0 THEN 'INSERT' WHEN diff = 0 THEN 'UNCHANGED'
    ELSE 'CONFLICT' END AS action, CASE WHEN unresolved > 0 THEN 'UNKNOWN_INDEX_SECURITY' WHEN members <> expected THEN 'UNEXPECTED_MEMBER_COUNT'
    WHEN have > 0 AND diff > 0 THEN 'INDEX_SNAPSHOT_CONFLICT' END AS code
  FROM (SELECT index_id, snapshot_date, count(*) AS members, count(*) FILTER (WHERE key IS NULL) AS unresolved,
    (SELECT count(*) FROM securities z WHERE z.macro = s.index_id) AS expected,
    (SELECT count(*) FROM stored_members m WHERE m.index_id = s.index_id AND m.valid_from = s.snapshot_date) AS have,
    (SELECT count(*) FROM ((SELECT series FROM stored_members m WHERE m.index_id = s.index_id AND m.valid_from = s.snapshot_date
        EXCEPT SELECT key FROM snaps x WHERE x.index_id = s.index_id AND x.snapshot_date = s.snapshot_date)
      UNION ALL (SELECT key FROM snaps x WHERE x.index_id = s.index_id AND x.snapshot_date = s.snapshot_date AND key IS NOT NULL
        EXCEPT SELECT series FROM stored_members m WHERE m.index_id = s.index_id AND m.valid_from = s.snapshot_date))) AS diff
    FROM snaps s GROUP BY 1, 2)""")


add("i19_snapshot_status",
    lambda s, p: texted(status(s, p).select("index_id", "snapshot_date", "members", "action", "code"), "snapshot_date"),
    sql(f"SELECT index_id, {d('snapshot_date')}, members, action, code FROM snap_status", "snap_status"))
part("fresh", ("snaps", "snap_status"), """
  SELECT s.index_id, s.key AS series, s.snapshot_date AS valid_from, (SELECT min(o.snapshot_date) - 1 FROM snap_status o WHERE o.index_id = s.index_id
    AND o.action = 'INSERT' AND o.snapshot_date > s.snapshot_date) AS valid_to
  FROM snaps s JOIN snap_status t ON t.index_id = s.index_id AND t.snapshot_date = s.snapshot_date AND t.action = 'INSERT'""")
add("i19_snapshot_to_intervals",
    lambda s, p: texted(merge.snapshot_to_intervals(stored_members(s, p), snapshots(s, p), status(s, p)), "valid_from", "valid_to"),
    sql(f"""SELECT index_id, series, {d('valid_from')}, CAST(coalesce(valid_to, (SELECT min(o.snapshot_date) - 1 FROM snap_status o WHERE o.index_id = m.index_id
            AND o.action = 'INSERT' AND o.snapshot_date > m.valid_from)) AS VARCHAR) AS valid_to FROM stored_members m
            UNION ALL SELECT index_id, series, {d('valid_from')}, {d('valid_to')} FROM fresh""", "stored_members", "snap_status", "fresh"))


def stored_index(s, p):
    return src.benchmark_prices(s, p).where("session < '2000-01-03'").withColumn(
        "close", F.when(F.dayofyear("session") % 31 == 4, F.col("close") - 1).otherwise(F.col("close")))


def _hashes(df):
    clash = F.col("action") == "CONFLICT"
    return df.select("index_id", "session", "action", "code", "existing_hash", "incoming_hash").withColumn("session", s_(F.col("session")))


add("i20_merge_index_prices",
    lambda s, p: _hashes(merge.merge_index_prices(src.benchmark_prices(s, p), stored_index(s, p))),
    sql(f"""SELECT index_id, {d('session')}, CASE WHEN session >= DATE '2000-01-03' THEN 'INSERT' WHEN clash THEN 'CONFLICT' ELSE 'UNCHANGED' END AS action,
        CASE WHEN clash THEN 'INDEX_PRICE_CONFLICT' END AS code, CASE WHEN clash THEN sha256(concat_ws('|', open, high, low, close - 1)) END AS existing_hash,
        CASE WHEN clash THEN sha256(concat_ws('|', open, high, low, close)) END AS incoming_hash
        FROM (SELECT *, session < DATE '2000-01-03' AND dayofyear(session) % 31 = 4 AS clash FROM benchmark_prices)""", "benchmark_prices"))


KNOWN = "2001-07-01 12:30:00"
add("i20_index_prices_known_at",
    lambda s, p: texted(merge.merge_index_prices(
        src.benchmark_prices(s, p).drop("available_at"), stored_index(s, p), F.lit(KNOWN).cast("timestamp")).select("index_id", "session", "action", "available_at"),
        "session", "available_at"),
    sql(f"""SELECT index_id, {d('session')}, CASE WHEN session >= DATE '2000-01-03' THEN 'INSERT' WHEN dayofyear(session) % 31 = 4 THEN 'CONFLICT' ELSE 'UNCHANGED' END AS action,
        CASE WHEN session >= DATE '2000-01-03' THEN '{KNOWN}' END AS available_at FROM benchmark_prices""", "benchmark_prices"))


def incoming_actions(s, p):
    return src.actions(s, p).where("supersedes_id IS NULL").select(
        "id", "series", "type", "ex_date", F.when(F.col("series") % 40 == 0, F.col("num") + 1).otherwise(F.col("num")).cast("decimal(18,8)").alias("num"), "den",
        F.when(F.col("id") % 10 != 3, F.col("available_at")).alias("published_at"))


add("i21_merge_actions",
    lambda s, p: merge.merge_actions(incoming_actions(s, p), src.actions(s, p).where("series % 30 <> 5"), src.securities(s, p).where("series % 50 <> 10")).select(
        "id", "action", "code"),
    sql("""SELECT id, CASE WHEN series % 50 = 10 THEN 'REJECT' WHEN series % 30 = 5 THEN 'INSERT' WHEN series % 40 = 0 THEN 'CONFLICT' ELSE 'UNCHANGED' END AS action,
        CASE WHEN series % 50 = 10 THEN 'AMBIGUOUS_SECURITY' WHEN series % 30 = 5 THEN NULL WHEN series % 40 = 0 THEN 'CORPORATE_ACTION_REVISION_UNRESOLVED' END AS code
        FROM actions WHERE supersedes_id IS NULL AND id % 10 <> 3""", "actions"))


def holidays(s, p):
    return src.table(s, p, "orders").select(F.to_date("o_orderdate").alias("session")).distinct()


add("i22_merge_holidays",
    lambda s, p: texted(merge.merge_holidays(holidays(s, p), src.full_calendar(s, p)).select("session", "action", "code"), "session"),
    sql(f"""SELECT CAST(h.session AS VARCHAR) AS session, CASE WHEN c.session IS NULL THEN 'INSERT' WHEN is_trading_day THEN 'CONFLICT' ELSE 'UNCHANGED' END AS action,
        CASE WHEN is_trading_day THEN 'CALENDAR_CONFLICT' END AS code FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders) h
        LEFT JOIN full_calendar c ON c.session = h.session""", "full_calendar"))


def norm_facts(s, p):
    return ingest.accepted(ingest.norm_fundamental_facts(artifacts.resolve_headers(raw_facts(s, p), "fundamental_facts")))


def groups(s, p):
    k = F.col("source_filing_id").cast("bigint")
    rows = norm_facts(s, p).withColumn("scope", F.when((k % 37 == 5) & (F.col("source_concept") == "Basic EPS"), "STANDALONE X").otherwise(F.col("scope")))
    return merge.filing_groups(rows)


def filing_merge(s, p):
    """What is stored alone counts as a predecessor."""
    return merge.merge_filings(*filing_sides(s, p), in_batch=False)


def filing_sides(s, p):
    """Stored: the originals of the first years, of which one in nine has other content."""
    g = groups(s, p)
    k = F.col("source_filing_id").cast("bigint")
    stored = g.where("fiscal_year < 1999 AND supersedes_source_filing_id IS NULL").select("symbol", "source_filing_id", F.when(k % 9 == 2, "old").otherwise(
        F.col("fingerprint")).alias("fingerprint"), "supersedes_source_filing_id")
    revised = g.where("fiscal_year < 1997 AND supersedes_source_filing_id IS NOT NULL").select(
        "symbol", F.concat(F.lit("R"), "source_filing_id").alias("source_filing_id"), F.lit("r").alias("fingerprint"), "supersedes_source_filing_id")
    sec = g.select("symbol", "isin").distinct().where("symbol <> 'E4'")
    return g, stored.unionByName(revised), sec


def revised_batch(s, p):
    """Every revision of the batch once more as a rival, later in the batch, and revised itself (two generations)."""
    g, stored, sec = filing_sides(s, p)
    again = g.where("supersedes_source_filing_id IS NOT NULL")

    def like(suffix, old, step):
        return again.withColumns({
            "supersedes_source_filing_id": old, "source_filing_id": F.concat("source_filing_id", F.lit(suffix)), "fingerprint": F.concat("fingerprint", F.lit(suffix)),
            "place": F.struct(F.col("place.artifact_id").alias("artifact_id"), (F.col("place.row_no") + step * 10**12).alias("row_no"))})

    more = [like("F", F.col("supersedes_source_filing_id"), 1), like("G", F.col("source_filing_id"), 2), like("H", F.concat("source_filing_id", F.lit("G")), 3)]
    for part_ in more:
        g = g.unionByName(part_)
    return merge.merge_filings(g, stored, sec)


part("fgroups", ("fact_rows",), """
  SELECT fid, entity, fiscal_year, supersedes_id, count(*) AS facts, bool_or(fid % 37 = 5 AND source_concept = 'Basic EPS') AND count(*) > 1 AS inconsistent FROM fact_rows
  WHERE NOT (k % 19 = 3 OR k % 23 = 4 OR k % 13 = 5 OR k % 11 = 6) GROUP BY ALL""")
part("fmerge", ("fgroups",), """
  SELECT CAST(fid AS VARCHAR) AS source_filing_id, facts, CASE WHEN entity = 4 THEN 'FUNDAMENTAL_SECURITY_IDENTITY_UNRESOLVED' WHEN inconsistent THEN
      'INCONSISTENT_FILING_METADATA' WHEN fiscal_year < 1999 AND supersedes_id IS NULL AND fid % 9 <> 2 THEN 'same'
      WHEN supersedes_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fgroups p WHERE p.fid = g.supersedes_id AND p.fiscal_year < 1999 AND p.supersedes_id IS NULL)
        THEN 'SUPERSEDED_FILING_NOT_FOUND'
      WHEN supersedes_id IS NOT NULL AND fiscal_year < 1997 THEN 'FILING_REVISION_CONFLICT'
      WHEN fiscal_year < 1999 AND supersedes_id IS NULL THEN 'FILING_CONTENT_CONFLICT' END AS code FROM fgroups g""")
add("i23_merge_filings",
    lambda s, p: filing_merge(s, p).select("source_filing_id", "facts", "action", "code"),
    sql("""SELECT source_filing_id, facts, CASE WHEN code IS NULL THEN 'INSERT' WHEN code = 'same' THEN 'UNCHANGED' WHEN code IN ('SUPERSEDED_FILING_NOT_FOUND',
        'FUNDAMENTAL_SECURITY_IDENTITY_UNRESOLVED') THEN 'REJECT' ELSE 'CONFLICT' END AS action, nullif(code, 'same') AS code FROM fmerge""", "fmerge"))
part("chained", ("fgroups",), """
  WITH own AS (
    SELECT CAST(fid AS VARCHAR) AS id, facts, entity, inconsistent, fiscal_year, CAST(supersedes_id AS VARCHAR) AS up, 0 AS step, fid FROM fgroups
    UNION ALL SELECT fid || v.suffix, facts, entity, inconsistent, fiscal_year, CASE suffix WHEN 'F' THEN CAST(supersedes_id AS VARCHAR) WHEN 'G' THEN CAST(fid AS VARCHAR)
      ELSE fid || 'G' END, step, fid FROM fgroups, (VALUES ('F', 1), ('G', 2), ('H', 3)) v(suffix, step) WHERE supersedes_id IS NOT NULL),
  flagged AS (SELECT *, entity = 4 AS lost, fiscal_year < 1999 AND up IS NULL AS stored, fiscal_year < 1999 AND up IS NULL AND fid % 9 <> 2 AS same,
      fiscal_year < 1997 AND up IS NOT NULL AND step < 2 AS taken FROM own),
  d0 AS (SELECT f.*, p.stored AS up_stored, p.id IS NOT NULL AND NOT p.stored AND NOT p.lost AND NOT p.inconsistent AND p.up IS NULL AS up_fresh,
      row_number() OVER (PARTITION BY f.up, NOT f.lost AND NOT f.inconsistent AND NOT f.taken ORDER BY f.step) > 1 AND NOT f.lost AND NOT f.inconsistent AND NOT f.taken AS beaten
    FROM flagged f LEFT JOIN flagged p ON p.id = f.up),
  d1 AS (SELECT *, NOT lost AND NOT inconsistent AND NOT taken AND NOT beaten AND (up_stored OR up_fresh) AS in1 FROM d0 WHERE up IS NOT NULL AND step < 2),
  d2 AS (SELECT g.id, r.in1 AS found FROM d0 g JOIN d1 r ON r.id = g.up WHERE g.step = 2),
  d3 AS (SELECT h.id, d2.found AND NOT g.lost AND NOT g.inconsistent AS found FROM d0 h JOIN d0 g ON g.id = h.up JOIN d2 ON d2.id = g.id WHERE h.step = 3)
  SELECT d0.id, facts, CASE WHEN lost THEN 'FUNDAMENTAL_SECURITY_IDENTITY_UNRESOLVED' WHEN inconsistent THEN 'INCONSISTENT_FILING_METADATA' WHEN same THEN 'same'
    WHEN d0.up IS NOT NULL AND NOT coalesce(CASE WHEN step < 2 THEN up_stored OR up_fresh END, d2.found, d3.found, false) THEN 'SUPERSEDED_FILING_NOT_FOUND'
    WHEN taken OR (d0.up IS NOT NULL AND beaten) THEN 'FILING_REVISION_CONFLICT' WHEN stored THEN 'FILING_CONTENT_CONFLICT' END AS code
  FROM d0 LEFT JOIN d2 ON d2.id = d0.id LEFT JOIN d3 ON d3.id = d0.id""")
add("i23_revisions_in_one_batch",
    lambda s, p: revised_batch(s, p).select("source_filing_id", "facts", "action", "code"),
    sql("""SELECT id AS source_filing_id, facts, CASE WHEN code IS NULL THEN 'INSERT' WHEN code = 'same' THEN 'UNCHANGED' WHEN code IN ('SUPERSEDED_FILING_NOT_FOUND',
        'FUNDAMENTAL_SECURITY_IDENTITY_UNRESOLVED') THEN 'REJECT' ELSE 'CONFLICT' END AS action, nullif(code, 'same') AS code FROM chained""", "chained"))
add("i23_unmapped_concepts",
    lambda s, p: merge.unmapped_concepts(norm_facts(s, p)),
    sql("""SELECT source_concept, count(*) AS facts FROM fact_rows WHERE NOT (k % 19 = 3 OR k % 23 = 4 OR k % 13 = 5 OR k % 11 = 6)
        AND source_concept = 'Order Backlog' GROUP BY 1""", "fact_rows"))


def class_merge(s, p):
    stored = src.classifications(s, p).where("series % 4 <> 1").withColumn("industry", F.when(F.col("series") % 12 == 6, "Other").otherwise(F.col("industry")))
    return merge.merge_classification(src.classifications(s, p), stored, src.securities(s, p).where("series % 16 <> 2"), MAP)


add("i24_merge_classification",
    lambda s, p: texted(class_merge(s, p).select("series", "snapshot_date", "action", "code", "benchmark"), "snapshot_date"),
    sql(f"""SELECT series, {d('snapshot_date')}, CASE WHEN series % 16 = 2 THEN 'REJECT' WHEN series % 4 = 1 THEN 'INSERT' WHEN series % 12 = 6 THEN 'CONFLICT'
        ELSE 'UNCHANGED' END AS action, CASE WHEN series % 16 = 2 THEN 'CLASSIFICATION_SECURITY_IDENTITY_UNRESOLVED' WHEN series % 4 <> 1 AND series % 12 = 6
        THEN 'CLASSIFICATION_SNAPSHOT_CONFLICT' END AS code, {MAP_SQL} AS benchmark FROM classifications""", "classifications"))

def classes_twice(s, p):
    """Every row comes twice in the batch, one in five with another industry the second time."""
    rows = src.classifications(s, p).withColumn("row_no", F.lit(1))
    changed = F.when(F.col("series") % 5 == 2, "Changed").otherwise(F.col("industry"))
    stored = src.classifications(s, p).where("series % 4 <> 1")
    return merge.merge_classification(rows.unionByName(rows.withColumns({"row_no": F.lit(2), "industry": changed})), stored, src.securities(s, p).where("series % 16 <> 2"), MAP)


add("i24_classification_twice_in_one_batch",
    lambda s, p: texted(classes_twice(s, p).select("series", "snapshot_date", "row_no", "action", "code"), "snapshot_date"),
    sql(f"""SELECT series, {d('snapshot_date')}, row_no, CASE WHEN series % 16 = 2 THEN 'REJECT' WHEN series % 5 = 2 AND row_no = 2 THEN 'CONFLICT'
        WHEN series % 4 = 1 AND row_no = 1 THEN 'INSERT' ELSE 'UNCHANGED' END AS action, CASE WHEN series % 16 = 2 THEN 'CLASSIFICATION_SECURITY_IDENTITY_UNRESOLVED'
        WHEN series % 5 = 2 AND row_no = 2 THEN 'CLASSIFICATION_SNAPSHOT_CONFLICT' END AS code FROM classifications, (VALUES (1), (2)) v(row_no)""", "classifications"))

# --- I25-I29 -------------------------------------------------------------------------------------------------------------------
add("i25_artifact_identity",
    lambda s, p: merge.artifact_identity(src.artifact_log(s, p).select("artifact_id", "provider", "artifact_type", "source_date", "sha256"),
                                         src.artifact_log(s, p).where("artifact_id % 3 = 0")).select("artifact_id", "state"),
    sql("""SELECT artifact_id, CASE WHEN EXISTS (SELECT 1 FROM artifact_log b WHERE b.artifact_id % 3 = 0 AND b.provider = a.provider AND b.artifact_type = a.artifact_type
        AND b.source_date = a.source_date AND b.sha256 = a.sha256) THEN 'SEEN' WHEN EXISTS (SELECT 1 FROM artifact_log b WHERE b.artifact_id % 3 = 0
        AND b.provider = a.provider AND b.artifact_type = a.artifact_type AND b.source_date = a.source_date) THEN 'REVISION_CONFLICT' ELSE 'NEW' END AS state
        FROM artifact_log a""", "artifact_log"))


def _summary(s, p):
    merged = price_merge(s, p).withColumn("artifact_id", F.concat(F.lit("EOD "), s_(F.col("session"))))
    counts = ingest.issue_counts(ingest.rejected(prices_norm(s, p)))
    return merge.ingest_summary(merged, counts)


add("i26_ingest_summary", _summary, sql("""
  SELECT artifact_id, coalesce(ins, 0) AS inserted, coalesce(unch, 0) AS unchanged, coalesce(conf, 0) + coalesce(rej, 0) AS rejected, coalesce(conf, 0) AS conflicts,
    0 AS warnings, CASE WHEN coalesce(conf, 0) + coalesce(rej, 0) > 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS status
  FROM (SELECT 'EOD ' || CAST(session AS VARCHAR) AS artifact_id, count(*) FILTER (WHERE action = 'INSERT') AS ins, count(*) FILTER (WHERE action = 'UNCHANGED') AS unch,
        count(*) FILTER (WHERE action = 'CONFLICT') AS conf FROM pmerge GROUP BY 1) a
  FULL JOIN (SELECT artifact_id, count(*) AS rej FROM price_norm WHERE code IS NOT NULL GROUP BY 1) b USING (artifact_id)""", "pmerge", "price_norm"))


def _fetch(bench):
    def run(s, p):
        log = src.artifact_log(s, p).withColumn("source_date", F.date_sub("source_date", 9000)).where("provider = 'click' AND artifact_id % 40 = 1")
        return texted(merge.sessions_to_fetch(src.full_calendar(s, p), src.benchmark_prices(s, p).where(bench), log, "1999-05-03", "1999-07-30"), "session")
    return run


FETCHED = "SELECT source_date - 9000 FROM artifact_log WHERE provider = 'click' AND artifact_id % 40 = 1 AND status IN ('SUCCEEDED', 'PARTIAL')"
add("i27_sessions_to_fetch_benchmark", _fetch("true"), sql(f"""
  SELECT DISTINCT {d('session')} FROM benchmark_prices WHERE session BETWEEN DATE '1999-05-03' AND DATE '1999-07-30' AND session NOT IN ({FETCHED})""",
    "benchmark_prices", "artifact_log"))
add("i27_sessions_to_fetch_weekdays", _fetch("session > '1999-06-01'"), sql(f"""
  SELECT CAST(CAST(t AS DATE) AS VARCHAR) AS session FROM range(DATE '1999-05-03', DATE '1999-07-31', INTERVAL 1 DAY) r(t) WHERE isodow(t) < 6
    AND CAST(t AS DATE) NOT IN (SELECT session FROM full_calendar WHERE NOT is_trading_day) AND CAST(t AS DATE) NOT IN ({FETCHED})""",
    "full_calendar", "artifact_log"))


def _backfill(s, p):
    a = src.actions(s, p).withColumns({
        "published_at": F.when(F.col("series") % 3 == 0, F.col("available_at")), "announcement_date": F.when(F.col("series") % 4 != 1, F.date_sub("ex_date", 20)),
        "ingested_at": F.to_timestamp(F.lit("2002-01-01 00:00:00"))})
    return texted(ingest.availability_backfill(a).select("id", "available_at"), "available_at")


add("i28_availability_backfill", _backfill, sql(f"""
  SELECT id, strftime(coalesce(CASE WHEN series % 3 = 0 THEN available_at END, CASE WHEN series % 4 <> 1 THEN ex_date - 20 + INTERVAL 86399 SECOND - INTERVAL 330 MINUTE END,
    TIMESTAMP '2002-01-01 00:00:00'), '%Y-%m-%d %H:%M:%S') AS available_at FROM actions""", "actions"))
add("i29_batch_report",
    lambda s, p: merge.batch_report(src.artifact_log(s, p).withColumn("status", F.when(F.col("artifact_id") % 23 == 0, "SEEN").when(
        F.col("artifact_id") % 41 == 0, "NON_SESSION").otherwise(F.col("status"))).withColumn("batch", s_(F.col("source_date"))), "batch"),
    sql("""SELECT CAST(source_date AS VARCHAR) AS batch, count(*) AS artifacts, count(*) FILTER (WHERE st = 'FAILED') AS failures, count(*) FILTER (WHERE st = 'SEEN')
        AS skipped_existing, count(*) FILTER (WHERE st = 'NON_SESSION') AS skipped_non_sessions, CAST(sum(inserted) AS BIGINT) AS inserted,
        CAST(sum(unchanged) AS BIGINT) AS unchanged, CAST(sum(rejected) AS BIGINT) AS rejected, CAST(sum(conflicts) AS BIGINT) AS conflicts,
        CAST(sum(warnings) AS BIGINT) AS warnings FROM (SELECT *, CASE WHEN artifact_id % 23 = 0 THEN 'SEEN' WHEN artifact_id % 41 = 0 THEN 'NON_SESSION' ELSE status END AS st
        FROM artifact_log) GROUP BY 1""", "artifact_log"))
