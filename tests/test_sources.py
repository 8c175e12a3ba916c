import gzip
import json
import zipfile
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tapewright.functions import parsing
from tapewright.operators import ingest, merge
from tapewright.sources import artifacts
from tapewright.sources.artifacts import SchemaDrift, header_map
from tapewright.streaming.artifact_folder import follow_folder
from tapewright.streaming.bars import windowed_bars

HEAD = "TradDt,Sgmt,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol"
ROWS = ["2025-01-02,CM,ABC,EQ,10,12,9,11,100", "2025-01-02,CM,ABC,EQ,10,12,9,11,100", "2025-01-02,CM,XYZ,EQ,10,8,9,11,100",
        '2025-01-02,CM,DEF,EQ,"1,010.5000",1020,1000,1015,1.5', "2025-01-03,CM,GHI,EQ,10,12,9,11,100", "2025-01-02,CM,JKL,BE,1,1,1,1,1"]


def codes(df):
    out = ingest.norm_prices(df.withColumn("expected_date", F.lit("2025-01-02").cast("date")))
    return [r.issue.code if r.issue else None for r in out.orderBy("row_no").collect()]


EXPECTED = [None, "DUPLICATE_ARTIFACT_ROW", "INVALID_OHLCV_ROW", "INVALID_OHLCV_ROW", "INVALID_OHLCV_ROW", "UNSUPPORTED_EQUITY_SERIES"]


def test_headers():
    assert header_map(["tckr-symb", "SERIES", "Name", "isin code", ""], "securities")["company_name"] == "Name"
    for bad in (["Symbol", "Series"], ["Symbol", "symbol", "Series", "ISIN", "Name"], []):
        with pytest.raises(SchemaDrift):
            header_map(bad, "securities")


def test_csv_gz_and_zip_agree(spark, tmp_path):
    text = "\n".join([HEAD, *ROWS]) + "\n"
    for kind in ("csv", "gz", "zip"):
        (tmp_path / kind).mkdir()
    (tmp_path / "csv" / "a.csv").write_text(text)
    (tmp_path / "gz" / "a.csv.gz").write_bytes(gzip.compress(text.encode()))
    with zipfile.ZipFile(tmp_path / "zip" / "a.csv.zip", "w") as z:
        z.writestr("a.csv", text)
    assert codes(artifacts.scan_aliased_csv(spark, str(tmp_path / "csv"), "prices")) == EXPECTED
    assert codes(artifacts.scan_aliased_csv(spark, str(tmp_path / "gz"), "prices")) == EXPECTED
    assert codes(artifacts.scan_zipped_csv(spark, str(tmp_path / "zip"), "prices")) == EXPECTED


@pytest.mark.parametrize("wrap", [lambda r: r, lambda r: {"d": json.dumps(r)}, lambda r: {"data": r}, lambda r: json.dumps({"result": r})])
def test_json_shapes(spark, tmp_path, wrap):
    rows = [{"INDEX_NAME": "Nifty 200", "HistoricalDate": "02 Jan 2025", "OPEN": 10, "HIGH": "12", "LOW": 9, "CLOSE": "11.5"}]
    (tmp_path / "x.json").write_text(json.dumps(wrap(rows)))
    out = ingest.norm_index_history(artifacts.scan_index_json(spark, str(tmp_path)), "NIFTY 200").collect()
    assert len(out) == 1 and out[0].issue is None and out[0].trade_date == date(2025, 1, 2) and out[0].close == Decimal("11.500000")


def instance(symbol="ABC", value="5", twice=None):
    extra = f'<t:Revenue contextRef="OneD" unitRef="INR">{twice}</t:Revenue>' if twice else ""
    return ('<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:t="urn:t"><context id="OneD"><period><startDate>2024-10-01</startDate>'
            '<endDate>2024-12-31</endDate></period></context><context id="FourD"><period><startDate>2024-04-01</startDate><endDate>2024-12-31'
            f'</endDate></period></context><t:Symbol contextRef="OneD">{symbol}</t:Symbol><t:ISIN contextRef="OneD">INE000000001</t:ISIN>'
            '<t:NatureOfReportStandaloneConsolidated contextRef="OneD">Consolidated</t:NatureOfReportStandaloneConsolidated>'
            f'<t:Revenue contextRef="OneD" unitRef="INR">{value}</t:Revenue><t:Revenue contextRef="FourD" unitRef="INR">15</t:Revenue>{extra}</xbrl>')


def test_xbrl(spark):
    docs = {"ok": instance(), "same": instance(twice="5.0"), "clash": instance(twice="6"), "who": instance("ZZZ"), "dtd": "<!DOCTYPE x>" + instance(), "cut": "<xbrl", "nan": instance(value="NaN"),
            "long": instance(value="1234567890123456789", twice="1234567890123456788"), "other": instance().replace("2003/instance", "2003/else")}
    df = spark.createDataFrame([(n, bytearray(t.encode()), "ABC", "CONSOLIDATED", date(2024, 12, 31)) for n, t in docs.items()],
                               "file_name string, content binary, symbol string, scope string, period_end date")
    out = artifacts.xbrl_facts(df, ["urn:t"]).collect()
    assert {r.error for r in artifacts.xbrl_facts(df.where("file_name = 'ok'")).collect()} == {"taxonomy is not supported"}
    errors = {r.file_name for r in out if r.error}
    assert errors == {"clash", "who", "dtd", "cut", "nan", "long", "other"}
    ok = {r.nature: r for r in out if r.file_name == "ok"}
    assert set(ok) == {"QUARTERLY", "YTD"} and (ok["QUARTERLY"].fiscal_year, ok["QUARTERLY"].fiscal_quarter) == (2025, 3)
    assert sum(r.file_name == "same" for r in out) == 2


def facts_of(spark, text):
    content = text if isinstance(text, bytes) else text.encode()
    df = spark.createDataFrame([("f", bytearray(content), "ABC", "CONSOLIDATED", date(2024, 12, 31))],
                               "file_name string, content binary, symbol string, scope string, period_end date")
    return artifacts.xbrl_facts(df, ["urn:t"]).collect()


FACT = '<t:Revenue contextRef="OneD" unitRef="INR">5</t:Revenue>'


@pytest.mark.parametrize("change", [
    lambda t: t.replace("</xbrl>", '<!-- <t:Ghost contextRef="OneD" unitRef="INR">999</t:Ghost> --></xbrl>'),
    lambda t: t.replace('"', "'"),
    lambda t: t.replace(">5<", "><![CDATA[5]]><"),
    lambda t: t.replace(">5<", "> &#53;<!-- five --> <"),
    lambda t: t.replace("<t:", "<other:").replace("</t:", "</other:").replace("xmlns:t", "xmlns:other"),
    lambda t: "<?xml version='1.0' encoding='UTF-16'?>" + t,
    lambda t: "\n<!-- a note -->" + t + "\n",
    lambda t: t.replace("</xbrl>", '<t:Group><t:Inner contextRef="OneD" unitRef="INR">7</t:Inner></t:Group></xbrl>'),
    lambda t: t.replace("</xbrl>", '<t:Cost contextRef="Sliced" unitRef="INR">7</t:Cost><context id="Sliced"><entity><segment><d:explicitMember xmlns:d="http://xbrl.org/2006/xbrldi" '
                        'dimension="x">y</d:explicitMember></segment></entity><period><instant>2024-12-31</instant></period></context></xbrl>'),
])
def test_spellings_of_one_instance(spark, change):
    text = change(instance())
    got = facts_of(spark, text.encode("utf-16") if "UTF-16" in text else text)
    assert [(r.error, r.concept, r.value, r.nature) for r in sorted(got, key=lambda r: r.value)] == [
        (None, "Revenue", "15", "YTD"), (None, "Revenue", "5", "QUARTERLY")]


@pytest.mark.parametrize("change,error", [
    (lambda t: t.replace('<xbrl xmlns="http://www.xbrl.org/2003/instance"', '<xbrl xmlns="urn:else" note="http://www.xbrl.org/2003/instance"'), "not a complete instance document"),
    (lambda t: t.replace("</xbrl>", "</xbrl><more/>"), "not a complete instance document"),
    (lambda t: t.replace("</xbrl>", FACT.replace(">5<", ">5.0000000000000000001<") + "</xbrl>"), "conflicting duplicate fact"),
    (lambda t: t.replace("</xbrl>", '<n:Cost xmlns:n="urn:new" contextRef="OneD" unitRef="INR">7</n:Cost></xbrl>'), "taxonomy is not supported"),
    (lambda t: t.replace("</xbrl>", '<context id="Bare"/></xbrl>'), "context is incomplete or repeated"),
    (lambda t: t.replace("</xbrl>", '<context id="OneD"><period><instant>2024-12-31</instant></period></context></xbrl>'), "context is incomplete or repeated"),
    (lambda t: t.replace(">5<", ">five<"), "numeric fact is malformed"),
])
def test_instances_that_are_refused(spark, change, error):
    assert [(r.error, r.concept) for r in facts_of(spark, change(instance()))] == [(error, None)]


def test_units_decimals_and_equal_amounts(spark):
    unit = ('<unit id="INR_PerShare"><divide><unitNumerator><measure>iso:INR</measure></unitNumerator><unitDenominator><measure>shares</measure>'
            '</unitDenominator></divide></unit>')
    more = ''.join(f'<t:Eps contextRef="OneD" unitRef="INR_PerShare" decimals="2">{v}</t:Eps>' for v in ("1,200.50", "1200.5", "12005e-1"))
    got = {r.concept: r for r in facts_of(spark, instance().replace("</xbrl>", unit + more + "</xbrl>")) if r.nature == "QUARTERLY"}
    assert set(got) == {"Revenue", "Eps"}
    assert (got["Eps"].unit, got["Eps"].source_unit, got["Eps"].decimals, got["Eps"].namespace) == ("INR_PER_SHARE", "iso:INR / shares", "2", "urn:t")
    assert (got["Revenue"].unit, got["Revenue"].source_unit, got["Revenue"].decimals) == ("INR", "INR", "")


TAPE = ("series bigint, session date, open bigint, high bigint, low bigint, close bigint, volume bigint, traded_value decimal(24,2)")


def test_folder_stream_is_idempotent_and_never_overwrites(spark, tmp_path):
    tape, folder, state, issues = (str(tmp_path / n) for n in ("tape", "in", "state", "issues"))
    row = lambda s, c: (s, date(2025, 1, 2), 1, 9, 1, c, 5, None)
    spark.createDataFrame([(*row(1, 4), "OFFICIAL")], TAPE + ", origin string").write.parquet(tape)
    batch = lambda rows: spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], TAPE + ", row_no bigint")
    cal = spark.createDataFrame([("X", date(2025, 1, 1), False)], "exchange string, session date, is_trading_day boolean")
    schema = batch([row(1, 4)]).schema

    def run():
        follow_folder(spark, folder, schema, tape, cal, state, issues).awaitTermination(120)
        return {r.series: r.close for r in spark.read.parquet(tape).collect()}

    batch([row(1, 7), row(2, 5), row(2, 6)]).write.mode("append").parquet(folder)
    assert run() == {1: 4, 2: 5}
    recorded = {(r.series, r.close, r.action) for r in spark.read.parquet(issues).collect()}
    assert recorded == {(1, 7, "CONFLICT"), (2, 6, "CONFLICT")}
    batch([row(1, 7), row(2, 5), row(3, 8)]).write.mode("append").parquet(folder)
    assert run() == {1: 4, 2: 5, 3: 8} and run() == {1: 4, 2: 5, 3: 8}
    assert spark.read.parquet(tape).count() == 3


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    rows = [(i % 2, datetime(2025, 1, 1 + i // 20, i % 20, 0), i, (i * 37) % 101, 1) for i in range(80)]
    ticks = spark.createDataFrame(rows, "series int, ts timestamp, tick_id int, price int, quantity int")
    path = str(tmp_path / "ticks")
    ticks.repartition(3).write.parquet(path)
    stream = windowed_bars(spark.readStream.schema(ticks.schema).parquet(path), late="2 hours")
    q = stream.writeStream.format("memory").queryName("bars_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("bars_out").collect()}
    want = {tuple(r) for r in windowed_bars(ticks).collect()}
    assert got and got <= want and len(want) - len(got) <= 2  # the last day stays open behind the watermark


def test_merge_prices_keeps_nulls_apart(spark):
    new = spark.createDataFrame([(1, date(2025, 1, 2), 1, 9, 1, 4, 5, None), (2, date(2025, 1, 2), 1, 9, 1, 4, 5, None)], TAPE)
    old = spark.createDataFrame([(1, date(2025, 1, 2), 1, 9, 1, 4, 5, None, "OFFICIAL"), (2, date(2025, 1, 2), 1, 9, 1, 4, 5, Decimal("3.00"), "OFFICIAL")],
                                TAPE + ", origin string")
    cal = spark.createDataFrame([], "exchange string, session date, is_trading_day boolean")
    assert {r.series: r.action for r in merge.merge_prices(new, old, cal).collect()} == {1: "UNCHANGED", 2: "CONFLICT"}


def test_plain_numbers_cast_no_exponent(spark):
    """The scale is that of the whole text; only a text with an e has an exponent cast, as a failed cast is an exception."""
    cells = ["1.2500", "1,234.5", "12", "", None, "abc", "1.5e1", "1.25E-3", "1e3", "2.e", ".75", "a.12345", " 7.10 "]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, t string").select("k", parsing.number_scale(F.col("t")).alias("scale"))
    assert [r.scale for r in rows.orderBy("k").collect()] == [4, 1, 0, 0, 0, 0, 0, 5, 0, 0, 2, 5, 2]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan and plan.index("CASE WHEN") < plan.index("cast(regexp_extract")


def test_first_in_file_works_out_no_key_twice(spark):
    """Rows that lack a part of the key are no duplicates, and no test for null columns is pushed to the rows that keys are made from."""
    rows = spark.createDataFrame(
        [("A", 1, "x", None), ("A", 2, "x", "bad"), ("A", 3, "x", None), ("A", 4, None, None), ("A", 5, None, None), ("B", 6, "x", None), (None, 7, "x", None),
         (None, 8, "x", None), ("C", 9, "y", "bad"), ("C", 10, "y", None), ("C", 11, "y", None)],
        "artifact_id string, row_no bigint, t string, bad string").select(
        "artifact_id", "row_no", F.upper("t").alias("key"), F.when(F.col("bad").isNotNull(), F.struct(
            F.lit("ERROR").alias("severity"), F.col("bad").alias("code"), F.lit("m").alias("message"))).alias("issue"))
    out = ingest.dedupe_first_in_file(rows, ["key"], "AGAIN", "m")
    assert {r.row_no: r.issue.code for r in out.collect() if r.issue} == {2: "bad", 3: "AGAIN", 9: "bad", 11: "AGAIN"}
    assert "Filter" not in out._jdf.queryExecution().optimizedPlan().toString()
