"""Market-shaped views of the driver's tables, so that every operator runs on the given data.

bars come from ``lineitem``: series = supplier, session = Monday of the ship week. The group-by combines on the
map side, so a supplier holding a third of all line items still shuffles one row per task and session.

`bars` and `calendar` stand for tables a user would have stored; they are kept in executor storage (memory, then
disk), laid out by series and session as `sinks.write_tape` would, and rebuilt from lineage where a block is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_MONDAY = "1995-01-02"
SPLIT_DATE, BONUS_DATE = "1998-06-08", "1997-04-14"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def at(date_col: Column, seconds: int) -> Column:
    """Timestamp of a date plus seconds of the day (UTC)."""
    return F.timestamp_seconds(F.unix_date(date_col).cast("bigint") * 86400 + seconds)


def _week(col: str) -> Column:
    return F.trunc(F.to_date(col), "week")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    tick = F.floor(F.col("l_extendedprice") * 10000 / F.col("l_quantity") + 0.5)
    # one bigint orders the lines of a week: day of week, then order, then line
    place = (
        F.weekday(F.to_date("l_shipdate")).cast("bigint") * F.lit(10**18)
        + F.col("l_orderkey") * 10 + F.col("l_linenumber")
    )
    rows = lines.select(
        F.col("l_suppkey").alias("series"), _week("l_shipdate").alias("session"), tick.alias("tick"),
        place.alias("place"), F.col("l_quantity").cast("bigint").alias("qty"),
        F.floor(F.col("l_extendedprice") * 100 + 0.5).alias("cents"),
    )
    out = rows.groupBy("series", "session").agg(
        F.min_by("tick", "place").alias("open"), F.max("tick").alias("high"), F.min("tick").alias("low"),
        F.max_by("tick", "place").alias("close"), F.sum("qty").alias("volume"), F.sum("cents").alias("cents"),
        F.count(F.lit(1)).alias("n"),
    )
    value = (F.col("cents").cast("decimal(22,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(24,2)")
    return out.select(
        "series", "session", "open", "high", "low", "close", "volume",
        F.when(F.col("volume") % 53 != 0, value).alias("traded_value"), "n",
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per exchange and session; every 13th session has no stated close."""
    weeks = table(spark, sf_dir, "lineitem").select(_week("l_shipdate").alias("session")).distinct()
    number = F.datediff("session", day(FIRST_MONDAY)) / 7
    return weeks.select(
        F.lit("X").alias("exchange"), "session", F.lit(True).alias("is_trading_day"),
        F.lit(33300).alias("open_s"), F.when(number.cast("int") % 13 != 5, F.lit(55800)).alias("close_s"),
    ).persist()


def full_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `calendar`, with closed Tuesdays after every tenth session and a few sessions left out as unknown."""
    known = calendar(spark, sf_dir)
    number = (F.datediff("session", day(FIRST_MONDAY)) / 7).cast("int")
    closed = known.where(number % 10 == 0).select(
        "exchange", F.date_add("session", 1).alias("session"), F.lit(False).alias("is_trading_day"),
        F.lit(None).cast("int").alias("open_s"), F.lit(None).cast("int").alias("close_s"),
    )
    return known.where(number % 37 != 11).unionByName(closed)


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    key = F.col("s_suppkey")
    return (
        s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("series"), F.concat(F.lit("S"), F.lpad(key.cast("string"), 9, "0")).alias("symbol"),
            F.col("s_name").alias("company_name"),
            F.concat(F.lit("IN"), F.lpad(key.cast("string"), 10, "0")).alias("isin"), F.lit("X").alias("exchange"),
            F.lit("EQ").alias("board"), (F.col("s_acctbal") >= 0).alias("is_active"),
            F.when(key % 7 == 0, "DEMO").when(key % 13 == 0, "UNKNOWN").otherwise("OFFICIAL").alias("origin"),
            F.col("r_name").alias("macro"), F.col("n_name").alias("sector"),
            F.concat(F.col("n_name"), F.lit("/"), (key % 3).cast("string")).alias("industry"),
            F.concat(F.col("n_name"), F.lit("/"), (key % 3).cast("string"), F.lit("/"), (key % 2).cast("string"))
            .alias("basic_industry"),
        )
    )


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region = index. Every sixth member leaves and returns, some others leave for good."""
    base = securities(spark, sf_dir).select(F.col("macro").alias("index_id"), "series")
    key = F.col("series")
    start = F.date_add(day(FIRST_MONDAY), (key % 4 * 7).cast("int"))
    first = base.select(
        "index_id", "series", start.alias("valid_from"),
        F.when(key % 6 == 0, day("1999-06-06")).when(key % 11 == 5, day("1998-01-04")).alias("valid_to"),
    )
    again = base.where(key % 6 == 0).select(
        "index_id", "series", day("2000-01-03").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
    )
    return first.unionByName(again)


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits for every tenth series, later revised for half of them; a bonus and a dividend for others."""
    key = F.col("series")
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("series"))

    def rows(cond, offset, kind, ex, num, den, known, supersedes=None):
        return base.where(cond).select(
            (key * 10 + offset).alias("id"), "series", F.lit(kind).alias("type"), day(ex).alias("ex_date"),
            F.lit(num).cast("decimal(18,8)").alias("num"), F.lit(den).cast("decimal(18,8)").alias("den"),
            at(day(known), 36000).alias("available_at"),
            (key * 10 + supersedes if supersedes is not None else F.lit(None).cast("bigint")).alias("supersedes_id"),
        )

    return (
        rows(key % 10 == 0, 0, "STOCK_SPLIT", SPLIT_DATE, "2", "1", "1998-05-25")
        .unionByName(rows(key % 20 == 0, 1, "STOCK_SPLIT", SPLIT_DATE, "5", "2", "1998-07-20", 0))
        .unionByName(rows(key % 10 == 5, 2, "BONUS", BONUS_DATE, "1", "1", "1997-04-11"))
        .unionByName(rows(key % 15 == 0, 3, "DIVIDEND", "1999-03-01", "1", "1", "1999-02-01"))
    )


def benchmark_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean bar of each region; the fifth region is marked as demonstration data."""
    members = securities(spark, sf_dir).select("series", F.col("macro").alias("index_id"))
    mean = {c: F.floor(F.sum(c) / F.count(c) + 0.5).alias(c) for c in ("open", "high", "low", "close")}
    return (
        bars(spark, sf_dir).join(members, "series").groupBy("index_id", "session").agg(*mean.values())
        .withColumn("source_mode", F.when(F.col("index_id") == "MIDDLE EAST", "DEMO").otherwise("OFFICIAL"))
        .withColumn("available_at", at(F.col("session"), 55800))
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One filing per nation, fiscal quarter and scope; every seventh is revised 60 days later."""
    revenue = _quarter_revenue(spark, sf_dir)
    fid = F.col("entity") * 1000000 + F.col("fiscal_year") * 10 + F.col("fiscal_quarter")
    end = F.col("period_end")
    head = revenue.select(
        fid.alias("filing_id"), "entity", "period_start", "period_end", "fiscal_year", "fiscal_quarter",
        F.lit("QUARTERLY").alias("frequency"),
        F.when(F.col("entity") % 5 == 0, "STANDALONE").otherwise("CONSOLIDATED").alias("scope"),
        at(F.date_add(end, 20), 64800).alias("available_at"), F.lit(None).cast("bigint").alias("supersedes_id"),
        "cents",
    )
    revised = head.where(F.col("filing_id") % 7 == 0).select(
        (F.col("filing_id") + 500000).alias("filing_id"), "entity", "period_start", "period_end", "fiscal_year",
        "fiscal_quarter", "frequency", "scope", at(F.date_add(end, 80), 64800).alias("available_at"),
        F.col("filing_id").alias("supersedes_id"), (F.col("cents") + F.expr("cents div 10")).alias("cents"),
    )
    return head.unionByName(revised)


def _quarter_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.trunc(F.to_date("o_orderdate"), "quarter").alias("period_start"),
        F.floor(F.col("o_totalprice") * 100 + 0.5).alias("cents"),
    )
    owner = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("entity"))
    start = F.col("period_start")
    return (
        orders.join(owner, "c_custkey").groupBy("entity", "period_start").agg(F.sum("cents").alias("cents"))
        .withColumn("period_end", F.date_sub(F.add_months(start, 3), 1))
        .withColumn("fiscal_year", F.year(F.add_months(start, 9)).cast("bigint"))
        .withColumn("fiscal_quarter", F.quarter(F.add_months(start, 9)).cast("bigint"))
    )


FACT_RULES = (
    # label, kind, nature, value in cents
    ("Revenue From Operations", "DURATION", "QUARTERLY", "cents"),
    ("Profit After Tax", "DURATION", "QUARTERLY", "cents div 10 - entity * 100000"),
    ("Basic EPS", "DURATION", "QUARTERLY", "cents div 100000 - 500"),
    ("Total Equity", "INSTANT", "INSTANT", "cents div 3 + entity"),
    ("Total Borrowings", "INSTANT", "INSTANT", "case when entity % 4 = 0 then null else cents div 5 end"),
    ("Net Cash From Operating Activities", "DURATION", "QUARTERLY", "cents div 8"),
    ("Capital Expenditure", "DURATION", "QUARTERLY", "case when entity % 3 = 0 then null else cents div 20 end"),
    ("Order Backlog", "INSTANT", "INSTANT", "cents div 2"),
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.array(*[
        F.struct(
            F.lit(label).alias("source_concept"), F.lit(kind).alias("fact_kind"), F.lit(nature).alias("nature"),
            (F.expr(value).cast("decimal(28,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(30,8)")
            .alias("value"),
            F.when(F.lit(kind) == "INSTANT", F.col("period_end")).otherwise(F.col("period_start")).alias("start"),
        )
        for label, kind, nature, value in FACT_RULES
    ])
    return filings(spark, sf_dir).withColumn("f", F.explode(rules)).select(
        "filing_id", F.col("f.source_concept").alias("source_concept"), F.col("f.value").alias("value"),
        F.col("f.fact_kind").alias("fact_kind"), F.col("f.nature").alias("nature"),
        F.col("f.start").alias("fact_start"), F.col("period_end").alias("fact_end"),
    )


def artifact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` read as a log of received artifacts."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("artifact_id"), F.col("event_type").alias("provider"),
        F.concat(F.lit("TYPE_"), (F.col("user_id") % 8).cast("string")).alias("artifact_type"),
        F.to_date("ts").alias("source_date"), F.col("ts").cast("timestamp").alias("imported_at"),
        F.sha2(F.concat_ws("|", "event_type", (F.col("user_id") % 8).cast("string"), "props"), 256).alias("sha256"),
        F.when(k % 17 == 0, "FAILED").when(k % 19 == 0, "CONFLICT").when(k % 5 == 0, "PARTIAL")
        .otherwise("SUCCEEDED").alias("status"),
        F.floor(F.col("value") * 10).alias("inserted"), (k % 3).alias("unchanged"),
        F.when(k % 5 == 0, k % 7).otherwise(0).alias("rejected"), F.when(k % 19 == 0, 1).otherwise(0).cast("bigint")
        .alias("conflicts"), F.when(k % 11 == 0, 2).otherwise(0).cast("bigint").alias("warnings"),
    )


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots; every ninth series moves to another sector in the second."""
    base = securities(spark, sf_dir).select("series", "macro", "sector", "industry", "basic_industry")
    first = base.withColumn("snapshot_date", day("1996-01-01"))
    moved = F.when(F.col("series") % 9 == 0, F.concat(F.col("sector"), F.lit("_B"))).otherwise(F.col("sector"))
    second = base.withColumn("sector", moved).withColumn("snapshot_date", day("2000-01-03"))
    return first.unionByName(second).withColumn("available_at", at(F.date_add("snapshot_date", 1), 36000))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One simple report per nation and quarter, effective a few days after it was reported."""
    return filings(spark, sf_dir).select(
        "entity", "period_end", F.to_date("available_at").alias("reported_on"),
        F.date_add(F.to_date("available_at"), (F.col("entity") % 5).cast("int")).alias("effective_on"), "cents",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` read as ingestion runs."""
    log = artifact_log(spark, sf_dir)
    return log.select(
        F.col("artifact_id").alias("run_id"),
        F.concat(F.col("provider"), F.lit("_"), F.col("artifact_type")).alias("dataset_code"), "status",
        F.col("imported_at").alias("started_at"),
        F.timestamp_seconds(F.unix_seconds("imported_at") + F.col("inserted") % 600).alias("completed_at"),
        F.col("artifact_type").alias("experiment"), "sha256",
        F.sha2(F.concat_ws("|", "provider", (F.col("inserted") % 5).cast("string")), 256).alias("result_sha"),
    )
