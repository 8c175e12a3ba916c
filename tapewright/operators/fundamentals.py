"""Point-in-time fundamentals, peers and relative strength.

Facts are first reduced to one value per (entity, concept, period) with `max_by`, which combines before the shuffle;
what is windowed afterwards has at most one row per reporting period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.fixed_values import CONCEPT_LABELS, QUARTER_DAYS, RS_WINDOWS, SECTOR_BENCHMARKS
from tapewright.functions.numbers import change, r8
from tapewright.operators.ranks import cume_dist

LEVELS = ("sector", "industry", "basic_industry")


# --- U1, U14: exact label maps --------------------------------------------------------------------------------
def concept_key(label: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(label), r"[^\p{L}\p{N}]", ""))


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def map_concept(label: Column) -> Column:
    """Canonical concept of an accepted label, else null; nothing fuzzy."""
    fold = lambda text: "".join(c for c in text.upper() if c.isalnum())
    pairs = {fold(alias): code for code, labels in CONCEPT_LABELS.items() for alias in (code, *labels)}
    return F.try_element_at(_literal_map(pairs), concept_key(label))


def sector_benchmark(sector: Column, mapping: dict[str, str] | None = None) -> Column:
    return F.try_element_at(_literal_map(mapping or SECTOR_BENCHMARKS), F.trim(sector))


# --- U2: ranked facts --------------------------------------------------------------------------------------------
def mapped_facts(filings: DataFrame, facts: DataFrame) -> DataFrame:
    """Non-null facts of known concepts with what their filing says."""
    heads = filings.select("filing_id", "entity", "fiscal_year", "fiscal_quarter", "frequency", "available_at")
    rows = facts.where(F.col("value").isNotNull()).withColumn("concept", map_concept(F.col("source_concept")))
    return rows.where(F.col("concept").isNotNull()).join(heads, "filing_id")


def facts_ranked(rows: DataFrame) -> DataFrame:
    """Newest period first, then newest availability, per entity and concept."""
    w = Window.partitionBy("entity", "concept").orderBy(
        F.col("fact_end").desc(), F.col("available_at").desc(), F.col("filing_id").desc())
    return rows.withColumn("k", F.row_number().over(w))


def per_period(rows: DataFrame) -> DataFrame:
    """The newest available fact of each (entity, concept, period end)."""
    fields = ["value", "nature", "frequency", "fiscal_year", "fiscal_quarter", "fact_start"]
    return rows.groupBy("entity", "concept", "fact_end").agg(
        F.max_by(F.struct(*fields), F.struct("available_at", "filing_id")).alias("x")
    ).select("entity", "concept", "fact_end", "x.*")


def quarters(rows: DataFrame) -> DataFrame:
    span = F.datediff("fact_end", "fact_start")
    return rows.where((F.col("nature") == "QUARTERLY") & span.between(*QUARTER_DAYS))


def _newest(*fields: str) -> Column:
    return F.max_by(F.struct(*fields), F.col("fact_end"))


# --- U3-U6 ------------------------------------------------------------------------------------------------------
def latest_quarter(rows: DataFrame) -> DataFrame:
    return per_period(quarters(rows)).groupBy("entity", "concept").agg(
        _newest("value", "fact_end").alias("x")).select(
        "entity", "concept", "x.value", F.array("x.fact_end").alias("periods"), F.lit(None).cast("string").alias("reason"))


def yoy_growth(rows: DataFrame) -> DataFrame:
    """Newest quarter over the newest fact of the same fiscal quarter a year before."""
    q = per_period(quarters(rows))
    now = q.groupBy("entity", "concept").agg(
        _newest("value", "fact_end", "fiscal_year", "fiscal_quarter").alias("n"))
    keyed = now.select("entity", "concept", "n", (F.col("n.fiscal_year") - 1).alias("fiscal_year"),
                       F.col("n.fiscal_quarter").alias("fiscal_quarter"))
    prior = keyed.join(q, ["entity", "concept", "fiscal_year", "fiscal_quarter"], "left").where(
        F.col("fact_end").isNull() | (F.col("fact_end") <= F.col("n.fact_end"))).groupBy("entity", "concept").agg(
        F.any_value("n").alias("n"), _newest("value", "fact_end").alias("p"))
    ok = F.coalesce(F.col("p.value") != 0, F.lit(False))
    return prior.select(
        "entity", "concept",
        F.when(ok, change(F.col("n.value"), F.col("p.value"))).alias("value"),
        F.when(ok, F.array("p.fact_end", "n.fact_end")).otherwise(F.array("n.fact_end")).alias("periods"),
        F.when(~ok, "COMPARABLE_PRIOR_YEAR_QUARTER_REQUIRED").alias("reason"))


def ttm(rows: DataFrame) -> DataFrame:
    """Sum of the four newest non-overlapping quarters."""
    q = per_period(quarters(rows).where(F.col("frequency") == "QUARTERLY"))
    w = Window.partitionBy("entity", "concept").orderBy(F.col("fact_end").desc())
    four = q.withColumns({"k": F.row_number().over(w), "_later_start": F.lag("fact_start").over(w)}).where("k <= 4")
    sums = four.groupBy("entity", "concept").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"),
        F.array_sort(F.collect_list("fact_end")).alias("periods"),
        F.bool_or(F.coalesce(F.col("fact_end") >= F.col("_later_start"), F.lit(False))).alias("overlap"))
    reason = F.when(F.col("n") < 4, "FOUR_INDEPENDENT_QUARTERS_REQUIRED").when(
        F.col("overlap"), "QUARTERLY_PERIODS_OVERLAP")
    return sums.select("entity", "concept", F.when(reason.isNull(), F.col("total")).alias("value"), "periods",
                       reason.alias("reason"))


def latest_value(rows: DataFrame) -> DataFrame:
    return per_period(rows).groupBy("entity", "concept").agg(_newest("value", "fact_end").alias("x")).select(
        "entity", "concept", "x.value", F.array("x.fact_end").alias("periods"))


def equity_pair(rows: DataFrame) -> DataFrame:
    """Newest total equity and the newest one at least 300 days before it."""
    e = per_period(rows.where(F.col("concept") == "TOTAL_EQUITY"))
    w = Window.partitionBy("entity")
    last = F.max("fact_end").over(w)
    old = F.datediff(last, "fact_end") >= 300
    return e.withColumns({"_last": last}).withColumn("_old", old).groupBy("entity").agg(
        _newest("value", "fact_end").alias("now"),
        F.max_by(F.when(F.col("_old"), F.struct("value", "fact_end")), F.when(F.col("_old"), F.col("fact_end"))).alias("then"))


# --- U7-U12: metrics -----------------------------------------------------------------------------------------------
QUARTER_CODES = {"REVENUE": "REVENUE", "PROFIT_AFTER_TAX": "PAT", "EPS_BASIC": "EPS"}
TTM_CONCEPTS = ("REVENUE", "PROFIT_AFTER_TAX", "EPS_BASIC", "CASH_FLOW_FROM_OPERATIONS", "CAPITAL_EXPENDITURE")


def _wide(df: DataFrame, name: str, concepts: Sequence[str]) -> DataFrame:
    """One struct column per concept: value, periods, reason."""
    cols = [c for c in ("value", "periods", "reason") if c in df.columns]
    return df.where(F.col("concept").isin(*concepts)).groupBy("entity").agg(*[
        F.max_by(F.struct(*cols), F.when(F.col("concept") == c, 1)).alias(f"{name}_{c}") for c in concepts])


def fundamental_metrics(filings: DataFrame, facts: DataFrame, closes: DataFrame) -> DataFrame:
    """(entity, code, value, status, reason, periods): the fourteen metrics of every entity with a filing.

    `filings` are already those eligible and of one scope; `closes` holds (entity, close), the last close known.
    The mapped facts feed five aggregates and are kept in executor storage for them.
    """
    rows = mapped_facts(filings, facts).persist()
    wide = filings.select("entity").distinct()
    for part in (
        _wide(latest_quarter(rows), "q", list(QUARTER_CODES)), _wide(yoy_growth(rows), "y", list(QUARTER_CODES)),
        _wide(ttm(rows), "t", list(TTM_CONCEPTS)),
        _wide(latest_value(rows), "l", ["TOTAL_EQUITY", "TOTAL_BORROWINGS"]),
        equity_pair(rows), closes.select("entity", F.col("close").alias("last_close")),
    ):
        wide = wide.join(part, "entity", "left")
    none = F.array().cast("array<date>")
    val = lambda c: F.col(f"{c}.value").cast("double")
    per = lambda c: F.coalesce(F.col(f"{c}.periods"), none)
    both = lambda *c: F.array_sort(F.array_distinct(F.concat(*[per(x) for x in c])))
    metrics: list[Column] = []

    def metric(code: str, value: Column, reason: Column, periods: Column) -> None:
        v = r8(value)
        metrics.append(F.struct(
            F.lit(code).alias("code"), v.alias("value"),
            F.when(v.isNull(), "UNAVAILABLE").otherwise("AVAILABLE").alias("status"),
            F.when(v.isNull(), reason).alias("reason"), periods.alias("periods")))

    for concept, short in QUARTER_CODES.items():
        metric(f"{short}_LATEST_QUARTER", val(f"q_{concept}"), F.lit("LATEST_INDEPENDENT_QUARTER_REQUIRED"), per(f"q_{concept}"))
    for concept, short in QUARTER_CODES.items():
        metric(f"{short}_YOY", val(f"y_{concept}"),
               F.coalesce(F.col(f"y_{concept}.reason"), F.lit("LATEST_INDEPENDENT_QUARTER_REQUIRED")), per(f"y_{concept}"))
    four = F.lit("FOUR_INDEPENDENT_QUARTERS_REQUIRED")
    for concept, short in QUARTER_CODES.items():
        metric(f"{short}_TTM", val(f"t_{concept}"), F.coalesce(F.col(f"t_{concept}.reason"), four), per(f"t_{concept}"))
    revenue, pat, eps = val("t_REVENUE"), val("t_PROFIT_AFTER_TAX"), val("t_EPS_BASIC")
    metric("NET_MARGIN_TTM", F.try_divide(pat, revenue), F.lit("NONZERO_REVENUE_TTM_REQUIRED"),
           both("t_REVENUE", "t_PROFIT_AFTER_TAX"))
    debt, equity = val("l_TOTAL_BORROWINGS"), val("l_TOTAL_EQUITY")
    metric("DEBT_TO_EQUITY", F.try_divide(debt, equity),
           F.when(debt.isNull(), "TOTAL_BORROWINGS_REQUIRED").otherwise("NONZERO_EQUITY_REQUIRED"),
           both("l_TOTAL_BORROWINGS", "l_TOTAL_EQUITY"))
    average = (F.col("now.value").cast("double") + F.col("then.value").cast("double")) / 2.0
    roe_periods = F.array_sort(F.array_distinct(F.array_compact(F.concat(
        per("t_PROFIT_AFTER_TAX"), per("l_TOTAL_EQUITY"), F.array("then.fact_end")))))
    metric("ROE_TTM", F.try_divide(pat, average), F.lit("PAT_TTM_AND_TWO_NONZERO_EQUITY_PERIODS_REQUIRED"), roe_periods)
    cfo, capex = "t_CASH_FLOW_FROM_OPERATIONS", "t_CAPITAL_EXPENDITURE"
    missing = lambda c: F.when(F.col(c).isNull(), four).otherwise(F.col(f"{c}.reason"))
    metric("FCF_TTM", val(cfo) - val(capex),
           F.coalesce(missing(cfo), missing(capex), F.lit("CFO_AND_CAPEX_TTM_REQUIRED")), both(cfo, capex))
    metric("PE_TTM", F.when(eps > 0, F.try_divide(F.col("last_close").cast("double"), eps)),
           F.lit("POSITIVE_EPS_TTM_AND_POINT_IN_TIME_CLOSE_REQUIRED"), per("t_EPS_BASIC"))
    return wide.select("entity", F.explode(F.array(*metrics)).alias("m")).select("entity", "m.*")


# --- U13: peers ----------------------------------------------------------------------------------------------------
def peers(classified: DataFrame, series) -> DataFrame:
    """Others in the same sector, industry and basic industry as one series: a filter against one row."""
    newest = ["snapshot_date"] if "snapshot_date" in classified.columns else []
    last = F.max(F.struct(*newest, *LEVELS)).alias("_own")
    own = classified.where(F.col("series") == series).agg(last).select(*[F.col(f"_own.{c}").alias(f"_{c}") for c in LEVELS])
    rows = classified.where(F.col("series") != series).crossJoin(own)  # an aggregate: one row on the right
    levels = F.array_compact(F.array(*[F.when(F.col(c) == F.col(f"_{c}"), F.lit(c)) for c in LEVELS]))
    return rows.select(F.explode(levels).alias("level"), "series")


def peers_of(classified: DataFrame, wanted: DataFrame) -> DataFrame:
    """(series, level, peer): the others at each level for every series of a set, by equality joins on (level, name)."""
    newest = ["snapshot_date"] if "snapshot_date" in classified.columns else []
    own = classified.join(wanted.select("series").distinct(), "series", "left_semi").groupBy("series").agg(
        F.max(F.struct(*newest, *LEVELS)).alias("_own"))

    def named(rows: DataFrame, series: str, field) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("level"), field(c).alias("name")) for c in LEVELS]))
        return rows.select(F.col("series").alias(series), each.alias("_l")).select(series, "_l.*").where("name IS NOT NULL")

    asked = named(own, "series", lambda c: F.col(f"_own.{c}"))
    every = named(classified, "peer", F.col).distinct()
    return asked.join(every, ["level", "name"]).where("series <> peer").select("series", "level", "peer")


def peer_counts(classified: DataFrame) -> DataFrame:
    """Number of peers of every series at each level, from group sizes rather than pairs."""
    out = classified
    for level in LEVELS:
        sizes = classified.groupBy(level).agg((F.count(F.lit(1)) - 1).alias(f"{level}_peers"))
        out = out.join(sizes, level)
    return out.select("series", *[f"{c}_peers" for c in LEVELS])


# --- U15-U17: relative strength ---------------------------------------------------------------------------------------
def relative_strength(bars: DataFrame, links: DataFrame, index_prices: DataFrame) -> DataFrame:
    """Return of a series minus that of its index over the last 21, 63 and 126 *common* sessions.

    `links` is (series, index_id). One sort per (series, index); the n-th common session back is a lag.
    """
    bench = index_prices.select("index_id", "session", F.col("close").alias("index_close"))
    rows = bars.select("series", "session", "close").join(links.select("series", "index_id"), "series").join(
        bench, ["index_id", "session"])
    w = Window.partitionBy("series", "index_id").orderBy("session")
    lags = {}
    for code, n in RS_WINDOWS.items():
        a, b = F.lag("close", n).over(w), F.lag("index_close", n).over(w)
        usable = (a > 0) & (b > 0)
        lags[code] = F.struct(
            F.when(usable, change(F.col("close"), a) - change(F.col("index_close"), b)).alias("value"),
            F.when(usable, change(F.col("close"), a)).alias("series_return"),
            F.when(usable, change(F.col("index_close"), b)).alias("index_return"),
            F.when(usable, F.lag("session", n).over(w)).alias("start"), F.when(usable, F.col("session")).alias("end"))
    newest = rows.withColumns({**lags, "_last": F.lead("session").over(w).isNull()}).where("_last")
    each = F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("x")) for c in RS_WINDOWS])
    # links without any common session still answer, with nulls
    every = links.select("series", "index_id").distinct().join(newest, ["series", "index_id"], "left").select(
        "series", "index_id", F.explode(each).alias("e"))
    return every.select("series", "index_id", "e.code", "e.x.*").withColumn(
        "status", F.when(F.col("value").isNull(), "UNAVAILABLE").otherwise("AVAILABLE"))


def rs_percentile(strength: DataFrame) -> DataFrame:
    """Share of members of the same index with a value at or below, times 100, exact and in two levels."""
    units = F.floor(F.col("value") * 1e8 + 0.5)
    below = cume_dist(strength, ["index_id", "code"], units)
    keyed = strength.withColumn("v", units.cast("bigint"))
    out = keyed.join(below, ["index_id", "code", "v"], "left")
    return out.withColumn("percentile", F.col("at_or_below").cast("double") * 100 / F.col("total")).withColumnRenamed(
        "total", "eligible").drop("v", "at_or_below")


# --- U18: summary ---------------------------------------------------------------------------------------------------
def last_closes(bars: DataFrame) -> DataFrame:
    """Last session, close and one-session return of every series."""
    w = Window.partitionBy("series").orderBy("session")
    rows = bars.select("series", "session", "close").withColumns({
        "before": F.lag("close").over(w), "_last": F.lead("session").over(w).isNull()}).where("_last")
    return rows.select("series", "session", "close", F.when(F.col("before") > 0, r8(
        change(F.col("close"), F.col("before")))).alias("one_day_return"))


def research_summary(
    securities: DataFrame, bars: DataFrame, classified: DataFrame, strength: DataFrame,
    mapping: dict[str, str] | None = None,
) -> DataFrame:
    value = lambda c: F.max(F.when(F.col("code") == c, r8(F.col("value")))).alias(c)
    rs = strength.groupBy("series").agg(
        *[value(c) for c in RS_WINDOWS], F.bool_or(F.col("status") == "AVAILABLE").alias("_rs"))
    levels = classified.select("series", "macro", "sector", "industry", "basic_industry")
    rows = securities.select("series", "symbol").join(last_closes(bars), "series", "left").join(
        levels, "series", "left").join(rs, "series", "left")
    benchmark = sector_benchmark(F.col("sector"), mapping)
    return rows.withColumns({
        "sector_benchmark": benchmark,
        "classification_status": F.when(F.col("sector").isNull(), "UNAVAILABLE").otherwise("READY"),
        "relative_strength_status": F.when(F.coalesce("_rs", F.lit(False)), "READY").otherwise("UNAVAILABLE"),
        "warnings": F.array_join(F.array_compact(F.array(
            F.when(F.col("sector").isNull(), "NO_CLASSIFICATION_SNAPSHOT_AVAILABLE_AS_OF"),
            F.when(benchmark.isNull(), "SECTOR_BENCHMARK_MAPPING_UNAVAILABLE"))), ","),
    }).drop("_rs")
