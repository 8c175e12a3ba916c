"""Normalisation of artifact rows: typed columns, one rejection reason per bad row, first row of a key wins.

Input frames hold text columns under canonical names (`tapewright.sources.artifacts.resolve_headers`), plus
`artifact_id` and `row_no`. Output adds typed columns and `issue`, null for accepted rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import fixed_values as fv
from tapewright.functions.parsing import (
    any_of, bad_optional_date, blank, multi_format_date, number, optional_date, storage_problem, zoned_timestamp,
)
from tapewright.session import cut_lineage

Rule = tuple[Column, str, str, str]  # bad when, severity, code, message


# --- I14, I15 ---------------------------------------------------------------------------------------------------
def _issue(severity: str, code: str, message: str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message"))


def first_issue(rules: Sequence[Rule]) -> Column:
    return F.coalesce(*[
        F.when(F.coalesce(bad, F.lit(False)), _issue(severity, code, message)) for bad, severity, code, message in rules])


def dedupe_first_in_file(df: DataFrame, keys: Sequence[str], code: str, message: str) -> DataFrame:
    """Among accepted rows of an artifact, all but the first of each key become rejected.

    The first row numbers are a combined aggregate joined back; a key repeated millions of times is split by the
    skew join and never sits in one window. The key is one struct, which is never null: Spark would else infer that none of
    its columns is null and have them all worked out once more, on the rows that they were made from. A row that lacks a
    part of its key is no duplicate.
    """
    parts = ["artifact_id", *keys]
    keyed = df.withColumn("_key", F.struct(*parts))
    ok = F.col("issue").isNull()
    firsts = keyed.groupBy("_key").agg(F.min(F.when(ok, F.col("row_no"))).alias("_first"))
    late = ok & (F.col("row_no") > F.col("_first"))
    for part in parts:
        late = late & F.col(part).isNotNull()
    return keyed.join(firsts, "_key", "left").withColumn(
        "issue", F.when(late, _issue("ERROR", code, message)).otherwise(F.col("issue"))).select(*df.columns)


def dedupe_two_keys(df: DataFrame, first: tuple, second: tuple) -> DataFrame:
    """As a pass in file order that keeps a row unless an earlier *kept* row has its first or its second key.

    Rounds on the keys alone: rows that come first in both their keys are kept, rows that share a key with a kept row are
    out, and the rest go to the next round (needed only when duplicates overlap crosswise). A row that is out gets the code of
    the first key if the row kept for that key came before it, else that of the second.
    """
    (key_a, code_a, text_a), (key_b, code_b, text_b) = first, second
    place = ["artifact_id", "row_no"]
    a, b = F.struct(*key_a).alias("_a"), F.struct(*key_b).alias("_b")
    pending, kept = df.where("issue IS NULL").select(*place, a, b), []
    while True:
        pending = cut_lineage(pending)
        if pending.isEmpty():
            break
        marked = pending
        for key in ("_a", "_b"):
            marked = marked.join(pending.groupBy("artifact_id", key).agg(F.min("row_no").alias(f"{key}1")), ["artifact_id", key])
        now = cut_lineage(marked.where("row_no = _a1 AND row_no = _b1").select(*place, "_a", "_b"))
        kept.append(now)
        for key in ("_a", "_b"):
            pending = pending.join(now.select("artifact_id", key), ["artifact_id", key], "left_anti")
    if not kept:
        return df
    every = kept[0]
    for part in kept[1:]:
        every = every.unionByName(part)
    rows = df.withColumns({"_a": F.when(F.col("issue").isNull(), F.struct(*key_a)), "_b": F.when(F.col("issue").isNull(), F.struct(*key_b))})
    for key in ("_a", "_b"):
        rows = rows.join(every.select("artifact_id", key, F.col("row_no").alias(f"{key}_kept")), ["artifact_id", key], "left")
    late = F.when(F.col("row_no") > F.col("_a_kept"), _issue("ERROR", code_a, text_a)).when(
        F.col("row_no") > F.col("_b_kept"), _issue("ERROR", code_b, text_b))
    return rows.withColumn("issue", F.coalesce("issue", late)).select(*df.columns)


def accepted(normalised: DataFrame) -> DataFrame:
    return normalised.where("issue IS NULL").drop("issue")


def rejected(normalised: DataFrame) -> DataFrame:
    return normalised.where("issue IS NOT NULL").select("artifact_id", "row_no", "issue.*")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("rejected"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))


def issue_sample(issues: DataFrame, limit: int = fv.SAMPLE_ISSUES) -> DataFrame:
    """The first issues of every artifact; Spark limits each partition before the shuffle."""
    w = Window.partitionBy("artifact_id").orderBy("row_no")
    return issues.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit).drop("_k")


# --- shared pieces ------------------------------------------------------------------------------------------------
def _upper(*names: str) -> dict[str, Column]:
    return {n: F.upper(F.trim(F.col(n))) for n in names}


def _identity(code: str) -> list[Rule]:
    return [
        (~F.col("symbol").rlike(fv.SYMBOL_PATTERN), "ERROR", code, "symbol is malformed"),
        (~F.col("isin").rlike(fv.ISIN_PATTERN), "ERROR", code, "ISIN is malformed"),
    ]


def _not_equity(code: str = "UNSUPPORTED_EQUITY_SERIES", severity: str = "INFO") -> Rule:
    return (~F.col("series").isin(*fv.EQUITY_SERIES), severity, code, "series is outside the equity policy")


def _with(df: DataFrame, *optional: str) -> DataFrame:
    """Absent optional columns become empty text, as a blank cell would be."""
    return df.withColumns({c: F.lit("") for c in optional if c not in df.columns}).fillna("")


OHLC = ("open", "high", "low", "close")


def _parsed_ohlc(rows: DataFrame, whole: int, scale: int) -> DataFrame:
    """Numbers and range flags of the four prices, in a projection of their own so that rules only refer to them."""
    return rows.withColumnsRenamed({n: f"_{n}_text" for n in OHLC}).withColumns({
        **{f"_{n}": number(F.col(f"_{n}_text")) for n in OHLC},
        **{f"_{n}_bad": storage_problem(F.col(f"_{n}_text"), whole, scale) for n in OHLC}})


def _ohlc_rules(code: str) -> list[Rule]:
    o, h, lo, c = (F.col(f"_{n}") for n in OHLC)
    rules = [(F.col(f"_{n}").isNull(), "ERROR", code, f"{n} is not a valid decimal") for n in OHLC]
    rules += [(F.col(f"_{n}_bad"), "ERROR", code, f"{n} is outside the stored range or scale") for n in OHLC]
    rules += [
        (any_of(o <= 0, h <= 0, lo <= 0, c <= 0), "ERROR", code, "prices must be positive"),
        (h < lo, "ERROR", code, "high is below low"),
        (any_of(o < lo, o > h), "ERROR", code, "open is outside the low/high range"),
        (any_of(c < lo, c > h), "ERROR", code, "close is outside the low/high range"),
    ]
    return rules


# --- I2-I9 -----------------------------------------------------------------------------------------------------------
def norm_securities(df: DataFrame) -> DataFrame:
    code = "MALFORMED_SECURITY_IDENTIFIER"
    rows = _with(df, *fv.OPTIONAL_HEADERS["securities"]).withColumns(
        {**_upper("symbol", "series", "isin"), "company_name": F.trim("company_name")})
    rows = rows.withColumn("issue", first_issue([
        _not_equity(), *_identity(code),
        (F.col("company_name") == "", "ERROR", code, "company name is blank"),
        (F.length("company_name") > 255, "ERROR", code, "company name exceeds 255 characters"),
        (bad_optional_date(F.col("listing_date")), "ERROR", code, "listing date is not a supported date"),
    ])).withColumns({
        "listing_date": optional_date(F.col("listing_date")),
        "is_active": ~F.upper(F.trim("status")).isin(*fv.INACTIVE_STATUSES)})
    return dedupe_two_keys(
        rows, (["symbol", "series"], "DUPLICATE_SYMBOL_SERIES", "duplicate symbol and series in artifact"),
        (["isin"], "DUPLICATE_ISIN_CONFLICT", "duplicate ISIN in artifact"))


def norm_prices(df: DataFrame) -> DataFrame:
    """`expected_date` is the date of the artifact."""
    code = "INVALID_OHLCV_ROW"
    has_segment = "segment" in df.columns
    rows = _with(df, *fv.OPTIONAL_HEADERS["prices"]).withColumns(_upper("symbol", "series", "isin", "segment"))
    value = F.col("traded_value")
    rows = _parsed_ohlc(rows, 14, 4).withColumns({
        "_day": multi_format_date(F.col("trade_date")), "_volume": number(F.col("volume")), "_value": number(value),
        "_value_given": ~blank(value), "_value_bad": storage_problem(value, 22, 2)})
    segment = ~F.col("segment").isin(*fv.SEGMENTS) if has_segment else F.lit(False)
    volume, given = F.col("_volume"), F.col("_value_given")
    shape = _ohlc_rules(code)
    rules = [
        (segment | ~F.col("series").isin(*fv.EQUITY_SERIES), "INFO", "UNSUPPORTED_EQUITY_SERIES",
         "row is outside the equity policy"),
        (~F.col("symbol").rlike(fv.SYMBOL_PATTERN), "ERROR", code, "symbol is malformed"),
        (F.col("_day").isNull(), "ERROR", code, "trade date is not a supported date"),
        (F.col("_day") != F.col("expected_date"), "ERROR", code, "row trade date does not match artifact source date"),
        *shape[:4],
        (volume.isNull(), "ERROR", code, "volume is not a valid decimal"),
        (volume != F.floor(volume), "ERROR", code, "volume must be an integer"),
        ((volume < 0) | (volume > fv.MAX_VOLUME), "ERROR", code, "volume is outside the supported range"),
        (given & F.col("_value").isNull(), "ERROR", code, "traded value is not a valid decimal"),
        *shape[4:8],
        (given & F.col("_value_bad"), "ERROR", code, "traded value is outside the stored range or scale"),
        *shape[8:],
        (F.col("_value") < 0, "ERROR", code, "traded value must be non-negative"),
        ((F.col("isin") != "") & ~F.col("isin").rlike(fv.ISIN_PATTERN), "ERROR", code, "ISIN is malformed"),
    ]
    rows = rows.withColumn("issue", first_issue(rules)).withColumns({
        "trade_date": F.col("_day"), **{n: F.col(f"_{n}").try_cast("decimal(18,4)") for n in OHLC},
        "volume": volume.try_cast("bigint"), "traded_value": F.when(given, F.col("_value").try_cast("decimal(24,2)")),
        "isin": F.nullif(F.col("isin"), F.lit("")),
    })
    rows = rows.drop(*[c for c in rows.columns if c.startswith("_")])
    return dedupe_first_in_file(rows, ["symbol", "series", "trade_date"], "DUPLICATE_ARTIFACT_ROW",
                                "duplicate symbol, series and date in artifact")


def norm_index_history(df: DataFrame, expected_index: str, start=None, end=None, today=None) -> DataFrame:
    code = "INVALID_INDEX_OHLC_ROW"
    rows = _parsed_ohlc(_with(df), 14, 6).withColumn("_day", multi_format_date(F.col("trade_date")))
    day = F.col("_day")
    fold = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    limit = F.current_date() if today is None else F.lit(today).cast("date")
    rules = [
        (fold(F.col("index_name")) != fold(F.lit(expected_index)), "ERROR", code, "index identity differs"),
        (day.isNull(), "ERROR", code, "index date is not a supported date"),
        (day > limit, "ERROR", code, "index date cannot be in the future"),
    ]
    if start is not None:
        rules.append((day < F.lit(start).cast("date"), "ERROR", code, "index date is before the requested range"))
    if end is not None:
        rules.append((day > F.lit(end).cast("date"), "ERROR", code, "index date is after the requested range"))
    rows = rows.withColumn("issue", first_issue(rules + _ohlc_rules(code))).withColumns({
        "trade_date": day, **{n: F.col(f"_{n}").try_cast("decimal(20,6)") for n in OHLC}})
    rows = rows.drop(*[c for c in rows.columns if c.startswith("_")])
    return dedupe_first_in_file(rows, ["trade_date"], "DUPLICATE_INDEX_PRICE", "duplicate date in index artifact")


def norm_constituents(df: DataFrame) -> DataFrame:
    code = "INVALID_CONSTITUENT"
    rows = _with(df, "industry").withColumns(
        {**_upper("symbol", "series", "isin"), "company_name": F.trim("company_name")})
    rows = rows.withColumn("issue", first_issue([
        *_identity(code), _not_equity(code, "ERROR"),
        (F.col("company_name") == "", "ERROR", code, "company name is blank"),
    ])).withColumn("industry", F.nullif(F.trim("industry"), F.lit("")))
    return dedupe_first_in_file(rows, ["symbol", "series"], "DUPLICATE_INDEX_MEMBER", "duplicate member in snapshot")


def norm_corporate_actions(df: DataFrame) -> DataFrame:
    """Free-text purpose to split or bonus ratio. Recognised rows without publication time are quarantined."""
    code = "MALFORMED_CORPORATE_ACTION"
    rows = _with(df, *fv.OPTIONAL_HEADERS["corporate_actions"]).withColumns(
        {**_upper("symbol", "series"), "purpose": F.trim("purpose")})
    text = F.col("purpose")
    part = lambda pattern, i: F.regexp_extract(text, pattern, i).try_cast("decimal(18,8)")
    bonus = text.rlike(fv.BONUS_PATTERN)
    split = ~bonus & text.rlike(fv.SPLIT_PATTERN)
    old, new = part(fv.SPLIT_PATTERN, 1), part(fv.SPLIT_PATTERN, 2)
    uneven = (new <= 0) | (old <= new) | (F.when(new > 0, old % new) != 0)
    hinted = F.upper(text).contains("SPLIT") | F.upper(text).contains("BONUS")
    num = F.when(bonus, part(fv.BONUS_PATTERN, 1)).when(split, F.try_divide(old, new).cast("decimal(18,8)"))
    den = F.when(bonus, part(fv.BONUS_PATTERN, 2)).when(split, F.lit(1).cast("decimal(18,8)"))
    published = F.col("published_at")
    rows = rows.withColumn("issue", first_issue([
        _not_equity(),
        (split & uneven, "WARNING", "AMBIGUOUS_ACTION_RATIO", "split face-value ratio is not unambiguous"),
        (~bonus & ~split & hinted, "WARNING", "AMBIGUOUS_ACTION_RATIO", "not an unambiguous split or bonus"),
        (~bonus & ~split, "WARNING", "UNSUPPORTED_CORPORATE_ACTION", "not an unambiguous split or bonus"),
        (~F.col("symbol").rlike(fv.SYMBOL_PATTERN), "ERROR", code, "symbol is malformed"),
        (multi_format_date(F.col("ex_date")).isNull(), "ERROR", code, "ex date is not a supported date"),
        (bad_optional_date(F.col("record_date")), "ERROR", code, "record date is not a supported date"),
        ((F.trim(published) != "") & zoned_timestamp(published).isNull(), "ERROR", code,
         "publication timestamp must be ISO-8601 with an offset"),
        ((num <= 0) | (den <= 0) | num.isNull() | den.isNull(), "ERROR", code, "ratio must be positive and finite"),
    ])).withColumns({
        "action_type": F.when(bonus, "BONUS").when(split, "STOCK_SPLIT"), "num": num, "den": den,
        "ex_date": multi_format_date(F.col("ex_date")), "record_date": optional_date(F.col("record_date")),
        "published_at": zoned_timestamp(published), "_purpose": F.lower("purpose"),
    })
    out = dedupe_first_in_file(rows, ["symbol", "action_type", "ex_date", "_purpose"], "DUPLICATE_CORPORATE_ACTION",
                               "duplicate action in artifact").drop("_purpose")
    held = F.col("issue").isNull() & F.col("published_at").isNull()
    return out.withColumn("issue", F.when(held, _issue(
        "WARNING", "AVAILABILITY_TIMESTAMP_UNKNOWN", "recognised, but without a trustworthy publication time"))
        .otherwise(F.col("issue")))


def norm_holidays(df: DataFrame) -> DataFrame:
    rows = _with(df).withColumn("description", F.trim("description"))
    rows = rows.withColumn("issue", first_issue([
        (multi_format_date(F.col("date")).isNull(), "ERROR", "MALFORMED_HOLIDAY", "holiday date is not a supported date"),
        (F.col("description") == "", "ERROR", "MALFORMED_HOLIDAY", "holiday description is blank"),
    ])).withColumn("date", multi_format_date(F.col("date")))
    return dedupe_first_in_file(rows, ["date"], "DUPLICATE_HOLIDAY", "duplicate holiday date in artifact")


ALLOWED = {
    "reporting_frequency": ("QUARTERLY", "ANNUAL"), "scope": ("CONSOLIDATED", "STANDALONE"),
    "audit_status": ("AUDITED", "UNAUDITED", "UNKNOWN"), "fact_kind": ("DURATION", "INSTANT"),
    "value_nature": ("QUARTERLY", "YTD", "ANNUAL", "INSTANT"),
}


DATES = ("period_start", "period_end", "fact_period_start", "fact_period_end")


def norm_fundamental_facts(df: DataFrame, source_date=None) -> DataFrame:
    code = "MALFORMED_FUNDAMENTAL_FACT"
    rows = _with(df, *fv.OPTIONAL_HEADERS["fundamental_facts"]).withColumns(_upper(
        "symbol", "series", "isin", "reporting_frequency", "scope", "audit_status", "fact_kind", "value_nature",
        "filing_type", "unit"))
    rows = rows.withColumn("audit_status", F.when(F.col("audit_status") == "", "UNKNOWN").otherwise(F.col("audit_status")))
    rows = rows.withColumns({f"_{c}": multi_format_date(F.col(c)) for c in DATES}).withColumns({
        "_value": number(F.col("value")), "_submitted": zoned_timestamp(F.col("submission_at"))})
    date = lambda c: F.col(f"_{c}")
    given = lambda c: F.trim(F.col(c)) != ""
    start = F.when(given("fact_period_start"), date("fact_period_start")).otherwise(date("period_start"))
    end = F.when(given("fact_period_end"), date("fact_period_end")).otherwise(date("period_end"))
    whole = lambda c: F.when(F.trim(F.col(c)).rlike(r"^[+-]?\d+$"), F.trim(F.col(c)).try_cast("int"))
    scale, year, quarter = whole("scale"), whole("fiscal_year"), whole("fiscal_quarter")
    submitted = F.col("_submitted")
    bad = lambda cond, text: (cond, "ERROR", code, text)
    rules = [
        *_identity(code), _not_equity(code, "ERROR"),
        bad(~given("source_filing_id"), "source filing id is blank"),
        bad(date("period_start").isNull(), "period start is not a supported date"),
        bad(date("period_end").isNull(), "period end is not a supported date"),
        bad(date("period_end") < date("period_start"), "period end precedes period start"),
        *[bad(~F.col(c).isin(*ok), f"{c.replace('_', ' ')} is unsupported") for c, ok in ALLOWED.items()],
        bad(scale.isNull() | (scale < 0) | (scale > 12), "scale must be between 0 and 12"),
        bad(year.isNull(), "fiscal year is not a number"),
        bad(given("fiscal_quarter") & (quarter.isNull() | ~quarter.between(1, 4)), "fiscal quarter must be 1 through 4"),
        bad(~given("source_concept"), "source concept is blank"),
        bad(~blank(F.col("value")) & F.col("_value").isNull(), "value is not a valid decimal"),
        bad(submitted.isNull(), "submission timestamp must be ISO-8601 with an offset"),
    ]
    if source_date is not None:
        rules.append(bad(F.to_date(submitted) > F.lit(source_date).cast("date"),
                         "submission timestamp cannot be later than the artifact source date"))
    rules += [
        bad(~given("unit"), "unit is blank"),
        bad(start.isNull(), "fact period start is not a supported date"),
        bad(end.isNull(), "fact period end is not a supported date"),
        bad(end < start, "fact period end precedes fact period start"),
    ]
    rows = rows.withColumn("issue", first_issue(rules)).withColumns({
        "fact_period_start": start, "fact_period_end": end, "scale": scale, "fiscal_year": year,
        "fiscal_quarter": quarter, "submission_at": submitted,
        "value": F.when(~blank(F.col("value")), F.col("_value").try_cast("decimal(30,8)")),
        "period_start": date("period_start"), "period_end": date("period_end"),
        "source_filing_id": F.trim("source_filing_id"), "source_concept": F.trim("source_concept"),
        "supersedes_source_filing_id": F.nullif(F.trim("supersedes_source_filing_id"), F.lit("")),
        "_concept": F.lower(F.trim("source_concept")),
    })
    return dedupe_first_in_file(
        rows, ["symbol", "source_filing_id", "_concept", "fact_period_start", "fact_period_end"],
        "DUPLICATE_FUNDAMENTAL_FACT", "duplicate filing fact in artifact").drop(
        "_concept", "_value", "_submitted", *[f"_{c}" for c in DATES])


def norm_classification(df: DataFrame) -> DataFrame:
    code = "MALFORMED_INDUSTRY_CLASSIFICATION"
    levels = ("macro", "sector", "industry", "basic_industry")
    rows = _with(df).withColumns({**_upper("symbol", "series", "isin"), **{c: F.trim(c) for c in levels}})
    rows = rows.withColumn("issue", first_issue([
        *_identity(code), _not_equity(code, "ERROR"),
        (any_of(*[F.col(c) == "" for c in levels]), "ERROR", code, "all four classification levels are required"),
    ]))
    return dedupe_first_in_file(rows, ["isin"], "DUPLICATE_INDUSTRY_CLASSIFICATION", "duplicate security classification")


# --- I28 ---------------------------------------------------------------------------------------------------------------
def availability_backfill(actions: DataFrame) -> DataFrame:
    """Publication time, else the end of the announcement day on the market clock, else the time of ingestion."""
    announced = F.to_utc_timestamp(F.timestamp_seconds(
        F.unix_date("announcement_date").cast("bigint") * 86400 + fv.CLOSE_FALLBACK_SECONDS), fv.MARKET_ZONE)
    return actions.withColumn("available_at", F.coalesce("published_at", announced, "ingested_at"))
