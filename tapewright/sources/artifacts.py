"""Readers of artifact files: CSV with header aliases, zipped CSV, JSON index history, financial filings in XML."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.fixed_values import FILING_TAXONOMIES, HEADERS, OPTIONAL_HEADERS, QUARTER_DAYS, UNIT_CODES
from tapewright.functions.parsing import fold_header
from tapewright.sources.instances import read_instances


#: Lines of an archive that are handed on at once.
LINES_AT_ONCE = 50_000


class SchemaDrift(ValueError):
    """An artifact's columns do not fit its kind; the whole artifact fails."""


# --- I1 -----------------------------------------------------------------------------------------------------------
def header_map(headers: Iterable[str], kind: str) -> dict[str, str]:
    """canonical name -> header found; first alias wins, missing required or repeated headers are drift."""
    headers = [h.strip() for h in headers]
    if headers and headers[-1] == "":
        headers = headers[:-1]
    if not headers or "" in headers:
        raise SchemaDrift("header is missing or malformed")
    if len({h.casefold() for h in headers}) != len(headers):
        raise SchemaDrift("header contains duplicate column names")
    found = {fold_header(h): h for h in headers}
    out = {}
    for name, aliases in HEADERS[kind].items():
        hit = next((found[fold_header(a)] for a in aliases if fold_header(a) in found), None)
        if hit is not None:
            out[name] = hit
    missing = sorted(set(HEADERS[kind]) - set(OPTIONAL_HEADERS[kind]) - set(out))
    if missing:
        raise SchemaDrift("missing required columns: " + ", ".join(missing))
    return out


def resolve_headers(df: DataFrame, kind: str, keep: Iterable[str] = ("artifact_id", "row_no")) -> DataFrame:
    """Rename text columns to canonical names and trim them."""
    keep = [c for c in keep if c in df.columns]
    names = header_map([c for c in df.columns if c not in keep], kind)
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(*keep, *[F.trim(F.coalesce(quoted(h).cast("string"), F.lit(""))).alias(n) for n, h in names.items()])


def scan_aliased_csv(spark: SparkSession, path, kind: str) -> DataFrame:
    """CSV or CSV.GZ files of one kind and header; a file whose header differs fails the read.

    `artifact_id` is the file, `row_no` orders its rows (block of the file, then position).
    """
    raw = spark.read.options(header=True, enforceSchema=False, multiLine=False, mode="FAILFAST").csv(path)
    columns = raw.columns
    trailing = [c for c in columns[-1:] if c == f"_c{len(columns) - 1}"]
    placed = raw.drop(*trailing).select(
        F.col("_metadata.file_path").alias("artifact_id"),
        (F.col("_metadata.file_block_start") * F.lit(1 << 24) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .alias("row_no"), *[c for c in columns if c not in trailing])
    return resolve_headers(placed, kind)


#: A comma with an even number of quotes after it.
OUTSIDE_QUOTES = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _lines_of_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inflate the one CSV of each archive, a bounded part at a time, into numbered lines."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                members = [m for m in archive.namelist() if m.lower().endswith(".csv")]
                if len(members) != 1:
                    raise SchemaDrift("archive must hold exactly one CSV")
                number, held = 0, []
                for line in io.TextIOWrapper(archive.open(members[0]), "utf-8-sig"):
                    number += 1
                    held.append(line.rstrip("\r\n"))
                    if len(held) == LINES_AT_ONCE:
                        yield _numbered(path, number, held)
                        held = []
                if held:
                    yield _numbered(path, number, held)


def _numbered(path: str, last: int, lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "artifact_id": [path] * len(lines), "row_no": list(range(last - len(lines) + 1, last + 1)), "line": lines})


def scan_zipped_csv(spark: SparkSession, path, kind: str) -> DataFrame:
    """One CSV per zip archive, whatever the order of its columns; `row_no` is the line in the file, the header being 1.

    Python only inflates. Lines are split by Spark, and every archive's header is matched by alias on its own.
    """
    lines = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(
        _lines_of_archives, "artifact_id string, row_no bigint, line string").where("trim(line) <> ''")
    quoted = lambda x: F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), '""', '"')).otherwise(x)
    cells = lines.select("artifact_id", "row_no", F.transform(F.split("line", OUTSIDE_QUOTES, -1), lambda x: quoted(F.trim(x))).alias("cells"))
    folded = F.transform("cells", lambda h: F.regexp_replace(F.upper(F.coalesce(h, F.lit(""))), "[^A-Z0-9]", ""))
    named = cells.where("row_no = 1").select("artifact_id", folded.alias("_names"))
    given = F.filter("_names", lambda h: h != "")
    places = {n: F.coalesce(*[F.nullif(F.array_position("_names", fold_header(a)), F.lit(0)) for a in aliases]) for n, aliases in HEADERS[kind].items()}
    missing = [n for n in HEADERS[kind] if n not in OPTIONAL_HEADERS[kind]]
    drift = F.when(F.size(F.array_distinct(given)) < F.size(given), F.raise_error(F.lit("header contains duplicate column names")).cast("bigint"))
    for n in missing:
        drift = drift.when(places[n].isNull(), F.raise_error(F.lit(f"missing required columns: {n}")).cast("bigint"))
    headers = named.select("artifact_id", F.coalesce(drift, F.lit(0)).alias("_ok"), *[places[n].cast("int").alias(f"_{n}") for n in HEADERS[kind]])
    rows = cells.where("row_no > 1").join(headers, "artifact_id").where("_ok = 0")
    return rows.select("artifact_id", "row_no", *[
        F.coalesce(F.trim(F.try_element_at("cells", F.col(f"_{n}"))), F.lit("")).alias(n) for n in HEADERS[kind]])


# --- I4: JSON -----------------------------------------------------------------------------------------------------------
def json_rows(documents: DataFrame, kind: str = "index_history") -> DataFrame:
    """(artifact_id, content) with an array of objects, bare or under d/data/result, possibly string-encoded."""
    text = F.col("content")
    unwrap = F.coalesce(
        F.when(F.substring(F.trim(text), 1, 1) == '"', F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "x string")["x"]),
        text)
    inner = F.coalesce(*[F.get_json_object("_t", f"$.{k}") for k in ("d", "data", "result", "Data")], F.col("_t"))
    rows = documents.withColumn("_t", unwrap).withColumn("_a", F.from_json(inner, "array<map<string,string>>"))
    broken = F.when(F.col("_a").isNull(), F.raise_error(F.lit("JSON does not contain a row array")).cast(
        "array<map<string,string>>")).otherwise(F.col("_a"))
    cells = rows.select("artifact_id", F.posexplode(broken).alias("i", "cells"))
    folded = F.map_from_entries(F.transform(F.map_entries("cells"), lambda e: F.struct(
        F.regexp_replace(F.upper(e["key"]), "[^A-Z0-9]", "").alias("k"), F.trim(F.coalesce(e["value"], F.lit(""))).alias("v"))))
    picked = [F.coalesce(*[F.try_element_at(folded, F.lit(fold_header(a))) for a in aliases], F.lit("")).alias(n)
              for n, aliases in HEADERS[kind].items()]
    return cells.select("artifact_id", (F.col("i") + 1).cast("bigint").alias("row_no"), *picked)


def scan_index_json(spark: SparkSession, path) -> DataFrame:
    documents = spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("artifact_id"), F.regexp_replace("value", "^﻿", "").alias("content"))
    return json_rows(documents)


# --- I10, I11: filings ---------------------------------------------------------------------------------------------------
def link_listing_to_files(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Match listing rows and files by name: LINKED, AMBIGUOUS_LISTING_LINK, UNLINKED or MISSING_FILE."""
    counts = listing.groupBy("file_name").agg(F.count(F.lit(1)).alias("_n"))
    rows = listing.join(counts, "file_name").withColumn("listing_file", F.col("file_name")).join(
        files.select("file_name", F.lit(True).alias("_has")).distinct(), "file_name", "full")
    link = F.when(F.col("listing_file").isNull(), "UNLINKED").when(F.col("_has").isNull(), "MISSING_FILE").when(
        F.col("_n") > 1, "AMBIGUOUS_LISTING_LINK").otherwise("LINKED")
    return rows.withColumn("link", link).drop("_n", "_has")


CONTEXT_NAMES = ("OneD", "FourD", "OneI")


def _told(facts: str, name: str) -> Column:
    """What a document says of itself under a name, in capitals."""
    hit = F.filter(facts, lambda f: f["concept"] == name)
    return F.upper(F.trim(F.try_element_at(hit, F.lit(-1))["text"]))


def unit_code(unit: Column) -> Column:
    """Canonical code of a unit's name, in capitals and at most 32 characters where it has none."""
    folded = F.upper(F.replace(unit, F.lit("_"), F.lit("")))
    named = F.create_map(*[F.lit(x) for pair in UNIT_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(named, folded), F.substring(F.upper(unit), 1, 32))


def _day(text: Column) -> Column:
    return F.try_to_date(F.nullif(text, F.lit("")), "yyyy-MM-dd")


def xbrl_facts(linked_files: DataFrame, taxonomies: Iterable[str] = FILING_TAXONOMIES) -> DataFrame:
    """Numeric facts of linked files (file_name, content, symbol, scope, period_end); a refused file gives one error row.

    A filing is one row, tokenized by `read_instances` and checked with column expressions, without a shuffle.
    Amounts are compared as decimals of any scale: an equal repetition is dropped, a different one refuses the file. What is no
    finite decimal (NaN and infinities included) is malformed. Numeric facts have to belong to one of `taxonomies`.
    """
    read = read_instances(linked_files.select("file_name", "symbol", "scope", "period_end", "content")).withColumns({
        "_contexts": F.transform("contexts", lambda c: F.struct(
            c["name"].alias("name"), _day(c["start"]).alias("start"), F.coalesce(_day(c["instant"]), _day(c["end"])).alias("end"),
            F.coalesce(c["instant"] != "", F.lit(False)).alias("at_once"), c["sliced"].alias("sliced"), c["has_period"].alias("has_period"))),
        "_units": F.map_from_entries(F.filter(F.transform("units", lambda u: F.struct(u["name"], u["measure"])), lambda u: u["name"] != ""))})
    days = lambda c: F.date_diff(c["end"], c["start"]) + 1
    quarter_long = lambda c: days(c).between(*QUARTER_DAYS)
    usable = F.filter("_contexts", lambda c: c["name"].isin(*CONTEXT_NAMES) & ~c["sliced"] & (c["end"] == F.col("period_end")))
    read = read.withColumns({"_usable": usable, "_month": F.month("period_end")})
    read = read.withColumn("_own", F.transform(
        F.filter("facts", lambda f: F.exists("_usable", lambda c: c["name"] == f["context"])),
        lambda f: F.struct("file_name", f.alias("f"), F.element_at(F.filter("_usable", lambda c: c["name"] == f["context"]), 1).alias("c"))))
    read = read.withColumn("_told", F.transform("_own", lambda o: o["f"]))
    numeric = F.filter("_own", lambda o: o["f"]["unit"].isNotNull())
    main = F.exists("_usable", lambda c: (c["name"] == "OneD") & c["start"].isNotNull() & ~c["at_once"] & quarter_long(c))
    isin = F.coalesce(_told("_told", "ISIN"), F.lit(""))
    unnamed = F.exists("_contexts", lambda c: (c["name"] == "") | ~c["has_period"] | c["end"].isNull() | (c["start"].isNull() & ~c["at_once"]))
    refused = F.coalesce(F.col("problem"), *[F.when(F.coalesce(bad, F.lit(True)), F.lit(why)) for bad, why in (
        (unnamed | (F.size(F.array_distinct(F.transform("_contexts", lambda c: c["name"]))) < F.size("_contexts")), "context is incomplete or repeated"),
        (~main, "no verified OneD quarterly context"),
        (F.exists(numeric, lambda o: ~o["f"]["namespace"].isin(*taxonomies)), "taxonomy is not supported"),
        (F.coalesce(_told("_told", "Symbol"), F.lit("")) != F.col("symbol"), "symbol does not match the listing"),
        (~isin.rlike("^[A-Z0-9]{12}$"), "ISIN is malformed"),
        (F.coalesce(_told("_told", "NatureOfReportStandaloneConsolidated"), F.lit("")) != F.col("scope"), "scope does not match the listing"),
        (F.col("_month") % 3 != 0, "period is no fiscal quarter end"),
        (F.exists(numeric, lambda o: o["f"]["amount"].isNull()), "numeric fact is malformed"),
        (F.size(numeric) == 0, "no eligible numeric facts"))])
    read = read.select("file_name", "period_end", "_month", isin.alias("isin"), refused.alias("error"), numeric.alias("_numeric"), "_units")
    # Equal facts stand together once sorted, the first in the file first.
    ordered = F.sort_array(F.transform("_numeric", lambda o, i: F.struct(
        F.struct(F.lower(o["f"]["concept"]), F.when(o["c"]["at_once"], o["c"]["end"]).otherwise(o["c"]["start"]), o["c"]["end"]).alias("key"), i.alias("at"),
        o["f"]["amount"].alias("amount"), o["f"].alias("f"), F.regexp_replace(o["f"]["text"], ",", "").alias("value"), o["c"].alias("c"))))
    read = read.withColumn("_ordered", ordered)

    def repeats(f, i):
        return (i > 0) & (F.get("_ordered", i - 1)["key"] == f["key"])

    clash = F.filter("_ordered", lambda f, i: repeats(f, i) & (F.get("_ordered", i - 1)["amount"] != f["amount"]))
    read = read.select(
        "file_name", "period_end", "_month", "isin", "_units", F.coalesce("error", F.when(F.size(clash) > 0, "conflicting duplicate fact")).alias("error"),
        F.filter("_ordered", lambda f, i: ~repeats(f, i)).alias("_facts"))
    # A refused file explodes to one row without a fact.
    rows = read.select("file_name", "error", "period_end", "_month", "isin", "_units", F.explode_outer(F.when(F.col("error").isNull(), F.col("_facts"))).alias("o"))
    length = days(F.col("o.c"))
    span = F.when(F.col("o.c.at_once"), "INSTANT").when(length.between(*QUARTER_DAYS), "QUARTERLY").when(length.between(340, 380), "ANNUAL").otherwise("YTD")
    last_quarter = F.col("_month") == 3
    there = lambda c: F.when(F.col("error").isNull(), c)
    return rows.select(
        "file_name", "error", there(F.col("isin")).alias("isin"), F.col("o.f.concept").alias("concept"), F.col("o.value").alias("value"),
        unit_code(F.col("o.f.unit")).alias("unit"), F.coalesce(F.try_element_at("_units", F.col("o.f.unit")), F.col("o.f.unit")).alias("source_unit"),
        F.col("o.f.decimals").alias("decimals"), F.col("o.f.namespace").alias("namespace"), F.col("o.f.context").alias("context"), there(span).alias("nature"),
        there(F.when(F.col("o.c.at_once"), "INSTANT").otherwise("DURATION")).alias("fact_kind"),
        F.when(F.col("o.c.at_once"), F.col("o.c.end")).otherwise(F.col("o.c.start")).alias("fact_start"), F.col("o.c.end").alias("fact_end"),
        there(F.year("period_end") + F.when(last_quarter, 0).otherwise(1)).alias("fiscal_year"),
        there(F.when(last_quarter, 4).otherwise((F.col("_month") / 3 - 1).cast("int"))).alias("fiscal_quarter"))


def scan_files(spark: SparkSession, path) -> DataFrame:
    """Binary files with name, content and checksum."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), "content", F.sha2("content", 256).alias("sha256"))
