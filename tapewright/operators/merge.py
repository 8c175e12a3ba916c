"""Validating merges: compare incoming rows with what is stored, insert only what is new, never overwrite.

Every merge returns the incoming rows with `action` (INSERT, UNCHANGED, REJECT, CONFLICT) and `code`; inserts are
appended by `tapewright.sources.sinks`. Running a batch twice therefore changes nothing the second time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.fundamentals import map_concept, sector_benchmark
from tapewright.operators.pit import prices_range
from tapewright.session import cut_lineage

PRICE_FIELDS = ("open", "high", "low", "close", "volume", "traded_value")


def _same(fields: Sequence[str], left: str = "", right: str = "_s_") -> Column:
    """All fields null-safely equal to the stored copy."""
    return reduce(lambda a, b: a & b, [F.col(left + f).eqNullSafe(F.col(right + f)) for f in fields])


def _stored(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[F.col(f).alias(f"_s_{f}") for f in fields], F.lit(True).alias("_found"))


def _tag(df: DataFrame, *cases: tuple[Column, str, str | None]) -> DataFrame:
    """First matching case gives action and code; otherwise INSERT."""
    action, code = F.lit("INSERT"), F.lit(None).cast("string")
    for cond, act, why in reversed(cases):
        hit = F.coalesce(cond, F.lit(False))
        action, code = F.when(hit, act).otherwise(action), F.when(hit, F.lit(why)).otherwise(code)
    return df.withColumns({"action": action, "code": code})


def _in_batch(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Mark rows of a batch that share a key: `_later` is true for all but the first, `_as_first` where the values agree.

    Rows follow artifact and row number where the batch has them, else their values. A key has few rows in a batch.
    """
    order = [c for c in ("artifact_no", "artifact_id", "row_no") if c in rows.columns] + list(fields)
    over = Window.partitionBy(*keys).orderBy(*order)
    first = F.first(F.struct(*fields)).over(over)
    return rows.withColumns({"_later": F.row_number().over(over) > 1, "_first": first, "_as_first": first.eqNullSafe(F.struct(*fields))})


def _value_hash(fields: Sequence[str], prefix: str = "") -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(prefix + f).cast("string") for f in fields]), 256)


def _with_hashes(tagged: DataFrame, fields: Sequence[str], *held: Column) -> DataFrame:
    """On a conflict the hashes of the incoming values and of those held: stored ones, else the batch's first of the key."""
    clash = F.col("action") == "CONFLICT"
    first = F.when(F.col("_later"), _value_hash(fields, "_first."))
    existing = F.coalesce(F.when(F.col("_found"), _value_hash(fields, "_s_")), *held, first)
    return tagged.withColumns({"existing_hash": F.when(clash, existing), "incoming_hash": F.when(clash, _value_hash(fields))})


def _clean(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def _by_symbol(securities: DataFrame, *columns: str) -> DataFrame:
    """One row per symbol, whatever the master repeats; `_n1` counts the securities that share it."""
    return securities.groupBy("symbol").agg(
        F.min("series").alias("_k1"), F.count_distinct("series").alias("_n1"), *[F.min(c).alias(f"_{c[0]}1") for c in columns])


def _by_isin(securities: DataFrame) -> DataFrame:
    return securities.where(F.col("isin").isNotNull()).groupBy("isin").agg(
        F.min("series").alias("_k2"), F.count_distinct("series").alias("_n2"))


def _with_isin(rows: DataFrame, by_isin: DataFrame) -> DataFrame:
    """Left join on ISIN; rows without one get a key of their own, so they do not meet in one partition."""
    spread = F.coalesce("isin", F.concat(F.lit("-"), F.col("symbol")))
    return rows.withColumn("_isin", spread).join(by_isin.withColumnRenamed("isin", "_isin"), "_isin", "left")


# --- I16 ----------------------------------------------------------------------------------------------------------
def resolve_identity(rows: DataFrame, securities: DataFrame) -> DataFrame:
    """Add `key` where symbol and ISIN (if given) hit the same security of a compatible board, else why not."""
    master, by_isin = _by_symbol(securities, "board"), _by_isin(securities)
    joined = _with_isin(rows.join(master, "symbol", "left"), by_isin)
    other = F.col("isin").isNotNull() & ~F.col("_k1").eqNullSafe(F.col("_k2"))
    board = F.col("_b1").isNotNull() & (F.col("_b1") != F.col("board"))
    several = (F.coalesce("_n1", F.lit(1)) > 1) | (F.coalesce("_n2", F.lit(1)) > 1)
    why = F.when(F.col("_k1").isNull(), "SECURITY_NOT_IN_MASTER").when(several | other | board, "AMBIGUOUS_SECURITY")
    out = joined.withColumns({"identity_issue": why, "key": F.when(why.isNull(), F.col("_k1"))})
    return _clean(out)


# --- I17-I22 --------------------------------------------------------------------------------------------------------
def merge_prices(incoming: DataFrame, stored: DataFrame, calendar: DataFrame) -> DataFrame:
    """Keyed by (series, session); a batch dated on a confirmed holiday conflicts as a whole. Conflicts carry hashes of both values.

    Of rows of a batch with one key the first is compared with the tape and the others with it, so a key is inserted once.
    """
    closed = calendar.where(~F.col("is_trading_day")).select("session", F.lit(True).alias("_closed")).distinct()
    old = _stored(stored.where(F.col("origin") == "OFFICIAL"), ["series", "session"], PRICE_FIELDS)
    other = stored.where(F.col("origin") != "OFFICIAL").groupBy("series", "session").agg(
        F.lit(True).alias("_other"), F.min(_value_hash(PRICE_FIELDS)).alias("_other_hash"))
    batch = _in_batch(incoming, ["series", "session"], PRICE_FIELDS)
    rows = batch.join(old, ["series", "session"], "left").join(other, ["series", "session"], "left").join(
        closed, "session", "left")
    tagged = _tag(
        rows, (F.col("_closed"), "CONFLICT", "CALENDAR_CONFLICT"),
        (F.col("_other"), "CONFLICT", "HISTORICAL_DATA_CONFLICT"),
        (F.col("_found") & _same(PRICE_FIELDS), "UNCHANGED", None),
        (F.col("_found"), "CONFLICT", "HISTORICAL_DATA_CONFLICT"), (F.col("_later") & F.col("_as_first"), "UNCHANGED", None),
        (F.col("_later"), "CONFLICT", "HISTORICAL_DATA_CONFLICT"))
    return _clean(_with_hashes(tagged, PRICE_FIELDS, F.col("_other_hash")))


def confirmed_sessions(merged: DataFrame, calendar: DataFrame, exchange: str = "X") -> DataFrame:
    """Calendar rows that an accepted price batch confirms."""
    days = merged.where(F.col("action").isin("INSERT", "UNCHANGED")).select("session").distinct()
    known = calendar.where(F.col("exchange") == exchange).select("session")
    return days.join(known, "session", "left_anti").select(
        F.lit(exchange).alias("exchange"), "session", F.lit(True).alias("is_trading_day"))


def merge_securities(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    rows = _with_isin(incoming.join(_by_symbol(stored, "board", "company_name"), "symbol", "left"), _by_isin(stored))
    rows = _in_batch(rows, ["symbol"], ("isin", "board", "company_name"))
    several = (F.coalesce("_n1", F.lit(1)) > 1) | (F.coalesce("_n2", F.lit(1)) > 1)
    hit = F.col("_k1").isNotNull() | F.col("_k2").isNotNull()
    split = ~F.col("_k1").eqNullSafe(F.col("_k2"))
    board = F.col("_b1").isNotNull() & (F.col("_b1") != F.col("board"))
    return _clean(_tag(
        rows, (hit & (several | split | board), "CONFLICT", "SECURITY_IDENTITY_CONFLICT"),
        (hit & (F.col("_c1") != F.col("company_name")), "UNCHANGED", "SECURITY_METADATA_DRIFT"),
        (hit, "UNCHANGED", None), (F.col("_later") & F.col("_as_first"), "UNCHANGED", None),
        (F.col("_later"), "CONFLICT", "SECURITY_IDENTITY_CONFLICT")))


def merge_index_prices(incoming: DataFrame, stored: DataFrame, available_at: Column | None = None) -> DataFrame:
    """As prices; rows to insert get `available_at`, when the batch was known, if it is told."""
    fields = ("open", "high", "low", "close")
    batch = _in_batch(incoming, ["index_id", "session"], fields)
    rows = batch.join(_stored(stored, ["index_id", "session"], fields), ["index_id", "session"], "left")
    tagged = _tag(rows, (F.col("_found") & _same(fields), "UNCHANGED", None),
                  (F.col("_found"), "CONFLICT", "INDEX_PRICE_CONFLICT"), (F.col("_later") & F.col("_as_first"), "UNCHANGED", None),
                  (F.col("_later"), "CONFLICT", "INDEX_PRICE_CONFLICT"))
    out = _clean(_with_hashes(tagged, fields))
    return out if available_at is None else out.withColumn("available_at", F.when(F.col("action") == "INSERT", available_at))


def merge_actions(incoming: DataFrame, stored: DataFrame, securities: DataFrame) -> DataFrame:
    """Rows with a publication time only; an equal ratio and time is unchanged, any other hit needs a revision link."""
    rows = incoming.where(F.col("published_at").isNotNull())
    known = securities.select("series", F.lit(True).alias("_known"))
    on = ["series", "type", "ex_date"]
    hits = stored.groupBy(*on).agg(F.count(F.lit(1)).alias("_hits"))
    equal = stored.select(*on, "num", "den", F.col("available_at").alias("published_at"), F.lit(True).alias("_identical")).distinct()
    rows = _in_batch(rows, on, ("num", "den", "published_at")).join(known.distinct(), "series", "left").join(hits, on, "left").join(
        equal, [*on, "num", "den", "published_at"], "left")
    return _clean(_tag(
        rows, (F.col("_known").isNull(), "REJECT", "AMBIGUOUS_SECURITY"), (F.col("_identical"), "UNCHANGED", None),
        (F.col("_hits") > 0, "CONFLICT", "CORPORATE_ACTION_REVISION_UNRESOLVED"), (F.col("_later") & F.col("_as_first"), "UNCHANGED", None),
        (F.col("_later"), "CONFLICT", "CORPORATE_ACTION_REVISION_UNRESOLVED")))


def merge_holidays(incoming: DataFrame, calendar: DataFrame, exchange: str = "X") -> DataFrame:
    known = calendar.where(F.col("exchange") == exchange).select("session", F.col("is_trading_day").alias("_open"))
    rows = _in_batch(incoming, ["session"], ("session",)).join(known.groupBy("session").agg(F.max("_open").alias("_open")), "session", "left")
    return _clean(_tag(rows, (F.col("_open"), "CONFLICT", "CALENDAR_CONFLICT"), (~F.col("_open"), "UNCHANGED", None), (F.col("_later"), "UNCHANGED", None)))


# --- I19 -----------------------------------------------------------------------------------------------------------
def snapshot_status(snapshots: DataFrame, stored: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per (index, date) of incoming snapshots: INSERT, UNCHANGED, CONFLICT or REJECT.

    `expected` has (index_id, expected), the exact size of each index. Sets are compared by counts of a full join, not
    by collecting members; `key` is null for unresolved members.
    """
    on = ["index_id", "snapshot_date"]
    per = snapshots.groupBy(*on).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("key").isNull()).alias("unresolved"))
    old = stored.select("index_id", F.col("valid_from").alias("snapshot_date"), F.col("series").alias("key"), F.lit(1).alias("o"))
    new = snapshots.where(F.col("key").isNotNull()).select(*on, "key", F.lit(1).alias("n")).distinct()
    diff = new.join(old.join(per.select(*on), on, "left_semi"), [*on, "key"], "full").groupBy(*on).agg(
        F.count("o").alias("stored"), F.count_if(F.col("o").isNull() | F.col("n").isNull()).alias("differing"))
    rows = per.join(diff, on, "left").join(expected, "index_id", "left")
    return _tag(
        rows, (F.col("unresolved") > 0, "REJECT", "UNKNOWN_INDEX_SECURITY"),
        (F.col("members") != F.col("expected"), "REJECT", "UNEXPECTED_MEMBER_COUNT"),
        ((F.col("stored") > 0) & (F.col("differing") == 0), "UNCHANGED", None),
        (F.col("stored") > 0, "CONFLICT", "INDEX_SNAPSHOT_CONFLICT")).drop("unresolved", "stored", "differing", "expected")


def snapshot_to_intervals(stored: DataFrame, snapshots: DataFrame, statuses: DataFrame) -> DataFrame:
    """Memberships after applying the inserted snapshots: each snapshot ends the day before the next of its index."""
    on = ["index_id", "snapshot_date"]
    new = snapshots.join(statuses.where("action = 'INSERT'"), on, "left_semi").select(
        "index_id", F.col("key").alias("series"), F.col("snapshot_date").alias("valid_from"))
    dates = new.select("index_id", "valid_from").distinct()
    w = Window.partitionBy("index_id").orderBy("valid_from")  # one row per snapshot
    ends = dates.withColumn("valid_to", F.date_sub(F.lead("valid_from").over(w), 1))
    fresh = new.join(ends, ["index_id", "valid_from"]).select("index_id", "series", "valid_from", "valid_to")
    # an open stored interval ends before the first new snapshot after its start
    opened = stored.where(F.col("valid_to").isNull())
    starts = opened.select("index_id", "valid_from").distinct()
    close = starts.join(dates.withColumnRenamed("valid_from", "next"), "index_id").where(
        F.col("next") > F.col("valid_from")).groupBy("index_id", "valid_from").agg(
        F.date_sub(F.min("next"), 1).alias("_end"))
    ended = stored.join(close, ["index_id", "valid_from"], "left").withColumn(
        "valid_to", F.coalesce("valid_to", "_end")).select("index_id", "series", "valid_from", "valid_to")
    return ended.unionByName(fresh)


# --- I23, I24 ---------------------------------------------------------------------------------------------------------
HEAD = ("filing_type", "reporting_frequency", "period_start", "period_end", "fiscal_year", "fiscal_quarter", "scope",
        "audit_status", "submission_at", "supersedes_source_filing_id")


def filing_groups(rows: DataFrame) -> DataFrame:
    """One row per (symbol, filing): metadata, whether rows disagree on it, and a fingerprint of its facts.

    A filing's facts are hashed row by row and the sorted hashes hashed again, so only 64 characters per fact meet. `place` is its first
    row in the batch.
    """
    head = F.struct(*[F.col(c) for c in HEAD])
    line = F.sha2(F.to_json(F.struct("source_concept", F.col("value").cast("string"), "unit", "scale", "fact_kind",
                                     "value_nature", "fact_period_start", "fact_period_end")), 256)
    body = F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(line))), 256)
    grouped = rows.groupBy("symbol", "isin", "source_filing_id").agg(
        F.count(F.lit(1)).alias("facts"), F.min(head).alias("h"), (F.min(head) != F.max(head)).alias("inconsistent"),
        body.alias("_body"), F.min(F.struct("artifact_id", "row_no")).alias("place"))
    return grouped.select("symbol", "isin", "source_filing_id", "facts", "inconsistent", "place", "h.*", F.sha2(
        F.concat_ws("|", "symbol", "source_filing_id", F.to_json("h"), "_body"), 256).alias("fingerprint"))


def merge_filings(groups: DataFrame, stored: DataFrame, securities: DataFrame, in_batch: bool = True) -> DataFrame:
    """`stored` filings hold symbol, source_filing_id, fingerprint and supersedes_source_filing_id.

    With `in_batch` a filing may also revise one that an earlier row of the batch inserts, through any number of revisions; of
    several revisions of one filing the first is inserted and the others are conflicts. `groups` then need `place`.
    """
    master = securities.select("symbol", "isin", F.lit(True).alias("_sec"))
    same = stored.select("fingerprint", F.lit(True).alias("_identical")).distinct()
    own = stored.select("symbol", "source_filing_id", F.lit(True).alias("_own")).distinct()
    prior = stored.select("symbol", F.col("source_filing_id").alias("supersedes_source_filing_id"),
                          F.lit(True).alias("_prior")).distinct()
    taken = stored.where(F.col("supersedes_source_filing_id").isNotNull()).select(
        "symbol", "supersedes_source_filing_id", F.lit(True).alias("_taken")).distinct()
    rows = groups.join(master, ["symbol", "isin"], "left").join(same, "fingerprint", "left").join(
        own, ["symbol", "source_filing_id"], "left").join(
        prior, ["symbol", "supersedes_source_filing_id"], "left").join(
        taken, ["symbol", "supersedes_source_filing_id"], "left")
    revises = F.col("supersedes_source_filing_id").isNotNull()
    if in_batch:
        rows = cut_lineage(rows)
        rows = rows.join(_batch_revisions(rows), ["symbol", "source_filing_id"], "left").withColumns({
            "_prior": F.when(F.coalesce("_prior", "_reached", F.lit(False)), True), "_taken": F.coalesce("_taken", F.lit(False)) | F.coalesce("_beaten", F.lit(False))})
    return _clean(_tag(
        rows, (F.col("_sec").isNull(), "REJECT", "FUNDAMENTAL_SECURITY_IDENTITY_UNRESOLVED"),
        (F.col("inconsistent"), "CONFLICT", "INCONSISTENT_FILING_METADATA"),
        (F.col("_identical"), "UNCHANGED", None),
        (revises & F.col("_prior").isNull(), "REJECT", "SUPERSEDED_FILING_NOT_FOUND"),
        (revises & F.col("_taken"), "CONFLICT", "FILING_REVISION_CONFLICT"),
        (F.col("_own"), "CONFLICT", "FILING_CONTENT_CONFLICT")))


def _batch_revisions(rows: DataFrame) -> DataFrame:
    """For each revision of the batch: `_reached`, every filing it goes back to is stored or inserted before it, and `_beaten`.

    Links to filings of the batch are doubled: a round looks twice as far back, so a chain of n revisions takes log n rounds.
    """
    key, old = ["symbol", "source_filing_id"], F.col("supersedes_source_filing_id")
    sound = F.col("_sec").isNotNull() & ~F.col("inconsistent") & F.col("_identical").isNull() & F.col("_own").isNull() & (old.isNull() | F.col("_taken").isNull())
    first = rows.where(sound & old.isNotNull()).groupBy("symbol", "supersedes_source_filing_id").agg(
        F.min(F.struct("place", "source_filing_id")).alias("_first"))
    nodes = rows.select(*key, "supersedes_source_filing_id", "place", "_prior", sound.alias("_sound")).join(
        first, ["symbol", "supersedes_source_filing_id"], "left").withColumn(
        "_beaten", F.col("_sound") & F.coalesce(F.struct("place", "source_filing_id") > F.col("_first"), F.lit(False)))
    before = nodes.select("symbol", F.col("source_filing_id").alias("supersedes_source_filing_id"), F.col("place").alias("_before"))
    # A link leads to a filing of the batch. What has no link stands on what is stored, or revises nothing.
    links = cut_lineage(nodes.join(before, ["symbol", "supersedes_source_filing_id"], "left").select(
        *key, "_beaten", F.when(old.isNotNull() & F.col("_prior").isNull(), old).alias("up"),
        (F.col("_prior").isNotNull() | old.isNull() | F.coalesce(F.col("_before") < F.col("place"), F.lit(False))).alias("_reached"),
        (F.col("_sound") & ~F.col("_beaten")).alias("_inserts")))
    while not links.where("up IS NOT NULL AND _reached").isEmpty():
        further = links.select("symbol", F.col("source_filing_id").alias("up"), F.col("up").alias("_up"), (F.col("_reached") & F.col("_inserts")).alias("_there"))
        links = cut_lineage(links.join(further, ["symbol", "up"], "left").select(
            *key, "_beaten", F.when(F.col("_reached") & F.coalesce("_there", F.lit(False)), F.col("_up")).alias("up"),
            (F.col("_reached") & (F.col("up").isNull() | F.coalesce("_there", F.lit(False)))).alias("_reached"), "_inserts"))
    return links.select(*key, "_reached", "_beaten")


def unmapped_concepts(rows: DataFrame) -> DataFrame:
    """Facts kept without a canonical concept, counted per label."""
    return rows.where(map_concept(F.col("source_concept")).isNull()).groupBy("source_concept").agg(
        F.count(F.lit(1)).alias("facts"))


def merge_classification(incoming: DataFrame, stored: DataFrame, securities: DataFrame,
                         mapping: dict[str, str] | None = None) -> DataFrame:
    fields = ("macro", "sector", "industry", "basic_industry")
    master = securities.select("series", F.lit(True).alias("_sec"))
    batch = _in_batch(incoming, ["series", "snapshot_date"], fields)
    rows = batch.join(master, "series", "left").join(
        _stored(stored, ["series", "snapshot_date"], fields), ["series", "snapshot_date"], "left")
    out = _tag(rows, (F.col("_sec").isNull(), "REJECT", "CLASSIFICATION_SECURITY_IDENTITY_UNRESOLVED"),
               (F.col("_found") & _same(fields), "UNCHANGED", None),
               (F.col("_found"), "CONFLICT", "CLASSIFICATION_SNAPSHOT_CONFLICT"),
               (F.col("_later") & F.col("_as_first"), "UNCHANGED", None),
               (F.col("_later"), "CONFLICT", "CLASSIFICATION_SNAPSHOT_CONFLICT"))
    return _clean(out.withColumn("benchmark", sector_benchmark(F.col("sector"), mapping)))


# --- I25-I27, I29, I30 ---------------------------------------------------------------------------------------------------
def artifact_identity(incoming: DataFrame, log: DataFrame) -> DataFrame:
    """SEEN for a known checksum, REVISION_CONFLICT for another checksum of the same day, else NEW."""
    on = ["provider", "artifact_type", "source_date"]
    known = log.select(*on, "sha256", F.lit(True).alias("_seen")).distinct()
    days = log.select(*on, F.lit(True).alias("_day")).distinct()
    rows = incoming.join(known, [*on, "sha256"], "left").join(days, on, "left")
    state = F.when(F.col("_seen"), "SEEN").when(F.col("_day"), "REVISION_CONFLICT").otherwise("NEW")
    return rows.withColumn("state", state).drop("_seen", "_day")


def ingest_summary(merged: DataFrame, parse_rejected: DataFrame, keys: Sequence[str] = ("artifact_id",)) -> DataFrame:
    """Counts per artifact and SUCCEEDED or PARTIAL. `parse_rejected` has (artifact_id, rejected, warnings)."""
    n = lambda *acts: F.count_if(F.col("action").isin(*acts))
    counts = merged.groupBy(*keys).agg(
        n("INSERT").alias("inserted"), n("UNCHANGED").alias("unchanged"), n("REJECT", "CONFLICT").alias("_rej"),
        n("CONFLICT").alias("conflicts"),
        F.count_if((F.col("action") == "UNCHANGED") & F.col("code").isNotNull()).alias("_warn"))
    rows = counts.join(parse_rejected, list(keys), "full").fillna(0)
    rejected, warnings = F.col("_rej") + F.col("rejected"), F.col("_warn") + F.col("warnings")
    status = F.when((rejected > 0) | (F.col("conflicts") > 0) | (warnings > 0), "PARTIAL").otherwise("SUCCEEDED")
    return rows.select(*keys, "inserted", "unchanged", rejected.alias("rejected"), "conflicts",
                       warnings.alias("warnings"), status.alias("status"))


def sessions_to_fetch(calendar: DataFrame, benchmark: DataFrame, log: DataFrame, start, end) -> DataFrame:
    """Days of [start, end] still to import: benchmark sessions if the benchmark spans the range, otherwise weekdays
    that are no confirmed holiday; less the days already imported."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    days = calendar.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("session"))
    span = benchmark.agg((F.coalesce(F.min("session") <= first, F.lit(False)) & F.coalesce(
        F.max("session") >= last, F.lit(False))).alias("spans"))
    marks = benchmark.select("session", F.lit(True).alias("_bench")).distinct()
    shut = calendar.where(~F.col("is_trading_day")).select("session", F.lit(True).alias("_shut")).distinct()
    done = log.where(F.col("status").isin("SUCCEEDED", "PARTIAL")).select(F.col("source_date").alias("session")).distinct()
    rows = days.crossJoin(span).join(marks, "session", "left").join(shut, "session", "left")  # one row on the right
    wanted = F.when(F.col("spans"), F.col("_bench").isNotNull()).otherwise(
        (F.weekday("session") < 5) & F.col("_shut").isNull())
    return rows.where(wanted).join(done, "session", "left_anti").select("session")


def batch_report(log: DataFrame, batch: str) -> DataFrame:
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return log.groupBy(batch).agg(
        F.count(F.lit(1)).alias("artifacts"), n("FAILED").alias("failures"), n("SEEN").alias("skipped_existing"),
        n("NON_SESSION").alias("skipped_non_sessions"),
        *[F.sum(c).alias(c) for c in ("inserted", "unchanged", "rejected", "conflicts", "warnings")])


def filing_batch_report(linked: DataFrame, facts: DataFrame) -> DataFrame:
    """`linked` is the output of `link_listing_to_files`; `facts` the numeric facts of the matched files."""
    heads = linked.agg(
        F.count_if(F.col("listing_file").isNotNull()).alias("listing_rows"),
        F.count_if(F.col("link") == "LINKED").alias("matched"),
        F.count_if(F.col("link").isin("UNLINKED", "AMBIGUOUS_LISTING_LINK")).alias("rejected"),
        F.count_if(F.col("link") == "MISSING_FILE").alias("missing_files"),
        F.min(F.when(F.col("link") == "LINKED", F.col("broadcast_at"))).alias("first_available"),
        F.max(F.when(F.col("link") == "LINKED", F.col("broadcast_at"))).alias("last_available"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("link") == "LINKED", F.col("scope")))), ",").alias("scopes"))
    mapped = map_concept(F.col("concept")).isNotNull()
    body = facts.agg(F.count(F.lit(1)).alias("facts"), F.count_if(mapped).alias("mapped"), F.count_if(~mapped).alias("unmapped"))
    return heads.crossJoin(body)  # one row each
