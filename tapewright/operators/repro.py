"""Fingerprints of rows, data sets and runs, and the run log.

Set fingerprints are built in levels (row, series, bucket of series, whole), each a hash over sorted hashes of a
bounded group, so that no task ever concatenates a whole table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.operators.ordered import ordered_scan
from tapewright.operators.pit import latest_per_group

HEX_PREFIX = 3  # 4096 buckets


def canonical(df: DataFrame, columns: Sequence[str]) -> Column:
    """One text per row: columns by name, decimals without trailing zeros, times in UTC, nulls marked."""
    parts = []
    types = {f.name: f.dataType for f in df.schema.fields}
    for name in sorted(columns):
        kind, col = types[name], F.col(name)
        if isinstance(kind, T.DecimalType) and kind.scale > 0:
            col = F.regexp_replace(F.regexp_replace(col.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        elif isinstance(kind, T.TimestampType):
            col = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        parts.append(F.concat(F.lit(f"{name}="), F.coalesce(col.cast("string"), F.lit("~"))))
    return F.concat_ws("|", *parts)


def row_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn("fingerprint", F.sha2(canonical(df, columns), 256))


def _fold(hashes: str) -> Column:
    return F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(hashes))), 256)


def series_fingerprint(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("series",)) -> DataFrame:
    """Per key, independent of row order; a key has at most one row per session."""
    return row_fingerprint(df, columns).groupBy(*keys).agg(_fold("fingerprint").alias("fingerprint"))


def whole_fingerprint(per_key: DataFrame) -> DataFrame:
    """One row from the fingerprints of all keys, through buckets by their leading digits."""
    bucket = F.substring("fingerprint", 1, HEX_PREFIX)
    level = per_key.groupBy(bucket.alias("_b")).agg(_fold("fingerprint").alias("fingerprint"))
    return level.agg(_fold("fingerprint").alias("fingerprint"))


def _chain():
    digest = ""

    def step(row_hash):
        nonlocal digest
        digest = hashlib.sha256((digest + row_hash).encode()).hexdigest()
        return (digest,)

    return step


def prefix_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per series and session, a digest of the history up to that day: each link hashes the one before."""
    rows = row_fingerprint(df, columns).select("series", "session", "fingerprint")
    return ordered_scan(rows, ["series"], ["session"], ["fingerprint"],
                        [T.StructField("prefix_fingerprint", T.StringType())], _chain)


# --- digests that combine -------------------------------------------------------------------------------------------
#: Hexadecimal digits of a row's hash in one of its numbers; four numbers a row.
SLICE = 15


def _slices(hashes: str) -> list[Column]:
    return [F.conv(F.substring(hashes, 1 + SLICE * i, SLICE), 16, 10).cast("decimal(20,0)") for i in range(4)]


def _digest(count: Column, sums: Sequence[Column]) -> Column:
    return F.sha2(F.concat_ws("|", count.cast("string"), *[s.cast("string") for s in sums]), 256)


def multiset_digest(rows: DataFrame, keys: Sequence[str] = (), hashes: str = "fingerprint") -> DataFrame:
    """Digest of a multiset of row hashes, per key or of all: hash of their number and of the sums of their four slices.

    Sums add up in any order, so partial sums do the work and no group is ever gathered, whatever its size.
    """
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[
        F.coalesce(F.sum(s), F.lit(0)).cast("decimal(38,0)").alias(f"_s{i}") for i, s in enumerate(_slices(hashes))])
    return sums.select(*keys, _digest(F.col("_n"), [F.col(f"_s{i}") for i in range(4)]).alias("digest"))


def prefix_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per series and session, the multiset digest of the rows up to that day, from running sums of one window."""
    rows = row_fingerprint(df, columns)
    upto = Window.partitionBy("series").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(s).over(upto).cast("decimal(38,0)") for s in _slices("fingerprint")]
    return rows.select("series", "session", _digest(F.count(F.lit(1)).over(upto), sums).alias("prefix_digest"))


def run_digest(config: str, data_rows: DataFrame, results: DataFrame) -> DataFrame:
    """One row from the configuration text and the digests of the rows of the data set and of all results."""
    both = multiset_digest(data_rows).crossJoin(multiset_digest(results, (), "result_fingerprint").withColumnRenamed("digest", "r"))  # one row each
    return both.select(F.sha2(F.concat_ws("|", F.lit(config), "digest", "r"), 256).alias("run_digest"))


def result_fingerprint(results: DataFrame, definition: str, columns: Sequence[str]) -> DataFrame:
    """Hash of one evaluated row under a named definition."""
    return results.withColumn("result_fingerprint", F.sha2(F.concat(F.lit(definition + "|"), canonical(results, columns)), 256))


def run_fingerprint(config: str, dataset: DataFrame, results: DataFrame) -> DataFrame:
    """One row from the configuration text, the data set's fingerprint and all result fingerprints."""
    whole = whole_fingerprint(results.select(F.col("result_fingerprint").alias("fingerprint")))
    both = dataset.select(F.col("fingerprint").alias("d")).crossJoin(whole.select(F.col("fingerprint").alias("r")))  # one row each
    return both.select(F.sha2(F.concat_ws("|", F.lit(config), "d", "r"), 256).alias("run_fingerprint"))


def run_drift(new_runs: DataFrame, log: DataFrame) -> DataFrame:
    """Compare each new run with the newest logged run of its experiment."""
    newest = latest_per_group(log.select("experiment", "run_id", "started_at", "sha256", "result_sha"), ["experiment"],
                              F.col("started_at"), F.col("run_id"))
    old = newest.select("experiment", F.col("sha256").alias("_d"), F.col("result_sha").alias("_r"), F.col("run_id").alias("reference_run"))
    rows = new_runs.join(old, "experiment", "left")
    drift = F.when(F.col("_d").isNull(), "NO_REFERENCE_RUN").when(F.col("sha256") != F.col("_d"), "DATASET_DRIFT").when(
        F.col("result_sha") != F.col("_r"), "ENGINE_OR_RESULT_DRIFT").otherwise("REPRODUCED")
    return rows.withColumn("drift", drift).drop("_d", "_r")


def append_run(log: DataFrame, runs: DataFrame) -> DataFrame:
    """`runs` with an outcome: APPENDED (the rows to write), ALREADY_LOGGED (the same run again, or once more in the batch) or
    RUN_ID_CONFLICT (the id is taken by another run). Logged rows are never changed."""
    facts = [c for c in ("experiment", "status", "started_at", "completed_at", "sha256", "result_sha") if c in runs.columns]
    held = log.select("run_id", F.struct(*facts).alias("_old")).groupBy("run_id").agg(F.min("_old").alias("_old"))
    first = runs.groupBy("run_id").agg(F.min(F.struct(*facts)).alias("_first"))
    order = Window.partitionBy("run_id", *facts).orderBy(F.lit(0))
    rows = runs.withColumn("_k", F.row_number().over(order)).join(held, "run_id", "left").join(first, "run_id").withColumn("_own", F.struct(*facts))
    known = F.col("_old").isNotNull()
    outcome = (
        F.when(known & F.col("_own").eqNullSafe(F.col("_old")), "ALREADY_LOGGED").when(known | ~F.col("_own").eqNullSafe(F.col("_first")), "RUN_ID_CONFLICT")
        .when(F.col("_k") > 1, "ALREADY_LOGGED").otherwise("APPENDED"))
    return rows.withColumn("outcome", outcome).drop("_k", "_old", "_first", "_own")


def run_page(log: DataFrame, experiment: str, page: int, page_size: int) -> DataFrame:
    return log.where(F.col("experiment") == experiment).orderBy(F.col("started_at").desc(), F.col("run_id").desc()).offset(
        (page - 1) * page_size).limit(page_size)


def dataset_counts(securities: DataFrame, bars: DataFrame, actions: DataFrame, memberships: DataFrame, calendar: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(securities, "securities")
    for df, name in ((bars, "price_rows"), (actions, "action_revisions"), (memberships, "membership_intervals"),
                     (calendar.where("is_trading_day"), "sessions")):
        out = out.crossJoin(n(df, name))  # one row each
    return out
