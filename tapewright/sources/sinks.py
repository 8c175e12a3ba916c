"""Append-only writing of accepted rows, and tables laid out for reading by series."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_inserts(merged: DataFrame, path: str, dry_run: bool = False, partition_by: str | None = None) -> DataFrame:
    """Append the INSERT rows of a merge; a dry run writes nothing and returns the same rows."""
    rows = merged.where("action = 'INSERT'").drop("action", "code")
    if not dry_run:
        writer = rows.write.mode("append")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return rows


def write_tape(bars: DataFrame, table: str, buckets: int) -> None:
    """Bars bucketed by series and sorted by session, so that features need no shuffle and no sort."""
    bars.write.mode("overwrite").format("parquet").bucketBy(buckets, "series").sortBy("series", "session").saveAsTable(table)
