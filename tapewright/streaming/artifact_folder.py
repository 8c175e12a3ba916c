"""Folder of price batches as a stream: each micro-batch is merged once, whatever is delivered again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapewright.operators.merge import merge_prices
from tapewright.sources.sinks import append_inserts


def merge_batch(spark: SparkSession, batch: DataFrame, tape_path: str, calendar: DataFrame, issues_path: str) -> DataFrame:
    """Compare a batch with the tape, append what is new and record every other row's outcome in the issue table.

    Running it again inserts nothing. Only the part of the tape on the batch's dates is compared.
    """
    tape = spark.read.parquet(tape_path)
    stored = tape.join(batch.select("session").distinct(), "session", "left_semi").select(*tape.columns)
    merged = merge_prices(batch, stored, calendar).persist()
    # Before the append: writing to the tape makes Spark read it, and so judge the batch, anew.
    merged.where("action <> 'INSERT'").write.mode("append").parquet(issues_path)
    append_inserts(merged.withColumn("origin", F.lit("OFFICIAL")).select(*tape.columns, "action", "code"), tape_path)
    return merged


def follow_folder(
    spark: SparkSession, folder: str, schema, tape_path: str, calendar: DataFrame, checkpoint: str, issues_path: str) -> StreamingQuery:
    """Process every file not yet seen, then stop (`availableNow`); the checkpoint folder remembers files."""
    stream = spark.readStream.schema(schema).parquet(folder)

    def step(batch: DataFrame, _: int) -> None:
        merge_batch(batch.sparkSession, batch, tape_path, calendar, issues_path).unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
