"""Small DataFrame helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % modulus


#: Rows and bytes of an Arrow batch at most: a task holds one in the JVM and one in Python, in and out.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to what texts need, where they are higher."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text as bytes, nothing else, whatever other columns there are."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def bounded_sample(labels: DataFrame, id_col: str, target_col: str, limit: int) -> DataFrame:
    """At most `limit` labelled ids, those with the smallest hashes: the same rows on every run and partitioning.

    `limit` is the proven bound of what may be broadcast to fetch the texts.
    """
    return (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(target_col).cast("int").alias("target"))
        .where(F.col("target").isin(0, 1) & F.col("doc_id").isNotNull())
        .orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id", "target")
        .limit(limit))
