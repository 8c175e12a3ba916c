"""Exact ranks and percentiles of groups of any size.

A window or `percentile()` over a whole group would put a hot group into one task. Here equal values are first
counted (combined before the shuffle), then ranked in two levels: bucket totals per group, and values inside a
bucket. A bucket spans a fixed width of the integer value, which bounds the distinct values in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.numbers import whole_div

BUCKET_WIDTH = 10_000


def value_counts(df: DataFrame, keys: Sequence[str], value: Column, width: int = BUCKET_WIDTH) -> DataFrame:
    """(keys, b, v, n): how often each integer value occurs."""
    v = value.cast("bigint")
    return df.select(*keys, v.alias("v")).where(F.col("v").isNotNull()).withColumn(
        "b", F.floor(F.col("v") / F.lit(float(width)))).groupBy(*keys, "b", "v").agg(F.count(F.lit(1)).alias("n"))


def bucket_offsets(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, b, before, total): rows in smaller buckets, and in the group."""
    totals = counts.groupBy(*keys, "b").agg(F.sum("n").alias("bn"))
    w = Window.partitionBy(*keys)
    return totals.select(
        *keys, "b", "bn", (F.sum("bn").over(w.orderBy("b")) - F.col("bn")).alias("before"),
        F.sum("bn").over(w).alias("total"))


def cume_dist(df: DataFrame, keys: Sequence[str], value: Column, width: int = BUCKET_WIDTH) -> DataFrame:
    """(keys, v, at_or_below, total) for every distinct value of a group."""
    counts = value_counts(df, keys, value, width)
    placed = counts.join(bucket_offsets(counts, keys), [*keys, "b"])
    inside = Window.partitionBy(*keys, "b").orderBy("v")
    return placed.select(
        *keys, "v", (F.col("before") + F.sum("n").over(inside)).alias("at_or_below"), "total")


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: Column, hundredths: Sequence[int], width: int = BUCKET_WIDTH,
) -> DataFrame:
    """One row per group with `p05`-like bigint columns: linear interpolation at p(n-1), halves away from zero."""
    counts = value_counts(df, keys, value, width)
    offsets = bucket_offsets(counts, keys)
    p = F.col("p")
    position = p * (F.col("total") - 1)
    low = whole_div(position, F.lit(100))
    targets = F.explode(F.array(*[F.lit(h).cast("bigint") for h in hundredths])).alias("p")
    wanted = (
        offsets.select(*keys, "b", "before", "bn", "total", targets)
        .withColumns({"lo": low, "frac": position % 100})
        .withColumn("hi", F.least(F.col("lo") + 1, F.col("total") - 1))
        .withColumn("rank", F.explode(F.array("lo", "hi")))
        .where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("bn")))
        .select(*keys, "b", "before", "p", "frac", "rank", "lo").distinct()
    )
    inside = Window.partitionBy(*keys, "b").orderBy("v")
    near = counts.join(wanted.select(*keys, "b").distinct(), [*keys, "b"], "left_semi").withColumn(
        "upto", F.sum("n").over(inside))
    hit = wanted.join(near, [*keys, "b"]).where(
        (F.col("rank") < F.col("before") + F.col("upto"))
        & (F.col("rank") >= F.col("before") + F.col("upto") - F.col("n")))
    pair = hit.groupBy(*keys, "p", "frac").agg(
        F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("z"))
    scaled = F.col("a") * 100 + (F.col("z") - F.col("a")) * F.col("frac")
    found = F.signum(scaled).cast("bigint") * whole_div(F.abs(scaled) + 50, F.lit(100))
    picked = pair.withColumn("found", found)
    return picked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("p") == h, F.col("found"))).alias(f"p{h:02d}") for h in hundredths])
