"""Ranks, strides, top-k and best-of-group without putting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def positions(df: DataFrame, keys: list[str], order: list[str], bucket: Column,
              name: str = "seq", total: str | None = None) -> DataFrame:
    """Exact zero-based rank of every row inside its group.

    ``bucket`` must be non-decreasing along ``order``. Ranking runs inside
    (group, bucket) and is shifted by the row counts of earlier buckets, so a group
    holding a third of the data is spread over its buckets.
    """
    slots = df.withColumn("_bucket", bucket)
    counts = slots.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)))
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = slots.withColumn("_local", F.row_number().over(local) - 1)
    # Merged: bucket counts grow with the rows and would go through the driver.
    return (ranked.join(offsets.drop("_n").hint("merge"), [*keys, "_bucket"])
            .withColumn(name, (F.col("_before") + F.col("_local")).cast("long"))
            .drop("_bucket", "_local", "_before"))


def stride(df: DataFrame, seq: str, step: int) -> DataFrame:
    """Every ``step``-th row by position, never by identifier."""
    return df.filter(F.col(seq) % step == 0)


def even_sample(df: DataFrame, seq: str, total: str, limit: int) -> DataFrame:
    """Evenly spaced rows: step is the whole quotient, then the first ``limit`` of them."""
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col(total) / limit))
    return df.filter((F.col(seq) % step == 0) & (F.floor(F.col(seq) / step) < limit))


def stride_above(df: DataFrame, seq: str, total: str, maximum: int) -> DataFrame:
    """All rows up to ``maximum``; above it every ceil(n / maximum)-th row."""
    step = F.when(F.col(total) > maximum, F.ceil(F.col(total) / maximum)).otherwise(F.lit(1).cast("long"))
    return df.filter(F.col(seq) % step == 0)


def best_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each group under a total order.

    Written as a top-1 window: Spark keeps one row per group before the shuffle.
    """
    return top_per_group(df, keys, order, 1)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                  rank: str | None = None) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= k)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")


def neighbours(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "next_id") -> DataFrame:
    """Pairs (i, i+1) along an order inside groups bounded by configuration."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.lead(value).over(window)).filter(F.col(name).isNotNull())


def next_by_position(df: DataFrame, keys: list[str], seq: str, value: str, name: str = "next_id") -> DataFrame:
    """Pairs (i, i+1) joined on a dense position, so no group is sorted in one task."""
    following = df.select(*keys, (F.col(seq) - 1).alias(seq), F.col(value).alias(name))
    return df.join(following, [*keys, seq])
