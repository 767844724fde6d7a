"""Exact quantiles, medians and MADs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def percentile(value: Column, q: float) -> Column:
    """Exact linear-interpolated quantile for groups of bounded distinct values."""
    return F.percentile(value, F.lit(q))


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                       width: float) -> DataFrame:
    """Exact interpolated quantiles of groups of any size.

    Equal values are counted before any shuffle on the group. Running counts are then
    taken over value buckets of ``width`` and, inside the buckets, over distinct
    values; only bucket totals are ever ordered per group.
    """
    source = df.filter(F.col(value).isNotNull())
    counted = source.groupBy(*keys, value).agg(F.count("*").alias("_n")) \
        .withColumn("_bucket", F.floor(F.col(value) / width))
    totals = counted.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_bn"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (totals.withColumn("_before", F.coalesce(F.sum("_bn").over(earlier), F.lit(0)))
              .withColumn("_total", F.sum("_bn").over(Window.partitionBy(*keys))))
    # Keep only the buckets that hold a wanted rank before touching their values.
    ranks = []
    for q in probs.values():
        spot = F.lit(q) * (F.col("_total") - 1)
        ranks += [F.floor(spot), F.ceil(spot)]
    wanted = None
    for rank in ranks:
        inside = (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_bn"))
        wanted = inside if wanted is None else wanted | inside
    hit = totals.filter(wanted).drop("_bn")
    local = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = (counted.join(hit, [*keys, "_bucket"])
              .withColumn("_lo", F.col("_before") + F.coalesce(F.sum("_n").over(local), F.lit(0)))
              .withColumn("_hi", F.col("_lo") + F.col("_n")))
    aggs = [F.first("_total").alias("n")]
    for name, q in probs.items():
        spot = F.lit(q) * (F.col("_total") - 1)
        low, high = F.floor(spot), F.ceil(spot)
        pick = lambda rank: F.max(F.when((rank >= F.col("_lo")) & (rank < F.col("_hi")), F.col(value)))
        aggs += [pick(low).alias(f"_{name}_a"), pick(high).alias(f"_{name}_b"),
                 F.first(spot - low).alias(f"_{name}_f")]
    out = placed.groupBy(*keys).agg(*aggs)
    for name in probs:
        a, b, f = (F.col(f"_{name}_{part}") for part in "abf")
        out = out.withColumn(name, a + (b - a) * f)
    return out.select(*keys, "n", *probs)


def median_mad(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """Median and median absolute deviation of groups of any size."""
    med = weighted_quantiles(df, keys, value, {"median": 0.5}, width)
    # Deviations are taken on distinct values, weighted by how often they occur.
    joined = df.select(*keys, value).join(med.select(*keys, "median"), keys) \
        .withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    mad = weighted_quantiles(joined, keys, "_dev", {"mad": 0.5}, width).select(*keys, "mad")
    return med.join(mad, keys)


def median_mad_bounded(df: DataFrame, keys: list[str], value: str, prefix: str = "") -> DataFrame:
    """Same measures for groups whose size configuration bounds (views of one opening)."""
    med = df.groupBy(*keys).agg(F.median(value).alias("_med"))
    joined = df.join(med, keys)
    return joined.groupBy(*keys).agg(
        F.first("_med").alias(f"{prefix}median"),
        F.median(F.abs(F.col(value) - F.col("_med"))).alias(f"{prefix}mad"))
