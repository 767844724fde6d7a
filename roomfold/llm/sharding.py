"""Shards by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from roomfold.operators.ordering import positions


def _candidates(key: Column, first: int, weights: Sequence[float]) -> Column:
    """(score, shard) of every shard: -weight / ln(u) for a uniform u drawn from the key and the shard alone."""

    def candidate(i: Column) -> Column:
        shard = i + first
        uniform = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) * F.lit(2.0**-53)
        weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), i)
        # equal scores: the smaller shard
        return F.struct((-weight / F.log(uniform)).alias("score"), (-shard).alias("back"))

    if len(set(weights)) == 1:
        def candidate(i: Column) -> Column:  # noqa: F811 - the same order without a logarithm
            shard = i + first
            return F.struct(F.shiftrightunsigned(F.xxhash64(key, shard), 11).alias("score"), (-shard).alias("back"))

    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), candidate))


def place(key: Column, weights: Sequence[float]) -> Column:
    """Shard of a key. A shard takes a share of the keys in proportion to its weight.

    The score of a shard depends on nothing but the key and that shard, so adding a shard only moves
    keys into it and removing one only moves its own keys. Keys are hashed as text; null is a key too.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return (-_candidates(F.coalesce(key.cast("string"), F.lit("")), 0, weights)["back"]).cast("int")


def shards(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 40,
           grown_weight: float = 1.0, slice_bits: int = 6) -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard`` of every row.

    ``grown_shard`` is the shard after one more shard of weight ``grown_weight`` is added. ``size`` is the
    UTF-8 length of the text (null: 0) plus 16. Slots number the rows of a shard from 0 without gaps in
    the order of a hash of the key; each shard is ranked in 2**slice_bits ranges of that hash, which are then
    shifted by the counts before them, so no task holds a shard. Rows that repeat a key share its shard
    and get slots of their own. Texts are never shuffled; other columns are not looked at.
    """
    if grown_weight <= 0:
        raise ValueError("weights must be positive")
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        place(F.col(key), weights).alias("shard"),
        place(F.col(key), [*weights, grown_weight]).alias("grown_shard"), F.shiftrightunsigned(F.xxhash64(name), 1).alias("_order"))
    slice_of = F.shiftright("_order", 63 - slice_bits)
    ranked = positions(rows, ["shard"], ["_order", "id", "text_crc32", "size"], slice_of, "slot")
    return ranked.drop("_order")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 40) -> None:
    """Write whole rows into one folder per shard (``_shard=N``); nothing is shuffled."""
    docs.withColumn("_shard", place(F.col(key), weights)).write.partitionBy("_shard").parquet(path)
