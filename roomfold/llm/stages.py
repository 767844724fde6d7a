"""Stage tables in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roomfold.session import cut


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back; lost executors cost no earlier work."""
    return cut(df)


def likely_in(df: DataFrame, key: Column, wanted: DataFrame, bits: int = 24) -> DataFrame:
    """Rows of ``df`` whose key may be in the one column of ``wanted``: all that are, and few others.

    The wanted keys set bits of a hash table of ``2 ** bits`` bits, whose words (at most ``2 ** (bits - 6)`` rows, 4 MB
    by default, however many keys there are) are broadcast. It only saves shuffling rows that a later join would drop.
    """
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(1 << bits))
    marks = wanted.select(place(wanted[wanted.columns[0]]).alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_at % 64 as int))")).alias("_bits"))
    placed = df.withColumn("_at", place(key))
    hit = (F.shiftright(placed["_at"], 6) == marks["_word"]) & (F.expr("shiftleft(1L, cast(_at % 64 as int))").bitwiseAND(marks["_bits"]) != 0)
    return placed.join(F.broadcast(marks), hit, "left_semi").drop("_at")
