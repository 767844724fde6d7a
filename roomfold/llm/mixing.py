"""Mixing sources to target weights: random order, prefix sums of tokens, a cut at each source's budget."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from roomfold.llm.stages import stage
from roomfold.operators.ordering import positions

#: Fixed value of the contract: what a word is.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    #: Weights of the sources in order of their names, repeating.
    weights: Sequence[float] = (1, 2, 3)
    #: Words of the mix as a share of all words.
    share: float = 1.0
    #: How often a source may be gone through.
    epochs: int = 3
    seed: str = "1"
    #: Rows that one slice of a source holds on average at most.
    slice_rows: int = 50_000


def random_key(source: Column, key: Column, text: Column, seed: str) -> Column:
    """Hash-random key of a row; only rows equal in source, id and text share it."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(seed), part(source), part(key), part(text)))


def targets(sizes: DataFrame, settings: Settings) -> DataFrame:
    """``target`` words of every source from (``source``, ``source_size``), one row per source.

    Weights go by the order of the names, null last. A source gets at most ``epochs`` times its size; what is over goes to
    the others by weight, until none is above. That is a common level of words per weight: sources whose limit per
    weight lies below it stop at their limit. In order of that limit, a source stops exactly if its limit does not exceed
    the level that the sources from it on would share.
    """
    weights = F.array(*[F.lit(float(w)) for w in settings.weights])
    every = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("_n", F.row_number().over(every) - 1).withColumn(
        "weight", F.get(weights, F.col("_n") % len(settings.weights))).withColumn(
        "_limit", (F.lit(settings.epochs) * F.col("source_size")).cast("double"))
    by_limit = Window.orderBy(F.col("_limit") / F.col("weight"), "_n")
    before, whole = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumns({
        "_all": F.sum("source_size").over(whole) * F.lit(settings.share), "_weights": F.sum("weight").over(whole),
        "_spent": F.coalesce(F.sum("_limit").over(before), F.lit(0.0)),
        "_gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    stops = F.col("_limit") * (F.col("_weights") - F.col("_gone")) <= (F.col("_all") - F.col("_spent")) * F.col("weight")
    rows = rows.withColumn("_stops", stops)
    spent = F.coalesce(F.sum(F.when(F.col("_stops"), F.col("_limit"))).over(whole), F.lit(0.0))
    left = F.coalesce(F.sum(F.when(~F.col("_stops"), F.col("weight"))).over(whole), F.lit(0.0))
    level = (F.col("_all") - spent) / F.when(left > 0, left)
    return rows.select("source", "source_size", "weight", F.when(F.col("_stops"), F.col("_limit")).otherwise(
        F.least("_limit", level * F.col("weight"))).alias("target"))


def starts(slim: DataFrame, rows: int, settings: Settings) -> DataFrame:
    """Words before each key in the order of its source: one row per source and key, with the ``_words`` of its rows.

    Equal keys are added up first. The rest is sorted in ranges of the key, whose totals shift the running sums.
    """
    digits = 1
    while rows > settings.slice_rows * 16**digits and digits < 6:
        digits += 1
    keys = slim.groupBy("source", "_key").agg(F.sum("size").alias("_words")).withColumn(
        "_slice", F.conv(F.substring("_key", 1, digits), 16, 10).cast("int"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = keys.groupBy("source", "_slice").agg(F.sum("_words").alias("_n")).withColumn(
        "_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("source", "_slice").orderBy("_key")
    sums = keys.withColumn("_inside", F.sum("_words").over(inside) - F.col("_words")).alias("k").join(
        slices.alias("s"), F.col("k.source").eqNullSafe(F.col("s.source")) & (F.col("k._slice") == F.col("s._slice")))
    return sums.select("k.source", "k._key", "k._words", (F.col("k._inside") + F.col("s._shift")).alias("_start"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", settings: Settings = Settings()) -> DataFrame:
    """``id``, ``source``, ``size``, ``source_size``, ``weight``, ``target`` and ``taken`` words of every row.

    The rows of a source are put in the order of a hash of id and text and gone through whole as often as the budget
    allows; what is left of it ends inside one row, of which only the first words are taken. So the words taken of a
    source add up to its rounded target, and no row gives more than ``epochs`` times its words.

    A source is sorted in ranges of the hash: no task holds a source, however many rows it has. Rows equal in source,
    id and text share a hash and are added up before anything is shuffled; only if the budget ends among them
    are they numbered, by the partition that read them. They are all the same, so reruns agree.
    A null text has size 0, a null source is a source of its own (the last), ids may be null or repeat, long texts are
    hashed and counted whole where they are read, and an empty table gives an empty result. Texts are never shuffled;
    other columns are not looked at. One row per source is looked at in one task for the targets.
    """
    slim = stage(docs.select(
        F.col(key).alias("id"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        random_key(F.col(source), F.col(key), F.col(text), settings.seed).alias("_key"), F.monotonically_increasing_id().alias("_row")))
    plan = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), settings)
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("_whole", F.least(whole, F.lit(settings.epochs))).withColumn(
        "_rest", budget - F.col("_whole") * F.col("source_size"))
    at = starts(slim, slim.count(), settings).alias("a").join(plan.alias("p"), F.col("a.source").eqNullSafe(F.col("p.source"))).select(
        F.col("a.source").alias("_source"), F.col("a._key").alias("_at"), "a._words", "a._start", "source_size", "weight", "target", "_whole", "_rest")
    rows = stage(slim.join(at, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_key") == F.col("_at"))).drop("_source", "_at", "_key"))
    ends_here = (F.col("_start") < F.col("_rest")) & (F.col("_rest") < F.col("_start") + F.col("_words"))
    cut = positions(rows.where(ends_here).withColumn("_name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))), ["_name"], ["_row"],
                    F.shiftright("_row", 33), "_copy").drop("_name")
    left = F.col("_rest") - F.col("_start") - F.col("_copy") * F.col("size")
    part = F.when(F.col("_start") >= F.col("_rest"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("size"), left)))
    every = rows.where(~ends_here).withColumn("_copy", F.lit(0).cast("long")).unionByName(cut)
    return every.select("id", "source", "size", "source_size", "weight", "target", (F.col("_whole") * F.col("size") + part).cast("long").alias("taken"))


def texts(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix itself: ``id``, ``copy`` and ``text``, one row per use of a text, from documents with unique ids.

    The last use may be a part: its first words, joined by one space. Rows that give nothing are not in it.
    """
    uses = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(mixed.select("id", "size", "taken").where("taken > 0"), "id")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    over = (F.col("taken") % F.col("size")).cast("int")
    uses = uses.withColumn("copy", F.explode(F.sequence(F.lit(1), whole + F.when(over > 0, 1).otherwise(0))))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.greatest(over, F.lit(1))), " ")
    return uses.select("id", "copy", F.when(F.col("copy") <= whole, F.col("text")).otherwise(first).alias("text"))
