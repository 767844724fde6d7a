"""Hard-negative mining with segment summaries.

A vector is cut into segments of which only the mean and the deviation are kept. The inner product of two vectors is at
most the sum, over segments, of length x (product of means + product of deviations), and at least the same with
a minus. Rows that these bounds keep out of an anchor's window, or below what it has already found, are never scored;
the others are bounded again by shorter segments, and what is left is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from roomfold.llm import vectors
from roomfold.llm.stages import stage
from roomfold.operators.ordering import positions
from roomfold.session import stage_path

#: Components beyond this would overflow an inner product of 64-bit integers.
LIMIT = 1 << 27
#: Stands for a null id inside the kernels: behind all others.
NO_ID = np.iinfo(np.int64).max
NOTHING = -np.iinfo(np.int64).max


@dataclass(frozen=True)
class Settings:
    scale: float = 256.0
    positives: int = 5
    negatives: int = 10
    #: A negative's score lies between these hundredths of the positive's.
    low: int = 30
    high: int = 90
    #: Numbers of segments, from coarse to fine; each divides the next.
    levels: tuple[int, ...] = (4, 16, 32)
    #: Anchors that are searched for at once; they pass the driver and are broadcast.
    block: int = 10_000


@dataclass
class Summary:
    """Means and deviations of the segments of many vectors, both times the root of the segment's length."""

    mean: list[np.ndarray]
    deviation: list[np.ndarray]
    norm: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, levels: tuple[int, ...]) -> "Summary":
        parts = [x.reshape(len(x), n, -1).astype(np.float64) for n in levels]
        root = [np.sqrt(p.shape[2]) for p in parts]
        return cls([p.mean(2) * r for p, r in zip(parts, root)], [p.std(2) * r for p, r in zip(parts, root)],
                   np.sqrt((x.astype(np.float64) ** 2).sum(1)))

    def stored(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.mean, 1), np.concatenate(self.deviation, 1)

    @classmethod
    def read(cls, mean: np.ndarray, deviation: np.ndarray, norm: np.ndarray, levels: tuple[int, ...]) -> "Summary":
        cuts = np.cumsum(levels)[:-1]
        return cls(np.split(mean, cuts, 1), np.split(deviation, cuts, 1), norm)


def prepared(df: DataFrame, key: str, vector: str, label: Column, settings: Settings) -> tuple[DataFrame, int]:
    """``id``, ``label``, integer vector ``x`` and its segment summaries, of the rows that take part; the common width.

    Vectors are filled up with zeros to one width, a multiple of the finest number of segments.
    """
    rows = df.select(F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).alias("v")).where(
        F.col("v").isNotNull() & F.col("label").isNotNull())
    finest = settings.levels[-1]
    width = -(-max(rows.agg(F.max(F.size("v"))).head()[0] or 0, 1) // finest) * finest
    levels, scale = settings.levels, settings.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = vectors.ragged(batch.column(2), width)
            good = np.isfinite(values).all(1)
            x = vectors.whole(values[good], scale, LIMIT)
            mean, deviation = Summary.of(x, levels).stored()
            kept = pa.array(good)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(kept), batch.column(1).filter(kept), vectors.lists(x.astype(np.int32), pa.int32()),
                 vectors.lists(mean.astype(np.float32), pa.float32()), vectors.lists(deviation.astype(np.float32), pa.float32())],
                names=["id", "label", "x", "mean", "deviation"])

    return stage(rows.mapInArrow(run, "id bigint, label bigint, x array<int>, mean array<float>, deviation array<float>")), width


@dataclass
class Questions:
    """A block of anchors, and what is asked for them: question q is about anchor ``anchor[q]``.

    Wanted are the first rows by score, then id, whose label is (``same``) or isn't that of the anchor, whose id isn't the
    anchor's and whose score lies from ``low`` to ``high``; from ``least`` on is enough, as so many are known above.
    """

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int
    least: np.ndarray | None = None


def exact(x: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Integer inner products; through doubles where these are exact."""
    if len(x) and float(np.abs(x).max(initial=0)) * float(np.abs(one).max(initial=0)) * x.shape[1] < 2.0**53:
        return (x.astype(np.float64) @ one.astype(np.float64)).astype(np.int64)
    return (x.astype(np.int64) * one.astype(np.int64)).sum(1)


class Search:
    """The best rows of each question among all batches seen; it never holds more than ``k`` rows a question."""

    def __init__(self, asked: Questions, levels: tuple[int, ...]):
        self.asked, self.levels = asked, levels
        self.summary = Summary.of(asked.x, levels)
        n = len(asked.anchor)
        self.scores = np.full((n, asked.k), NOTHING, np.int64)
        self.ids = np.full((n, asked.k), NO_ID, np.int64)
        order = np.argsort(asked.anchor, kind="stable")
        cuts = np.searchsorted(asked.anchor[order], np.arange(len(asked.ids) + 1))
        self.of = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        self.least = asked.low if asked.least is None else np.maximum(asked.low, asked.least)
        self.bounded = self.scored = 0

    def see(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, summary: Summary) -> None:
        asked = self.asked
        order = np.argsort(labels, kind="stable")
        ids, labels, x = ids[order], labels[order], x[order]
        means, deviations = [m[order] for m in summary.mean], [d[order] for d in summary.deviation]
        longest = summary.norm.max(initial=0.0)
        for j in range(len(asked.ids)):
            mine = self.of[j]
            if not len(mine):
                continue
            slack = 1e-5 * longest * self.summary.norm[j] + 1e-6  # summaries are stored in 32 bits
            low = int(self.least[mine].min())
            high = int(asked.high[mine].max())
            a, b = np.searchsorted(labels, asked.labels[j], "left"), np.searchsorted(labels, asked.labels[j], "right")
            rows = np.arange(a, b) if asked.same else np.concatenate([np.arange(a), np.arange(b, len(ids))])
            self.bounded += len(rows)
            for level in range(len(self.levels)):
                if not len(rows):
                    break
                whole = len(rows) == len(ids)
                middle = (means[level] if whole else means[level][rows]) @ self.summary.mean[level][j]
                spread = (deviations[level] if whole else deviations[level][rows]) @ self.summary.deviation[level][j] + slack
                rows = rows[(middle + spread >= low) & (middle - spread <= high)]
            rows = rows[ids[rows] != asked.ids[j]]
            if len(rows):
                self.scored += len(rows)
                self._take(mine, ids[rows], exact(x[rows], asked.x[j]))

    def _take(self, mine: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        k = self.asked.k
        for q in mine:
            fits = (scores >= self.least[q]) & (scores <= self.asked.high[q])
            if not fits.any():
                continue
            s, i = np.concatenate([self.scores[q], scores[fits]]), np.concatenate([self.ids[q], ids[fits]])
            if len(s) > 4 * k:  # the k-th score decides what has to be sorted
                edge = np.partition(s, len(s) - k)[len(s) - k]
                s, i = s[s >= edge], i[s >= edge]
            order = np.lexsort((i, -s))
            s, i = s[order], i[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])  # a row that repeats counts once
            s, i = s[new][:k], i[new][:k]
            self.scores[q, :len(s)], self.ids[q, :len(s)] = s, i
            if len(s) == k and s[-1] > self.least[q]:
                self.least[q] = s[-1]

    def found(self) -> pa.RecordBatch:
        q, at = np.nonzero(self.scores > NOTHING)
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(self.ids[q, at]), pa.array(self.scores[q, at])],
                                          names=["question", "id", "score"])


def answers(rows: DataFrame, asked: Questions, width: int, settings: Settings) -> DataFrame:
    """``question``, ``rank`` (from 1), ``id`` and ``score`` of the first ``k`` rows of every question.

    A task keeps its best ``k`` rows a question and returns them when its rows are through; the best of these are the answer.
    """
    shared = rows.sparkSession.sparkContext.broadcast(asked)
    levels = settings.levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value, levels)
        for batch in batches:
            x = vectors.fixed(batch.column(2), width)
            norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
            summary = Summary.read(vectors.fixed(batch.column(3), sum(levels)), vectors.fixed(batch.column(4), sum(levels)), norm, levels)
            search.see(batch.column(0).fill_null(NO_ID).to_numpy(), batch.column(1).to_numpy(), x, summary)
        yield search.found()

    best = rows.mapInArrow(run, "question int, id bigint, score bigint")
    order = Window.partitionBy("question").orderBy(F.col("score").desc(), "id")
    # rows that repeat share a rank and are one answer
    return best.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= asked.k).dropDuplicates(["question", "rank"])


def _least(found: DataFrame, asked: Questions) -> np.ndarray:
    """The score of each question's k-th answer, where it has so many."""
    last = found.where(F.col("rank") == asked.k).select("question", "score").toArrow()
    out = np.full(len(asked.anchor), NOTHING, np.int64)
    out[last["question"].to_numpy()] = last["score"].to_numpy()
    return out


def mine(df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | None = None,
         settings: Settings = Settings()) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    An anchor's positives are the first rows of its label, its negatives the first rows of other labels whose score lies
    from ``low`` to ``high`` hundredths of the positive's; first means by score, then by id. Rows with a null label, a null
    vector or a null or non-finite component take no part. Components are floor(scale * x), held within plus or minus
    2**27; vectors of different widths are compared as if the shorter went on with zeros. A null id comes after all
    others and is never an anchor. Anchors equal in id, label and vector ask once, a row with the anchor's
    own id is never its positive or negative, and rows of one id and one score count once. Anchors without a positive
    or a negative in the window give no rows; so does an empty table. Other columns than the named ones are not looked at.

    Anchors pass the driver in blocks, each searched for in one pass over all rows. What the anchors themselves hold of
    good rows sets a first bound, so a task returns few rows, and never more than ``k`` a question.
    """
    spark = df.sparkSession
    rows, width = prepared(df, key, vector, F.col("label") if label is None else label, settings)
    anchors = stage(rows.where(is_anchor))
    hashed = anchors.select("id", "label", "x").distinct().withColumn("_h", F.xxhash64("id", "label", "x"))
    numbered = stage(positions(hashed, [], ["_h", "id", "label", "x"], F.shiftright("_h", 56), "n"))
    path = stage_path(spark, "negatives")
    kind = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], kind).write.parquet(path)
    for first in range(0, numbered.count(), settings.block):
        block = numbered.where((F.col("n") >= first) & (F.col("n") < first + settings.block)).select("id", "label", "x").toArrow().combine_chunks()
        ids, labels = block["id"].to_numpy(), block["label"].to_numpy()
        x = vectors.fixed(block["x"].combine_chunks(), width)
        n = len(ids)
        near = Questions(ids, labels, x, np.arange(n), np.full(n, NOTHING), np.full(n, -NOTHING), True, settings.positives)
        near.least = _least(answers(anchors, near, width, settings), near)
        positive = answers(rows, near, width, settings).select("question", "id", "score").toArrow()
        anchor, score = positive["question"].to_numpy(), positive["score"].to_numpy()
        far = Questions(ids, labels, x, anchor, -((-settings.low * score) // 100), settings.high * score // 100, False, settings.negatives)
        far.least = _least(answers(anchors, far, width, settings), far)
        names = pa.table({"question": pa.array(np.arange(len(anchor)), pa.int32()), "anchor_id": pa.array(ids[anchor]),
                          "positive_id": positive["id"], "positive_score": positive["score"]})
        # at most block x positives rows
        out = answers(rows, far, width, settings).join(F.broadcast(spark.createDataFrame(names)), "question")
        known = lambda c: F.when(F.col(c) != F.lit(int(NO_ID)), F.col(c))
        out.select("anchor_id", known("positive_id").alias("positive_id"), "rank", known("id").alias("negative_id"), "positive_score",
                   F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path)
