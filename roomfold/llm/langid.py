"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from roomfold.llm.arrow import CHUNK_CHARS, id_remainder, map_chunks
from roomfold.llm.stages import stage

UNDETERMINED = "und"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    smoothing: float = 0.5
    #: Bounds the model (languages x 2**bits x 8 bytes); more labels than this are an error, not a cut.
    max_languages: int = 256

    @property
    def buckets(self) -> int:
        return 1 << self.bits


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray  # languages x buckets, log probabilities
    settings: Settings


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _runs(texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Code points of whole texts: lower case, every run of other characters than letters one space.

    Groups many short texts; a very long text comes in several pieces that overlap by the longest n-gram.
    """
    letters = _letters()
    owners: list[int] = []
    arrays: list[np.ndarray] = []
    held = 0
    for i, text in enumerate(texts):
        lowered = (text or "").lower()
        for at in range(0, len(lowered), CHUNK_CHARS):
            points = np.frombuffer(lowered[max(0, at - 2):at + CHUNK_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
            solid = letters[points]
            points = np.where(solid, points, np.uint32(32))
            keep = solid | np.concatenate(([True], solid[:-1]))
            points = points[keep]
            owners.append(i)
            arrays.append(points)
            held += len(points)
            if held >= CHUNK_CHARS:
                yield owners, arrays
                owners, arrays, held = [], [], 0
    if owners:
        yield owners, arrays


def _ngrams(arrays: list[np.ndarray], settings: Settings) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each piece begins, and for each order the bucket of the n-gram at every position.

    A piece is followed by as many spaces as keep its n-grams inside it.
    """
    gap = np.full(max(settings.orders), 32, np.uint64)
    points = np.concatenate([x for a in arrays for x in (gap[:1], a, gap)]).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum([len(a) + len(gap) + 1 for a in arrays])[:-1]))
    found, code = [], points
    shift = np.uint64(64 - settings.bits)
    for n in range(1, max(settings.orders) + 1):
        if n > 1:
            code = code[:-1] * np.uint64(0x110001) + points[n - 1:]
        if n in settings.orders:
            found.append(((code + np.uint64(n)) * _MULTIPLIER >> shift).astype(np.int64))
    return starts, found


def train(df: DataFrame, text: str, label: str, settings: Settings = Settings()) -> Model:
    """Count n-grams of all rows with a text and a label; the counts, not the rows, reach the driver.

    Each task adds up one dense row of counts per label. Raises above ``max_languages`` labels.
    Without any labelled row the model knows no language and predicts ``und``.
    """
    rows = df.select(F.col(text).alias("text"), F.col(label).alias("label")).where("text is not null and label is not null")

    def count(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        totals: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        for part in parts:
            labels = part["label"]
            for name in labels:
                documents[name] = documents.get(name, 0) + 1
                if name not in totals:
                    totals[name] = np.zeros(settings.buckets, np.int64)
                    if len(totals) > settings.max_languages:
                        raise ValueError("more labels than max_languages")
            for owners, arrays in _runs(part["text"]):
                order = sorted(range(len(owners)), key=lambda j: labels[owners[j]])
                starts, found = _ngrams([arrays[j] for j in order], settings)
                names = [labels[owners[j]] for j in order]
                for name in sorted(set(names)):
                    lo, hi = bisect_left(names, name), bisect_right(names, name)
                    end = starts[hi] if hi < len(names) else None
                    for bucket in found:
                        totals[name] += np.bincount(bucket[starts[lo]:end], minlength=settings.buckets)
        for n, row in totals.items():
            used = np.flatnonzero(row)
            yield {"label": [n], "documents": [documents[n]], "bucket": [used.tolist()], "n": [row[used].tolist()]}

    counted = map_chunks(rows, "text", "label string, documents long, bucket array<int>, n array<long>", count)
    counted = stage(counted)
    found = {r.label: r.documents for r in counted.groupBy("label").agg(F.sum("documents").alias("documents"))
             .orderBy("label").limit(settings.max_languages + 1).collect()}
    if len(found) > settings.max_languages:
        raise ValueError("more labels than max_languages")
    languages = sorted(found)
    matrix = np.zeros((settings.buckets, len(languages)))
    # bounded: at most max_languages x buckets sums
    sums = counted.select("label", F.explode(F.arrays_zip("bucket", "n")).alias("x")).groupBy("label", "x.bucket").agg(
        F.sum("x.n").alias("n")).toArrow()
    column = {n: i for i, n in enumerate(languages)}
    if languages:
        at = np.array([column[x] for x in sums["label"].to_pylist()], dtype=np.int64)
        matrix[sums["bucket"].to_numpy(), at] = sums["n"].to_numpy()
    matrix = np.log(matrix + settings.smoothing) - np.log(matrix.sum(axis=0) + settings.smoothing * settings.buckets)
    counts = np.array([found[n] for n in languages], dtype=float)
    return Model(languages, np.log(counts / counts.sum()) if languages else counts,
                 np.ascontiguousarray(matrix.T), settings)


def classify(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Most probable language of each whole text and its posterior; ``und`` and 0 without letters.

    Equal posteriors go to the language that comes first in the alphabet.
    """
    scores = np.zeros((len(texts), len(model.languages)))
    seen = np.zeros(len(texts), bool)
    for owners, arrays in _runs(texts):
        starts, found = _ngrams(arrays, model.settings)
        for bucket in found:
            for language, row in enumerate(model.weights):
                np.add.at(scores[:, language], owners, np.add.reduceat(row[bucket], starts))
        seen[owners] |= [bool((a != 32).any()) for a in arrays]
    if not model.languages:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    scores += model.prior
    scores -= scores.max(axis=1, keepdims=True)
    best = scores.argmax(axis=1)
    top = 1 / np.exp(scores).sum(axis=1)
    return ([model.languages[b] if s else UNDETERMINED for b, s in zip(best, seen)],
            [float(p) if s else 0.0 for p, s in zip(top, seen)])


def predict(df: DataFrame, text: str, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to the columns ``keep`` (default: all columns).

    A null text, or one without letters, gets ``und`` and 0. Columns of those two names are replaced.
    The model (at most ``max_languages`` x ``buckets`` numbers) is broadcast.
    """
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    rows = df.select(F.struct(*[df[c] for c in keep]).alias("kept"), df[text].alias("text"))
    kept = rows.schema["kept"].dataType.simpleString()

    def score(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in parts:
            names, values = classify(part["text"], shared.value)
            yield {"kept": part["kept"], "lang_pred": names, "score": values}

    return map_chunks(rows, "text", f"kept {kept}, lang_pred string, score double", score).select(
        "kept.*", "lang_pred", "score")


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """Rows kept out of training."""
    return id_remainder(key, folds) == fold
