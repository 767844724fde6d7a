"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from roomfold.llm.arrow import map_chunks
from roomfold.llm.shingles import hashed_words, mix, shingle_hashes

BAD, FINE, ABSTAIN = 0, 1, 2

#: Labellers: a measure and the limit beyond which it votes bad. It abstains where its measure is undefined.
LABELLERS = {
    "symbols": 0.15,        # symbol characters per word
    "capitals": 0.3,        # upper case among letters
    "repetition": 0.5,      # repeated word triples
    "repeated_lines": 0.6,  # repeated lines
    "bars": 0.15,           # column bars per word
    "exclamations": 0.2,    # exclamation marks per word
    "open_lines": 0.6,      # lines that end without a full stop, question or exclamation mark
    "digits": 0.6,          # digits among letters and digits
}
_SYMBOLS = "#$%&*@^~=+<>{}[]\\_"


@dataclass(frozen=True)
class Settings:
    bits: int = 13
    #: Expected number of rows that the linear scorer is fitted on; labels come from the model over all rows.
    train_rows: int = 6000
    em_rounds: int = 60
    #: Largest rate of bad votes of a labeller on good texts.
    most_wrong: float = 0.01
    descent_rounds: int = 250
    threshold: float = 0.5


@dataclass(frozen=True)
class Model:
    prior: float  # share of good texts
    rates: dict[str, tuple[float, float]]  # of each labeller: its bad votes among bad texts, and among good ones
    weights: np.ndarray
    bias: float
    settings: Settings


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: upper, lower, other letter, digit, white space, line end, or the character itself."""
    out = np.full(0x110000, 6, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = 0 if c.isupper() else 1 if c.islower() else 2
        elif c.isdigit():
            out[i] = 3
        elif c.isspace():
            out[i] = 4
    out[10] = 5
    for i in range(33, 127):
        if not chr(i).isalnum():
            out[i] = i
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def measures(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """One row of measures per whole text (nan where undefined), and the text as a sequence of classes."""
    table = _classes()
    hashed, at = hashed_words(texts)
    rows, shapes = np.full((len(texts), len(LABELLERS)), np.nan), []
    for i, text in enumerate(texts):
        kinds = table[_points(text or "")]
        shapes.append(kinds)
        own = hashed[at[i]:at[i + 1]]
        n = len(own)
        if not n:
            continue
        counts = np.bincount(kinds, minlength=128)
        letters, digits = counts[:3].sum(), counts[3]
        triples = shingle_hashes(own, 3)
        lines = [x.rstrip() for x in text.split("\n")]
        lines = [x for x in lines if x]
        rows[i] = (
            sum(counts[ord(c)] for c in _SYMBOLS) / n, counts[0] / letters if letters >= 10 else np.nan,
            1 - len(np.unique(triples)) / len(triples) if n >= 20 else np.nan,
            1 - len(set(lines)) / len(lines) if len(lines) >= 4 else np.nan,
            counts[ord("|")] / n, counts[ord("!")] / n,
            sum(x[-1] not in ".!?\"')]…»”:" for x in lines) / len(lines),
            digits / (letters + digits) if letters + digits >= 30 else np.nan)
    return rows, shapes


def votes(rows: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.where(np.isnan(rows), ABSTAIN, np.where(rows > np.array(list(LABELLERS.values())), BAD, FINE))


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int, most_wrong: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: class shares, P(vote | class) and P(good | pattern).

    Class 0 are good texts; since bad texts are bad in different ways, each labeller also starts a class of its
    own, which EM then fits to the votes that go together. Labellers are independent given the class, and one
    that abstains says nothing. On good texts a labeller is wrong at a rate of at most ``most_wrong``.
    """
    n = patterns.shape[1]
    bad = patterns == BAD
    any_bad = bad.any(axis=1)
    share = np.zeros((n + 1, len(patterns)))
    share[0] = np.where(any_bad, 0.1, 1.0)
    share[1:] = (0.9 * bad / np.maximum(bad.sum(axis=1), 1)[:, None]).T
    one_hot = patterns[:, :, None] == np.arange(2)
    for _ in range(rounds):
        mass = share * counts
        prior = (mass.sum(axis=1) + 0.01) / (counts.sum() + 0.01 * (n + 1))
        table = np.einsum("cp,plv->clv", mass, one_hot) + 0.05
        table /= table.sum(axis=2, keepdims=True)
        table[0, :, BAD] = np.minimum(table[0, :, BAD], most_wrong)
        table[0, :, FINE] = 1 - table[0, :, BAD]
        logs = np.concatenate([np.log(table), np.zeros((n + 1, n, 1))], axis=2)
        odds = np.stack([logs[c][np.arange(n), patterns].sum(axis=1) for c in range(n + 1)]) + np.log(prior)[:, None]
        odds = np.exp(odds - odds.max(axis=0))
        share = odds / odds.sum(axis=0)
    return prior, table, share[0]


def features(rows: np.ndarray, shapes: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features in sparse rows (offsets, buckets, values): n-grams of collapsed shapes and binned measures."""
    offsets, buckets, values = [0], [], []
    shift = np.uint64(64 - bits)
    steps = np.array([0.001, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
    names = np.arange(1, rows.shape[1] + 1, dtype=np.uint64) * np.uint64(1 << 40)
    for row, kinds in zip(rows, shapes):
        found = []
        if len(kinds):
            run = kinds[np.concatenate(([True], kinds[1:] != kinds[:-1]))].astype(np.uint64) + np.uint64(1)
            code = run
            for order in (2, 3):
                if len(code) > 1:
                    code = code[:-1] * np.uint64(131) + run[order - 1:]
                    found.append(code + np.uint64(order << 32))
        gram = np.concatenate(found) if found else np.empty(0, np.uint64)
        key, count = np.unique((mix(gram) >> shift).astype(np.int64), return_counts=True)
        weight = np.sqrt(count)
        weight = weight / max(np.sqrt((weight**2).sum()), 1e-9)
        binned = names + np.where(np.isnan(row), 99, np.searchsorted(steps, np.nan_to_num(row))).astype(np.uint64)
        buckets += [key, (mix(binned) >> shift).astype(np.int64)]
        values += [weight, np.full(len(row), 0.5)]
        offsets.append(offsets[-1] + len(key) + len(row))
    if not buckets:
        return np.array([0]), np.empty(0, np.int64), np.empty(0)
    return np.array(offsets), np.concatenate(buckets), np.concatenate(values)


def _descend(offsets: np.ndarray, buckets: np.ndarray, values: np.ndarray, target: np.ndarray, times: np.ndarray,
             settings: Settings) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adagrad over all rows, each counted ``times`` times."""
    weights, bias = np.zeros(1 << settings.bits), 0.0
    seen, seen_bias = np.full(len(weights), 1e-6), 1e-6
    row = np.repeat(np.arange(len(target)), np.diff(offsets))
    for _ in range(settings.descent_rounds):
        score = np.bincount(row, values * weights[buckets], len(target)) + bias
        error = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - target) * times / max(times.sum(), 1)
        slope = np.bincount(buckets, values * error[row], len(weights)) + 1e-6 * weights
        seen += slope**2
        seen_bias += error.sum()**2
        weights -= 0.5 * slope / np.sqrt(seen)
        bias -= 0.5 * error.sum() / np.sqrt(seen_bias)
    return weights, bias


def train(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> Model:
    """Fit the labellers' accuracies on the vote patterns of all texts, then the scorer on posterior labels.

    At most 3 ** labellers patterns are counted; about ``train_rows`` rows, chosen by a hash of the text,
    give sparse features for the scorer. A text that repeats comes to the scorer once, with the number of its rows as
    its weight, so the sample stays bounded whatever repeats. Null and blank texts take no part, long texts are measured
    whole. On an empty table every text gets the score of an undecided one.
    """
    rows = docs.select(F.col(text).alias("text")).where("text is not null")

    def cast(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        totals: dict[tuple[int, ...], int] = {}
        for part in parts:
            found = votes(measures(part["text"])[0])
            distinct, count = np.unique(found, axis=0, return_counts=True) if len(found) else (found, [])
            for pattern, n in zip(distinct.tolist(), count):
                totals[tuple(pattern)] = totals.get(tuple(pattern), 0) + int(n)
        yield {"pattern": [list(p) for p in totals], "n": list(totals.values())}

    counted = map_chunks(rows, "text", "pattern array<int>, n long", cast).groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    counted = sorted((tuple(r.pattern), r.n) for r in counted if any(v != ABSTAIN for v in r.pattern))
    if not counted:
        return Model(0.5, {}, np.zeros(1 << settings.bits), 0.0, settings)
    patterns, counts = np.array([p for p, _ in counted]), np.array([n for _, n in counted], float)
    prior, table, good = fit_labellers(patterns, counts, settings.em_rounds, settings.most_wrong)
    posterior = {p: float(g) for (p, _), g in zip(counted, good)}
    ill = np.einsum("c,cl->l", prior[1:], table[1:, :, BAD]) / prior[1:].sum()
    rates = {name: (float(ill[i]), float(table[0, i, BAD])) for i, name in enumerate(LABELLERS)}
    share = min(1.0, settings.train_rows / counts.sum())
    chosen = rows.where((F.xxhash64("text").bitwiseAND(F.lit((1 << 24) - 1))) < F.lit(int(share * (1 << 24)) + 1))
    sample = chosen.groupBy("text").agg(F.count("*").alias("n"))

    def featurise(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in parts:
            found, shapes = measures(part["text"])
            offsets, buckets, values = features(found, shapes, settings.bits)
            marks = [posterior.get(tuple(v)) for v in votes(found).tolist()]
            keep = [i for i, m in enumerate(marks) if m is not None]
            yield {"target": [marks[i] for i in keep], "times": [part["n"][i] for i in keep], "bucket": [buckets[offsets[i]:offsets[i + 1]].tolist() for i in keep],
                   "value": [values[offsets[i]:offsets[i + 1]].tolist() for i in keep]}

    got = map_chunks(sample, "text", "target double, times long, bucket array<int>, value array<double>", featurise).toArrow()
    lists = got["bucket"].combine_chunks()
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    flat = lambda name: np.array([v for x in got[name].to_pylist() for v in x])
    weights, bias = _descend(offsets, flat("bucket").astype(np.int64), flat("value"), got["target"].to_numpy(), got["times"].to_numpy().astype(float), settings)
    return Model(float(prior[0]), rates, weights, bias, settings)


def scores(texts: list[str | None], model: Model) -> list[float]:
    """Probability of good quality of each whole text; 0 for null and blank texts."""
    found, shapes = measures(texts)
    offsets, buckets, values = features(found, shapes, model.settings.bits)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    total = np.bincount(row, values * model.weights[buckets], len(texts)) + model.bias
    blank = np.array([not (t and t.strip()) for t in texts], bool)
    return np.where(blank, 0.0, 1 / (1 + np.exp(-np.clip(total, -40, 40)))).tolist()


def classify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with ``quality_score`` and ``quality_keep``; columns of those names are replaced.

    A null or blank text scores 0 and is rejected. Equal texts score equally, so repeated rows share their fate.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("quality_score", "quality_keep")]
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("kept"), docs[text].alias("text"))
    kept = rows.schema["kept"].dataType.simpleString()

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in parts:
            yield {"kept": part["kept"], "quality_score": scores(part["text"], shared.value)}

    return map_chunks(rows, "text", f"kept {kept}, quality_score double", run).select(
        "kept.*", "quality_score", (F.col("quality_score") >= model.settings.threshold).alias("quality_keep"))
