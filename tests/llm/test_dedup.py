import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomfold.llm import dedup
from roomfold.llm.linking import components
from roomfold.llm.shingles import hashed_words, shingle_sets
from tests.llm import brute

SMALL = dedup.Settings(words=3, similarity=85, bands=34, rows=8, block_rows=7)


def found(spark, rows, settings=SMALL, schema="doc_id long, text string"):
    out = dedup.near_duplicates(spark.createDataFrame(rows, schema), settings=settings).collect()
    return {r.id: r.component for r in out}, out


def near_copies(seed, n, words=60, edits=8):
    """Copies of one text, each with its own few words replaced."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(draw.randrange(edits)):
            own[draw.randrange(words)] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_groups_equal_all_pairs(spark):
    texts = near_copies(1, 60) + near_copies(2, 40, words=25, edits=3) + [
        "", "  \n", "one", "one", "one two", "two one", "ONE two", "a b c", "a b c\td", "a b c d e", "É b c", "é b c"]
    rows = list(enumerate(texts, 100))
    random.Random(3).shuffle(rows)
    got, out = found(spark, rows)
    assert got == brute.components(rows, 3, 85)
    assert {r.id: r.n_shingles for r in out} == {i: len(brute.shingles(t, 3)) for i, t in rows}


def test_five_words_at_eighty_percent(spark):
    rows = list(enumerate(near_copies(5, 50, words=80, edits=7)))
    assert found(spark, rows, dedup.Settings())[0] == brute.components(rows, 5, 80)


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(200_000))
    rows = [(None, "a b c d"), (1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (4, "a b c d"), (5, long), (6, long + " end")]
    out = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit(1)), settings=SMALL)
    got = sorted(((r.id, r.component) for r in out.collect()), key=str)
    assert got == sorted([(None, None), (1, 1), (2, 2), (3, 3), (3, 3), (4, 3), (5, 5), (6, 5)], key=str)
    kept = dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), settings=SMALL)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 3, 5]
    assert found(spark, [])[0] == {}


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 500)] + [(1000, 1003), (1003, 1001), (7000, 7000)]
    random.Random(1).shuffle(links)
    got = {r.u: r.component for r in components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(501)}, 1000: 1000, 1001: 1000, 1003: 1000}


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(0)
    shared = draw.integers(0, 2**63, 600, dtype=np.uint64)
    sets = [np.unique(np.concatenate((shared, draw.integers(0, 2**63, 150, dtype=np.uint64)))) for _ in range(20)]
    sets.append(np.unique(draw.integers(0, 2**63, 3, dtype=np.uint64)))
    signature = dedup.signatures(sets, 256)
    assert np.isfinite(signature).all()
    agree = [(signature[i] == signature[i + 1]).mean() for i in range(0, 20, 2)]
    assert abs(np.mean(agree) - 600 / 900) < 0.04
    alone = dedup.signatures([sets[-1]], 256)
    assert (alone == signature[-1:]).all()


@pytest.mark.parametrize("text", ["Ab\x0bcd  E F\n", "", None, "x", " \t "])
def test_words_are_cut_at_ascii_space(text):
    hashes, at = hashed_words([text, "tail"])
    assert at[1] == len(brute.words(text)) and len(hashes) == at[2] == at[1] + 1


def test_hashes_do_not_depend_on_neighbours():
    texts = ["alpha beta gamma", "beta", " ".join(["w"] * 700_000 + ["beta"])]
    together = shingle_sets(texts, 1)
    assert all((a == shingle_sets([t], 1)[0]).all() for a, t in zip(together, texts))
    assert together[1][0] in together[0] and together[1][0] in together[2]
