"""The mix of sources against a plain version."""

import hashlib
import math
import re

import pytest

from roomfold.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, target int, size string, weight int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights=(1, 2, 3), share=1.0, epochs=3):
    """Reshare what is over by weight until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in stopped)
        open_ = sum(weight[s] for s in names if s not in stopped)
        target = {s: epochs * sizes[s] if s in stopped else left * weight[s] / open_ for s in names}
        over = {s for s in names if s not in stopped and target[s] >= epochs * sizes[s]}
        if not over or over | stopped == set(names):
            return {s: min(t, epochs * sizes[s]) for s, t in target.items()}
        stopped |= over


def plain_mix(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    target, out = plain_targets(sizes), []
    for source, size in sizes.items():
        own = [r for r in rows if r[2] == source]
        own.sort(key=lambda r: hashlib.md5(":".join(["1", source or "", "" if r[0] is None else str(r[0]), r[1] or ""]).encode()).hexdigest())
        left = math.floor(target[source] + 0.5)
        times = min(left // size, 3) if size else 0
        left -= times * size
        for i, text, _ in own:
            part = min(words(text), max(left, 0))
            left -= part
            out.append((i, words(text), size, target[source], times * words(text) + part))
    return out


CORPUS = [(i, "w " * (i % 37) + "end", f"s{i * i % 6}") for i in range(400)]


@pytest.mark.parametrize("rows", [
    CORPUS,
    CORPUS + [(1000 + i, None if i % 3 else "", None) for i in range(20)] + [(2000, "long " * 100_000, None)],
    CORPUS + [(None, "same text here", "s1")] * 300 + [(7, "same text here", None)] * 200,  # repeats
    [(1, "a b c", "x")], [(1, None, None)], [(1, "", "a"), (2, "one two three four", "b")], [(i, "tie", str(i)) for i in range(9)],
])
@pytest.mark.parametrize("slice_rows", [50_000, 5])
def test_mix_equals_plain_one(spark, rows, slice_rows):
    found = mixing.mix(table(spark, rows), settings=mixing.Settings(slice_rows=slice_rows)).collect()
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 6), r[4])
    got = sorted(key((r["id"], r["size"], r["source_size"], r["target"], r["taken"])) for r in found)
    assert got == sorted(map(key, plain_mix(rows)))
    for source in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == source]
        assert sum(r["taken"] for r in own) == math.floor(own[0]["target"] + 0.5) and all(r["taken"] <= 3 * r["size"] for r in own)


def test_mix_of_nothing(spark):
    assert mixing.mix(table(spark, [])).count() == 0


def test_other_weights_and_shares(spark):
    rows = [(i, "a b c d e", "big" if i % 10 else "small") for i in range(1000)]
    settings = mixing.Settings(weights=(1, 9), share=0.5, epochs=2)
    target = {r["source"]: r["target"] for r in mixing.mix(table(spark, rows), settings=settings).collect()}
    assert target == {"small": 1000.0, "big": 1500.0}


def test_texts_of_the_mix(spark):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(i % 9)), f"s{i % 4}") for i in range(80)]
    docs = table(spark, rows)
    mixed = mixing.mix(docs)
    taken = {r["id"]: r["taken"] for r in mixed.collect()}
    uses = {}
    for r in mixing.texts(docs, mixed).collect():
        uses.setdefault(r["id"], []).append(r["text"])
    assert {i: sum(words(t) for t in uses.get(i, [])) for i in taken} == taken
    by_id = {r[0]: r[1] for r in rows}
    assert all(by_id[i].startswith(t) for i, found in uses.items() for t in found)
