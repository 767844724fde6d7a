"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from roomfold.llm.arrow import map_chunks
from roomfold.llm.shingles import hashed_words, mix, shingle_hashes


@dataclass(frozen=True)
class Settings:
    """An item is found where 100 * shared shingles >= ``containment`` * its shingles."""

    words: int = 5
    containment: int = 80
    slots: int = 64
    #: Words of the items that are searched for in one pass over the documents.
    block_words: int = 1_000_000


@dataclass
class _Class:
    """Items of one shingle width and one range of sizes: slot minima and full sets."""

    width: int
    size: int
    ids: list[int] = field(default_factory=list)
    sets: list[np.ndarray] = field(default_factory=list)
    keys: np.ndarray = None
    owner: np.ndarray = None


def _slot_minima(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest hash in every slot of every window of shingles: (window, slot-tagged minimum), empty slots left out.

    One permutation: a shingle belongs to the slot that its hash names and ranks by the rest of it.
    """
    lengths = ends - starts
    window = np.repeat(np.arange(len(starts)), lengths)
    index = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    ranked = mix(hashes)[index]
    cell = window * slots + (ranked & np.uint64(slots - 1)).astype(np.int64)
    best = np.full(len(starts) * slots, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(best, cell, ranked)
    used = np.flatnonzero(best != np.uint64(0xFFFFFFFFFFFFFFFF))
    return used // slots, best[used]


#: Items of smaller size classes are looked up by every shingle: few slot minima may miss one.
_EVERY_BELOW = 16


def _keys(size: int, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """What items and windows of a size class are looked up by: every shingle of small ones, slot minima of others."""
    if size >= _EVERY_BELOW:
        return _slot_minima(hashes, starts, ends, slots)
    lengths = ends - starts
    index = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths - starts, lengths)
    return np.repeat(np.arange(len(starts)), lengths), hashes[index]


def build_classes(ids: list[int], texts: list[str | None], settings: Settings) -> list[_Class]:
    """Items grouped by shingle width (shorter items have one shingle of all their words) and doubling sizes."""
    words, at = hashed_words(texts)
    groups: dict[tuple[int, int], _Class] = {}
    for i, item in enumerate(ids):
        own = words[at[i]:at[i + 1]]
        if len(own):
            found = np.unique(shingle_hashes(own, settings.words))
            width = min(settings.words, len(own))
            size = 1 << (len(own) - width).bit_length()  # 1, 2, 4, ...: at least its shingles
            group = groups.setdefault((width, size), _Class(width, size))
            group.ids.append(item)
            group.sets.append(found)
    for group in groups.values():
        counts = np.array([len(s) for s in group.sets])
        ends = np.cumsum(counts)
        group.owner, group.keys = _keys(group.size, np.concatenate(group.sets), ends - counts, ends, settings.slots)
        order = np.argsort(group.keys, kind="stable")
        group.owner, group.keys = group.owner[order], group.keys[order]
    return [groups[k] for k in sorted(groups)]


def find(texts: list[str | None], classes: list[_Class], settings: Settings) -> list[tuple[int, int, int, int]]:
    """(text number, item id, shared shingles, shingles of the item) of every contained item.

    For each size class the document is cut into windows of twice the class size, one class size apart,
    so an item's passage lies in a window not much larger than the item, whatever the document's length.
    A window and an item that share a key (see ``_keys``) are a candidate; the item's full set is then
    compared with the set of the whole document.
    """
    words, at = hashed_words(texts)
    out = []
    shingles: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    candidates: set[tuple[int, int, int]] = set()
    for number, group in enumerate(classes):
        if group.width not in shingles:
            parts = [shingle_hashes(words[at[i]:at[i + 1]], group.width) if at[i + 1] - at[i] >= group.width
                     else words[:0] for i in range(len(texts))]
            shingles[group.width] = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        hashes, begin = shingles[group.width]
        lengths = np.diff(begin)
        windows = np.where(lengths > 0, np.maximum(1, -(-(lengths - group.size) // group.size)), 0)
        text_of = np.repeat(np.arange(len(texts)), windows)
        turn = np.arange(len(text_of)) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = begin[:-1][text_of] + turn * group.size
        ends = np.minimum(starts + 2 * group.size, begin[1:][text_of])
        if not len(starts):
            continue
        window, keys = _keys(group.size, hashes, starts, ends, settings.slots)
        low, high = np.searchsorted(group.keys, keys, "left"), np.searchsorted(group.keys, keys, "right")
        for k in np.flatnonzero(high > low):
            for item in set(group.owner[low[k]:high[k]].tolist()):
                candidates.add((int(text_of[window[k]]), number, item))
    whole: dict[tuple[int, int], np.ndarray] = {}
    for text, number, item in sorted(candidates):
        group = classes[number]
        if (text, group.width) not in whole:
            hashes, begin = shingles[group.width]
            whole[text, group.width] = np.unique(hashes[begin[text]:begin[text + 1]])
        wanted, have = group.sets[item], whole[text, group.width]
        place = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
        shared = int((have[place] == wanted).sum())
        if 100 * shared >= settings.containment * len(wanted):
            out.append((text, group.ids[item], shared, len(wanted)))
    return out


def _blocks(items: DataFrame, limit: int) -> Iterator[tuple[list[int], list[str]]]:
    """Items in order of their ids, a block of about ``limit`` words at a time."""
    ids: list[int] = []
    texts: list[str] = []
    held = 0
    for row in items.orderBy("id", "text").toLocalIterator():
        ids.append(row.id)
        texts.append(row.text)
        held += len(row.text.split())
        if held >= limit:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def contained_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                    item_key: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs`` and benchmark item that it contains: ``id``, ``item_id``, ``shared``, ``n_item``.

    Words are runs of other bytes than white space after lower-casing A-Z; an item of fewer words than a
    shingle is one shingle of that length and must occur as such. Null, empty and blank texts and items,
    and items without an id, match nothing. Repeated rows each get their rows, repeated items are one.
    The test items are the query set: blocks of at most ``block_words`` words are sent to the executors
    one after the other, each searched for in all documents. Documents are never shuffled.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).alias("text")).where(
        "id is not null and text is not null").distinct()
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null")
    schema = "id long, item_id long, shared long, n_item long"
    found = rows.where("false").selectExpr("id", "id AS item_id", "id AS shared", "id AS n_item")
    for ids, texts in _blocks(items, settings.block_words):
        shared = spark.sparkContext.broadcast(build_classes(ids, texts, settings))

        def run(parts: Iterator[dict[str, list]], shared=shared) -> Iterator[dict[str, list]]:
            for part in parts:
                hits = find(part["text"], shared.value, settings)
                yield {"id": [part["id"][h[0]] for h in hits], "item_id": [h[1] for h in hits],
                       "shared": [h[2] for h in hits], "n_item": [h[3] for h in hits]}

        found = found.union(map_chunks(rows, "text", schema, run))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
          item_key: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that contain no item; rows without an id stay only if no such row contains one."""
    hit = contained_items(docs, benchmark, key, text, item_key, item_text, settings).select(
        F.col("id").alias("_hit")).distinct()
    return docs.join(hit, docs[key].cast("long").eqNullSafe(hit["_hit"]), "left_anti")
