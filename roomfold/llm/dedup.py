"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roomfold.llm.arrow import map_chunks
from roomfold.llm.linking import components
from roomfold.llm.shingles import mix, shingle_sets
from roomfold.llm.stages import likely_in, stage

_STEP = 0x9E3779B97F4A7C15
_GROUP = 40_000


@dataclass(frozen=True)
class Settings:
    """``similarity`` is in percent: texts are linked from 100 * intersection >= similarity * union.

    A pair at the threshold t is missed by all bands with probability (1 - t**rows)**bands: under
    1e-4 for the defaults (t = 0.8) and for 34 bands of 8 rows at t = 0.85.
    """

    words: int = 5
    similarity: int = 80
    bands: int = 34
    rows: int = 6
    #: Members and shingles of one block when a cluster is compared block by block.
    block_rows: int = 1024
    block_shingles: int = 2_000_000


def _signature_group(sets: list[np.ndarray], width: int) -> np.ndarray:
    x = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    best = np.full(len(sets) * width, np.inf)
    open_docs = np.arange(len(sets))
    slots = None
    for j in range(width):
        draw = mix(x + np.uint64((j + 1) * _STEP % 2**64))
        pick = j + (((draw & np.uint64(0xFFF)) * np.uint64(width - j)) >> np.uint64(12)).astype(np.int64)
        rank = (draw >> np.uint64(12)).astype(np.float64) * 2.0**-52 + j
        if slots is None:
            place = pick
        else:
            line = np.arange(len(x))
            place = slots[line, pick].astype(np.int64)
            slots[line, pick] = slots[:, j]
        np.minimum.at(best, owner * width + place, rank)
        # later steps only give values from j + 1 on: a signature below that is final
        rest = open_docs[best.reshape(-1, width)[open_docs].max(axis=1) >= j + 1]
        if not len(rest):
            break
        if len(rest) < len(open_docs) or slots is None:
            alive = np.isin(owner, rest)
            if slots is None:
                pick = pick[alive]
                slots = np.tile(np.arange(width, dtype=np.uint16), (len(pick), 1))
                slots[np.arange(len(pick)), pick] = 0
            else:
                slots = slots[alive]
            x, owner, open_docs = x[alive], owner[alive], rest
    return best.reshape(-1, width)


def signatures(sets: list[np.ndarray], width: int) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets of 64-bit hashes, one row of ``width`` per set.

    Step j draws for every element the j-th place of its own random permutation of the slots and a
    value in [j, j + 1); each slot keeps its smallest value. Sets of like size are worked on together.
    """
    out = np.empty((len(sets), width))
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    start, held = 0, 0
    for at, i in enumerate(order + [-1]):
        if i < 0 or (held and (held + len(sets[i]) > _GROUP or len(sets[i]) > 4 * len(sets[order[start]]) + 8)):
            if at > start:
                out[order[start:at]] = _signature_group([sets[k] for k in order[start:at]], width)
            start, held = at, 0
        if i >= 0:
            held += len(sets[i])
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; equal only if all values of the band are."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_STEP)), bits.shape[:2]).copy()
    for r in range(rows):
        key = mix(key + bits[:, :, r] * np.uint64(2 * r + 3))
    return key.astype(np.int64)


def sketch(docs: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """``id``, ``n_shingles``, a 128-bit digest of the shingle set and the band keys of every row."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    width = settings.bands * settings.rows

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in parts:
            sets = shingle_sets(part["text"], settings.words)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list[list[int]] = [[] for _ in sets]
            if full:
                keys = band_keys(signatures([sets[i] for i in full], width), settings.bands, settings.rows)
                for i, row in zip(full, keys.tolist()):
                    bands[i] = row
            yield {"id": part["id"], "n_shingles": [len(s) for s in sets], "bands": bands,
                   "digest": [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]}

    return map_chunks(rows, "text", "id long, n_shingles long, digest binary, bands array<long>", run)


def _exactly(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    if 100 * min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    common = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * common >= similarity * (len(x) + len(y) - common)


def verify(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Adds ``linked`` to rows with ``text_u`` and ``text_v``: whether the full shingle sets reach the similarity."""
    names = [c for c in pairs.columns if c != "text_v"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name in names)

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in parts:
            distinct = sorted({*part["text_u"], *part["text_v"]})
            sets = dict(zip(distinct, shingle_sets(distinct, settings.words)))
            linked = [_exactly(sets[a], sets[b], settings.similarity) for a, b in zip(part["text_u"], part["text_v"])]
            yield {n: part[n] for n in names} | {"linked": linked}

    return map_chunks(pairs, "text_u", f"{schema}, linked boolean", run)


def compare_blocks(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], joined: set[int],
                   similarity: int) -> list[tuple[int, int]]:
    """Links between two blocks of (id, set) that connect what is not yet connected; ``joined`` ids are one already."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    top = min(joined, default=None)
    for i in joined:
        parent[i] = top
    sizes = np.array([len(s) for _, s in left])
    flat = np.concatenate([s for _, s in left])
    owner = np.repeat(np.arange(len(left)), sizes)
    order = np.argsort(flat, kind="stable")
    values, begin, counts = np.unique(flat[order], return_index=True, return_counts=True)
    owner = owner[order]
    found = []
    for i, s in right:
        place = np.minimum(np.searchsorted(values, s), len(values) - 1)
        hit = place[values[place] == s]
        n = counts[hit]
        index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[hit], n)
        common = np.bincount(owner[index], minlength=len(left))
        for k in np.flatnonzero(100 * common >= similarity * (sizes + len(s) - common)):
            a, b = find(left[k][0]), find(i)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((left[k][0], i))
    return found


def _within_clusters(judged: DataFrame, settings: Settings) -> DataFrame:
    """Links of the members that are not linked to their hub, compared exactly with all other members.

    A cluster is dealt into blocks of bounded count and bytes; a task holds one block of unlinked members and one
    of any, and returns a spanning set of links, never the pairs.
    """
    loose = judged.groupBy("cluster").agg(F.count("*").alias("_n"), F.count_if(~F.col("linked")).alias("_m")).where("_n > 1 and _m > 0")
    rows = likely_in(judged, judged["cluster"], loose.select("cluster"))
    own = F.pmod(F.xxhash64("u"), "blocks").cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.where("not linked").select("cluster", own.alias("i"), every.alias("j"), F.lit(True).alias("left"), "u", "linked",
                                           F.col("text_u").alias("text"))
    right = rows.select("cluster", every.alias("i"), own.alias("j"), F.lit(False).alias("left"), "u", "linked",
                        F.col("text_u").alias("text"))

    def compare(group: pa.Table) -> pa.Table:
        ids, side, linked = (group[n].to_pylist() for n in ("u", "left", "linked"))
        sets = shingle_sets(group["text"].to_pylist(), settings.words)
        halves = [[(i, s) for i, s, at in zip(ids, sets, side) if at is wanted and len(s)] for wanted in (True, False)]
        found = compare_blocks(*halves, {i for i, x in zip(ids, linked) if x}, settings.similarity) if all(halves) else []
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    return left.union(right).groupBy("cluster", "i", "j").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    settings: Settings = Settings()) -> DataFrame:
    """Groups of near-duplicate texts: ``id``, ``n_shingles``, ``component``, one row per input row.

    ``component`` is the smallest id reachable over links. Null, empty and blank texts have no shingles
    and stand alone; a row with a null id is linked with nothing and gets a null component. Rows that
    repeat an id count as one document. Other columns of ``docs`` are not looked at.

    Equal sets become one class, represented by its smallest id; band buckets of one class are dropped.
    In a bucket the class that meets the most others over all its buckets is the hub; every class joins
    the cluster of its best hub and is verified against it, so a group of near copies costs one comparison
    each. Classes that miss their hub are compared exactly with the whole cluster, block by block. Last,
    buckets that hold several clusters and several components are settled pair by pair across clusters,
    leaving out the members of the bucket's largest cluster among themselves. Every two classes that share
    a bucket are thus compared or known to be connected.
    """
    sketches = stage(sketch(docs, key, text, settings))
    classes = sketches.where("n_shingles > 0 and id is not null").groupBy("digest").agg(
        F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    rows = classes.select("rep", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("rep").alias("_a"), F.max("rep").alias("_b"), F.count("*").alias("size")).where("_a <> _b")
    members = stage(rows.join(shared.select("band", "size"), "band"))
    met = members.groupBy("rep").agg(F.sum(F.col("size") - 1).alias("met"))
    ranked = members.select("band", "rep").join(met, "rep")
    best = F.struct("met", (-F.col("rep")).alias("back"))
    hubs = ranked.groupBy("band").agg(F.max(best).alias("hub"))
    placed = stage(members.select("band", "rep").join(hubs, "band").groupBy("rep").agg((-F.max("hub")["back"]).alias("cluster")))
    counts = classes.select("rep", "n")
    blocks = placed.join(counts, "rep").groupBy("cluster").agg(F.greatest(
        F.ceil(F.count("*") / settings.block_rows), F.ceil(F.sum("n") / settings.block_shingles)).cast("int").alias("blocks"))
    homes = placed.union(placed.select(F.col("cluster").alias("rep"), "cluster").distinct()).distinct().join(blocks, "cluster").groupBy(
        F.col("rep").alias("u")).agg(F.collect_set(F.struct("cluster", "blocks")).alias("clusters"))
    homes = stage(homes)
    plain = docs.select(F.col(key).cast("long").alias("u"), F.col(text).alias("text")).where("text is not null")
    texts = stage(likely_in(plain, plain["u"], homes.select("u")).join(homes.hint("merge"), "u"))
    centre = texts.where(F.array_contains("clusters.cluster", F.col("u"))).select(F.col("u").alias("cluster"), F.col("text").alias("text_v"))
    around = texts.select("u", F.explode("clusters").alias("c"), F.col("text").alias("text_u")).select(
        "u", "c.cluster", "c.blocks", "text_u").where("u <> cluster")
    judged = stage(verify(around.join(centre.hint("merge"), "cluster"), settings))
    links = judged.where("linked").select("u", F.col("cluster").alias("v")).union(_within_clusters(judged, settings))
    links = stage(links)
    groups = components(links)

    where = members.select("band", "rep").join(placed, "rep").join(groups.withColumnRenamed("u", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    sizes = where.groupBy("band", "cluster").agg(F.count("*").alias("n"), F.min("component").alias("_a"), F.max("component").alias("_b"))
    mixed = sizes.groupBy("band").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("largest"), F.count("*").alias("_k"),
                                      F.min("_a").alias("_a"), F.max("_b").alias("_b")).where("_k > 1 and _a <> _b")
    where = stage(where.join(mixed.select("band", "largest"), "band"))
    some = where.where("cluster <> largest").select("band", F.col("rep").alias("u"), F.col("cluster").alias("_c"), F.col("component").alias("_g"))
    across = some.join(where, "band").where("cluster <> _c and component <> _g and cluster <> u and rep <> _c").select(
        F.least("u", "rep").alias("u"), F.greatest("u", "rep").alias("v")).distinct()
    plain = texts.select("u", "text")
    both = stage(across).join(plain.withColumnRenamed("text", "text_u"), "u").join(
        plain.select(F.col("u").alias("v"), F.col("text").alias("text_v")), "v")
    found = stage(verify(both, settings).where("linked").select("u", "v"))
    if not found.isEmpty():
        groups = components(links.union(found))
    named = sketches.join(classes.select("digest", "rep"), "digest", "left").join(
        groups.withColumnRenamed("u", "rep"), "rep", "left")
    return named.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce(
        "component", "rep", "id")).alias("component"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows whose id is the smallest of its group, and the rows without an id; repeated rows stay."""
    gone = near_duplicates(docs, key, text, settings).where("component <> id").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs[key].cast("long") == gone["_gone"], "left_anti")
