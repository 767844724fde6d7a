"""Connected components of link tables of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from roomfold.llm.stages import stage


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace the edges of each batch by its spanning forest: every node points at its smallest member."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, find(x)) for x in parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pd.DataFrame(pairs, columns=["u", "v"], dtype="int64")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id per linked node.

    ``links`` has long columns ``u`` and ``v``; nulls and loops are ignored. Returns ``u`` and
    ``component`` for every node that has a link, the smallest member included. Union-find
    inside batches first shrinks the links to forests; rounds of large-star and small-star
    (every neighbour joins its node's smallest neighbour) then settle what spans batches, each
    round written to the shared folder. No node list is ever gathered in one place.
    """
    edges = links.where("u is not null and v is not null and u <> v").selectExpr(
        "greatest(u, v) u", "least(u, v) v")
    edges = stage(edges.mapInPandas(_union_find, "u long, v long").distinct())
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(low, "u").where("v > u and v <> low").selectExpr("v u", "low v")
        large = large.union(low.where("low <> u").selectExpr("u", "low v")).distinct()
        # small-star: the smaller neighbours of a node, and the node, join the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").where("v <> low").selectExpr("v u", "low v").union(
            least.selectExpr("u", "low v")).distinct()
        edges = stage(small)
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise ValueError("components did not settle; raise max_rounds")
    return edges.selectExpr("u", "v component").union(edges.selectExpr("v u", "v component")).distinct()
