"""Connected components: local forests inside tasks, star contraction across them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


class Forest:
    """Union of numbered nodes by vectorised hooking; a node's root is the least number of its tree."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        found = self.parent[nodes]
        while True:
            above = self.parent[found]
            if np.array_equal(above, found):
                return found
            self.parent[nodes] = above
            found = above

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Node and root of all nodes that aren't roots: a spanning forest."""
        nodes = np.arange(len(self.parent))
        roots = self.roots(nodes)
        apart = roots != nodes
        return nodes[apart], roots[apart]


def star_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its least reachable node) for every node of ``edges`` (columns a and b, of one type).

    Alternating large-star and small-star steps: each links a node's
    neighbours to the least of them, so that edges never outgrow their first
    number and all components are stars after a few rounds. Minima are
    aggregated before they are shuffled. They and each round's edges are
    written to the shared folder: so the joins read plain tables, and adaptive
    execution splits a hub with very many neighbours, which it can't do above
    an aggregate. Self-loops and nulls are ignored.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        discard(least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges, large, least)
        edges, done, mark = new, after == mark, after
        if done:
            break
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
