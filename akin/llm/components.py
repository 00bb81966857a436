"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from akin.llm.tables import dropped, written


class Forest:
    """Union-find over the few nodes that one task holds."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def union(self, a: int, b: int) -> bool:
        """Join two nodes; whether they were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for every node of the edges (a, b long).

    Large-star and small-star rounds: a node's smallest neighbour is found by an aggregation and joined back
    to its edges, so no neighbourhood is ever collected and a round's size is that of the edges. Every round is
    a written table; the rounds end when the stars stay as they are. Null ends and loops are left out.
    """
    top, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = written(edges.where("a is not null and b is not null and a <> b").select(top, low).distinct(), "edges")
    before, state = None, _state(now)
    while state != before:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        half = written(large.distinct(), "edges")
        root = half.groupBy("a").agg(F.min("b").alias("m"))
        moved = half.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(moved.unionAll(root.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, state = state, _state(after)
        dropped(now, half)
        now = after
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
