"""Connected components of an edge table, by alternating large and small stars on written tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import drop_written, written


class Forest:
    """Union-find over small integers; a root is the least member."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return int(a)

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            above = up[up]
            if np.array_equal(above, up):
                return up
            up[:] = above


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a long, b long): the least node that it reaches.

    Each round makes, with m the least of a node and its neighbours, a large star (larger neighbours to m) and then a
    small star (the node and its smaller neighbours to m); it ends when a round changes nothing, after about the
    logarithm of the longest path. Only (a, b) pairs are shuffled, at most a row per edge, partial minima first; a hub's
    rows are dealt by joins that adaptive execution splits. Every round is written to the shared folder. Nulls and loops
    are no edges; an empty table has no components; repeated edges don't matter.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("n")).select(F.col("a").alias("k"), F.least("a", "n").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every row of `large` goes from a node to a smaller one: the small star's groups
        down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(down, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = written(small, "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_written(now)
        now = after
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
