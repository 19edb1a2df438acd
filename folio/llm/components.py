"""Connected components of an edge table by alternating large and small stars.

Every round is joins and minimum aggregations over edges; each round is written to the shared folder.  The minimum of a node's neighbours is taken on each
task first; the join that hands it back deals a node's edges by the node, which for a hub is a skewed partition that adaptive execution splits.
Edges whose ends are null are ignored, repeated ones count once, a table without edges gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``node, component`` (the least node reachable) for every node of ``a, b`` edges; loops are ignored."""
    now = scratch.keep(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    mark, turn = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.where(F.col("u") != F.col("v")).distinct(), f"{name}_l{turn}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # of all smaller neighbours of u the least is the root; the others and u itself are hung on it
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = scratch.keep(small.distinct(), f"{name}{turn + 1}")
        scratch.drop(f"{name}{turn}", f"{name}_l{turn}")
        turn += 1
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark, now = seen, new
    return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Forest:
    """Union-find over 0..n-1 with roots of least index, inside one task."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            new = up[up]
            if (new == up).all():
                self.up = new
                return new
            up = new
