"""Connected components of an edge table, by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm._common import materialise


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node that has an edge, root being the component's smallest node.

    edges has long columns a and b; loops and repeated edges do no harm. Only aggregates (min by node) and equi-joins
    are used, never a list of neighbours, so a hub with very many neighbours is no single row. Each round is written
    to the shared folder. Rounds grow with the logarithm of the longest chain.
    """
    now = materialise(edges.selectExpr("greatest(a, b) a", "least(a, b) b").where("a <> b").distinct(), f"{name}-0")
    seen = _fingerprint(now)
    for k in itertools.count(1):
        # large-star: every larger neighbour of u goes to u's smallest neighbour (or u)
        both = now.unionAll(now.selectExpr("b a", "a b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").selectExpr("b a", "m b").where("a <> b").distinct()
        # small-star: every smaller neighbour of u, and u, go to the smallest of them
        large = materialise(large, f"{name}-l{k}")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("b a", "m b").where("a <> b").unionAll(low.selectExpr("a", "m b")).distinct()
        now = materialise(small, f"{name}-s{k}")
        if (found := _fingerprint(now)) == seen:
            roots = now.groupBy("a").agg(F.min("b").alias("root"))
            return roots.withColumnRenamed("a", "node").unionAll(roots.selectExpr("root node", "root").distinct())
        seen = found
