"""Connected components over an edge table: alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import durable


def local_forest(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Root (the smallest member) of each of ``size`` nodes after linking ``left[i]`` with ``right[i]``."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            return root


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One round. Large: each node's larger neighbours move to its smallest; small: its smaller ones do."""
    if larger:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if larger:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of an edge; root is the smallest node reachable.

    ``edges``: columns ``u`` and ``v`` of one orderable type without nulls; direction, loops and repeats don't matter.
    Each round is two aggregations and two joins and ends in the shared checkpoint folder; rounds grow with the
    logarithm of the longest path. An empty table gives an empty table.
    """
    now = durable(edges.select("u", "v").where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = durable(_star(_star(now, True), False))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
