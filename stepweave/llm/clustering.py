"""Centroid clustering: plain Lloyd rounds over integer vectors.

The centroids (``k`` vectors, whatever the number of rows) go to every task. ``mapInPandas`` takes the squared
differences of its rows to each centroid in NumPy integers, the least distance names the cluster (of equal ones the
lowest number), and only the sums of a partition leave it, a row for each cluster and component, which ``groupBy`` adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import durable, plain

#: Number of clusters, rounds, components of a vector, and steps of an integer in one.
K, ROUNDS, DIM, SCALE = 8, 10, 64, 1024
#: Integers up to here add up to longs over any number of rows that a table can have (2 ** 36 of them).
LARGEST = 1 << 26


def clusterable(vector: Column, dim: int = DIM, scale: int = SCALE) -> Column:
    """Whether a vector takes part: ``dim`` components, none null, NaN or infinite, nor beyond ``LARGEST`` steps."""
    bad = F.exists(vector, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) * scale > LARGEST), F.lit(True)))
    return F.coalesce((F.size(vector) == dim) & ~bad, F.lit(False))


def _integers(vectors: pd.Series, scale: int) -> np.ndarray:
    return np.floor(np.stack(vectors.to_numpy()).astype(np.float64) * scale).astype(np.int64)


def _nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each point (of equal distances the lowest) and its squared distance."""
    far = np.stack([np.square(points - c).sum(axis=1) for c in centroids])
    own = far.argmin(axis=0)
    return own, far[own, np.arange(len(points))]


def first_centroids(rows: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The ``k`` vectors whose ids hash lowest, in that order (equal ids: by components)."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = rows.select(mark.alias("mark"), "vector").orderBy("mark", "vector").limit(k).collect()  # k rows
    return _integers(pd.Series([r.vector for r in found]), scale) if found else np.empty((0, 0), np.int64)


def next_centroids(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """One round: every non-empty centroid becomes the floor of the mean of its vectors, component by component."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            points = _integers(batch["vector"], scale)
            own, _ = _nearest(points, centroids)
            np.add.at(total, own, points)
            count += np.bincount(own, minlength=len(centroids))
        cluster, axis = np.indices(centroids.shape)
        yield pd.DataFrame({"cluster": cluster.ravel(), "axis": axis.ravel(), "total": total.ravel(), "n": np.repeat(count, centroids.shape[1])})

    partial = rows.select("vector").mapInPandas(sums, "cluster int, axis int, total bigint, n bigint")
    merged = partial.groupBy("cluster", "axis").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0")
    out = centroids.copy()
    for cluster, axis, total, n in merged.collect():  # k rows for each component
        out[cluster, axis] = total // n
    return out


def lloyd(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 3
) -> tuple[DataFrame, np.ndarray]:
    """``(id, cluster, distance)`` of every vector that takes part, and the centroids, an array of ``k`` rows.

    A vector takes part if it has ``dim`` components, none null or non-finite, nor larger than ``LARGEST / scale`` (65536
    at the given scale, so that all sums fit in longs); rows with other vectors have no row in the result. Components
    become ``floor(scale * x)``. Centroids start as the vectors with the ``k`` lowest SHA-256 of ``seed:id`` (a null id is
    empty; fewer vectors make fewer centroids). Each of ``rounds`` rounds assigns all vectors and moves every centroid
    that has some; empty ones stay. Rows that repeat an id or a vector count each. An empty table gives an empty result
    and no centroid. Other columns are not read. Every round scans the table once and shuffles ``k * dim`` sums a
    partition; nothing else is kept between rounds, so a lost executor costs its tasks only.
    """
    rows = plain(vectors, id=id_col, vector=vector_col).withColumn("vector", F.col("vector").cast("array<double>"))
    rows = rows.where(clusterable(F.col("vector"), dim, scale))
    centroids = first_centroids(rows, k, seed, scale)
    kind = f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance bigint"
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], kind), centroids
    for _ in range(rounds):
        centroids = next_centroids(rows, centroids, scale)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, far = _nearest(_integers(batch["vector"], scale), centroids)
            yield pd.DataFrame({"id": batch["id"], "cluster": own, "distance": far})

    return rows.mapInPandas(assign, kind), centroids


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid)``: the result of ``lloyd`` with its sums of distances
    over the cluster and over all (null where no long holds them), and the components of the cluster's centroid."""
    placed, centroids = lloyd(vectors, id_col, vector_col, **options)
    placed = durable(placed)  # an id and two numbers a row
    sums = placed.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    total = placed.agg(F.try_sum("distance").alias("inertia"))
    named = placed.sparkSession.createDataFrame([(n, c.tolist()) for n, c in enumerate(centroids)], "cluster int, centroid array<bigint>")
    facts = sums.join(named, "cluster").crossJoin(total)  # a row a cluster, and one row
    return placed.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
