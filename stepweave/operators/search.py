"""Similarity search with a refusal threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similar(catalog: DataFrame, query: list[float], vector: str, id_col: str, threshold: float, k: int) -> DataFrame:
    """The ``k`` rows nearest to a query at ``threshold`` or more, each with the number of all rows above it.

    No row above the threshold means no answer, not the least bad one. A literal vector goes to every scan; only rows
    above the threshold are sorted.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    near = catalog.withColumn("closeness", cosine(F.col(vector), q)).where(F.col("closeness") >= threshold)
    near = near.withColumn("closeness", F.round("closeness", 6))
    total = near.agg(F.count("*").alias("total_matches"))
    return near.orderBy(F.desc("closeness"), id_col).limit(k).crossJoin(total)  # one row


def similar_to_each(catalog: DataFrame, queries: DataFrame, vector: str, id_col: str, threshold: float, k: int, block: int = 1024) -> DataFrame:
    """``(query_id, <id_col>, closeness, total_matches)``: for each row of ``queries`` what ``similar`` gives for its vector.

    Both tables have ``id_col`` and ``vector``, and no two queries share an id; a query whose vector is null, zero or of another length finds nothing there.
    Blocks of about ``block`` queries meet blocks of as many rows, one task a pair of blocks, which sends on only the
    ``k`` best and the number of matches of each query.
    """
    kind = dict(catalog.dtypes)[id_col]

    def dealt(rows: DataFrame, side: int) -> tuple[DataFrame, int]:
        blocks = max(1, -(-rows.count() // block))
        rows = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(side).alias("side"))
        return rows.withColumn("own", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")), blocks

    (asked, n_asked), (held, n_held) = dealt(queries, 0), dealt(catalog, 1)
    asked = asked.select("id", "v", "side", F.col("own").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n_held - 1))).alias("b"))
    held = held.select("id", "v", "side", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))).alias("a"), F.col("own").alias("b"))

    def compare(table: pa.Table) -> pa.Table:
        side, vectors, ids = table.column("side").to_numpy(), table.column("v").to_pylist(), table.column("id")
        out = {"q": [], "i": [], "c": [], "n": []}
        lengths = np.array([len(v) if v and all(x is not None for x in v) else 0 for v in vectors])
        order = np.argsort(np.argsort(np.array(ids.to_pylist(), dtype=object))) if ids.null_count == 0 else np.arange(len(ids))
        for dim in set(lengths[side == 0].tolist()) - {0}:
            q, r = np.flatnonzero((side == 0) & (lengths == dim)), np.flatnonzero((side == 1) & (lengths == dim))
            if not len(r):
                continue
            x, y = (np.array([vectors[j] for j in at], dtype=np.float64) for at in (q, r))
            with np.errstate(all="ignore"):
                close = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
            for row, at in zip(close, q, strict=True):
                hit = np.flatnonzero(row >= threshold)  # by the raw value; ties are of rounded ones
                row = np.round(row, 6)
                best = hit[np.lexsort((order[r[hit]], -row[hit]))[:k]]
                for place, j in enumerate(best):
                    for name, value in zip("qicn", (at, r[j], row[j], len(hit) if place == 0 else 0), strict=True):
                        out[name].append(value)
        return pa.table({"query_id": ids.take(pa.array(out["q"], pa.int64())), "id": ids.take(pa.array(out["i"], pa.int64())), "closeness": pa.array(out["c"], pa.float64()), "n": pa.array(out["n"], pa.int64())})

    found = asked.unionByName(held).groupBy("a", "b").applyInArrow(compare, f"query_id {kind}, id {kind}, closeness double, n bigint")
    near = Window.partitionBy("query_id")
    out = found.withColumn("total_matches", F.sum("n").over(near)).withColumn("place", F.row_number().over(near.orderBy(F.desc("closeness"), "id")))
    return out.where(F.col("place") <= k).select("query_id", F.col("id").alias(id_col), "closeness", "total_matches")


def best_of_groups(near: DataFrame, group: str, id_col: str, per_group: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc("closeness"), id_col)
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_group)
