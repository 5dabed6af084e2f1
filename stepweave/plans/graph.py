"""The lineage graph as two tables, nodes ``(node_id, layer, name)`` and edges ``(source_id, target_id, edge_type)``.

Walks are semi-naive joins: a round joins only the pairs found in the round before, and ends in the session's
checkpoint folder, so that lineage stays short. Cycles and diamonds end by themselves, for known pairs are not new.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C2T, T2T, T2TECH, TAB2COL = "canonical_to_transformation", "transformation_to_transformation", "transformation_to_technical", "table_to_column"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, ``spark.checkpoint.dir``; only a local session gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(rows: DataFrame, most: int = 300_000) -> DataFrame:
    """For a join: a broadcast where the rows, of a few short columns each, are counted to be few; else Spark shuffles."""
    return F.broadcast(rows) if rows.count() <= most else rows


def reachable(roots: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(root, node_id, hops)``: every node on a walk from each root (column ``root``), with the fewest hops; 0 is the root."""
    steps = edges.select("source_id", "target_id").where("source_id IS NOT NULL AND target_id IS NOT NULL").distinct()
    found = front = settled(roots.select("root", F.col("root").alias("node_id"), F.lit(0).alias("hops")).distinct())
    for hop in range(1, max_rounds + 1):
        moved = front.join(steps, front.node_id == steps.source_id).select("root", F.col("target_id").alias("node_id")).distinct()
        front = settled(moved.join(found, ["root", "node_id"], "left_anti").select("root", "node_id", F.lit(hop).alias("hops")))
        if front.isEmpty():
            return found
        found = found.unionByName(front)
    raise RuntimeError(f"the walk did not end in {max_rounds} rounds")


def lineage_edges(edges: DataFrame) -> DataFrame:
    """Edges that a lineage walk follows: all but table to column."""
    return edges.where(F.col("edge_type") != TAB2COL)


def uses_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(metric_id, table_id)``: each metric and the distinct tables it ultimately reads."""
    roots = nodes.where("layer = 'canonical'").select(F.col("node_id").alias("root"))
    tables = nodes.where("layer = 'technical'").select("node_id")
    lineage = lineage_edges(edges).select("source_id", "target_id")
    # Tables that lead nowhere end a walk: only the others are walked through, and the ends are joined once.
    ends = tables.join(lineage.select(F.col("source_id").alias("node_id")), "node_id", "left_anti").select(F.col("node_id").alias("target_id"))
    walk = settled(reachable(roots, lineage.join(ends, "target_id", "left_anti")))
    last = walk.join(lineage.join(ends, "target_id", "left_semi"), F.col("node_id") == F.col("source_id")).select("root", F.col("target_id").alias("node_id"))
    found = walk.select("root", "node_id").join(tables, "node_id", "left_semi").select("root", "node_id").unionByName(last).distinct()
    return found.select(F.col("root").alias("metric_id"), F.col("node_id").alias("table_id"))


def calculated_by(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(metric_id, step_id, step_no)``: each metric's steps by distance, then id."""
    roots = nodes.where("layer = 'canonical'").select(F.col("node_id").alias("root"))
    steps = nodes.where("layer = 'transformation'").select("node_id")
    walk = reachable(roots, edges.where(F.col("edge_type").isin(C2T, T2T))).join(steps, "node_id", "left_semi")
    order = Window.partitionBy("root").orderBy("hops", "node_id")
    return walk.select(F.col("root").alias("metric_id"), F.col("node_id").alias("step_id"), F.row_number().over(order).alias("step_no"))


def validator_walk(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(metric_id, steps, table_edges)``: steps reached over step edges only, and table EDGES of those, not distinct tables."""
    steps = calculated_by(nodes, edges)
    reads = edges.where(F.col("edge_type") == T2TECH)
    counted = steps.join(reads, steps.step_id == reads.source_id, "left").groupBy("metric_id").agg(F.countDistinct("step_id").alias("steps"), F.count("target_id").alias("table_edges"))
    every = nodes.where("layer = 'canonical'").select(F.col("node_id").alias("metric_id"))
    return every.join(counted, "metric_id", "left").na.fill(0, ["steps", "table_edges"])


def most_read(uses: DataFrame, k: int) -> DataFrame:
    """The ``k`` metrics that read the most tables, ties by id."""
    return uses.groupBy("metric_id").agg(F.count("*").alias("tables")).orderBy(F.desc("tables"), "metric_id").limit(k)


def shared_sources(uses: DataFrame, part: int = 512) -> DataFrame:
    """``(a, b, shared)``: pairs of metrics (a before b) that read the same tables, and how many.

    The readers of a table are dealt into parts of about ``part``, and each pair of parts meets on its own, so that a
    table which nearly all metrics read is not the work of one task.
    """
    parts = uses.groupBy("table_id").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    rows = uses.join(parts, "table_id").withColumn("own", F.pmod(F.xxhash64("metric_id"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = rows.select(F.col("metric_id").alias("a"), "table_id", F.col("own").alias("p"), every.alias("q"))
    right = rows.select(F.col("metric_id").alias("b"), "table_id", every.alias("p"), F.col("own").alias("q"))
    return left.join(right, ["table_id", "p", "q"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_hops: int) -> DataFrame:
    """``(path)``: node lists of simple undirected paths of up to ``max_hops`` from a start to an end (columns ``node_id``)."""
    both = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionByName(edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))).where("a <> b").distinct()
    front, found = starts.select(F.array("node_id").alias("path")).distinct(), None
    for _ in range(max_hops):
        last = F.element_at("path", -1)
        front = front.join(both, last == both.a).where(~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path"))
        done = front.withColumn("node_id", F.element_at("path", -1)).join(ends.select("node_id").distinct(), "node_id", "left_semi").select("path")
        found = done if found is None else found.unionByName(done)
    return found


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges an end of which is no node."""
    known = nodes.select("node_id").distinct()
    bad = edges.join(known, edges.source_id == known.node_id, "left_anti").unionByName(edges.join(known, edges.target_id == known.node_id, "left_anti"))
    return bad.distinct()


def degree_by_layer(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes by layer and of edges by type, as ``(kind, value, n)``."""
    a = nodes.groupBy(F.lit("node").alias("kind"), F.col("layer").alias("value")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("value")).agg(F.count("*").alias("n")))
