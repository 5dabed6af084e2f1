"""The lineage graph as typed tables, written in one pass over its nodes and one over its edges.

Both passes write one folder, partitioned by the table a row belongs to, and count as they write: what goes out must be
what came in, less the layers that are left out on purpose. A typed table is its partition with columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stepweave.plans import graph

# The table of each layer and edge type, what is left out, and the columns of each table by field.
LAYERS = {"canonical": "graph_canonical", "transformation": "graph_transformation", "technical": "graph_technical", "report": "graph_report", "measure": "graph_measure"}
EDGES = {
    "canonical_to_transformation": "graph_edge_c2t", "transformation_to_transformation": "graph_edge_t2t", "transformation_to_technical": "graph_edge_t2tech", "table_to_column": "graph_edge_tab2col",
    "report_to_canonical": "graph_edge_report2canonical", "report_to_technical": "graph_edge_report2technical", "report_to_measure": "graph_edge_report2measure", "measure_to_column": "graph_edge_measure2column",
}
LEFT_OUT_LAYERS = ("decision",)
LEFT_OUT_EDGES = ("step_to_decision", "decision_to_column", "decision_to_step", "transformation_to_column")
USES_TABLE = "graph_edge_uses_table"
COLUMNS = {
    "graph_canonical": {"nodeId": "node_id", "metricId": "metric_id", "name": "metric_id", "bareName": "name", "businessName": "business_name", "reportName": "report_name", "reportUrl": "report_url", "description": "description", "steward": "steward", "developer": "developer"},
    "graph_transformation": {"nodeId": "node_id", "name": "name", "metricId": "metric_id", "description": "description", "sqlFragment": "sql_fragment"},
    "graph_technical": {"nodeId": "node_id", "name": "name", "description": "description", "tableName": "table", "schemaName": "schema", "databaseName": "database", "columnName": "column"},
    "graph_report": {"nodeId": "node_id", "name": "name", "description": "description", "repoName": "repo_name", "semanticModelPath": "semantic_model_path"},
    "graph_measure": {"nodeId": "node_id", "name": "name", "description": "description", "reportName": "report_name", "pbiTable": "pbi_table", "daxExpression": "dax_expression", "expressionType": "expression_type"},
}


def _written(rows: DataFrame, kind: str, tables: dict[str, str], left_out: tuple[str, ...], path: str) -> dict[str, int]:
    """Writes ``rows`` by table; rows a table, counted in the same pass. A kind that is neither exported nor left out raises."""
    known = F.create_map(*(F.lit(x) for pair in tables.items() for x in pair))
    table = F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, _: k == F.col(kind))), F.lit(0)), F.raise_error(F.concat(F.lit(f"unknown {kind}: "), F.coalesce(kind, F.lit("null")))).cast("string"))
    left = F.coalesce(F.col(kind).isin(*left_out), F.lit(False))
    seen = Observation()
    counts = [F.count_if(F.col("_table") == t).alias(t) for t in tables.values()]
    placed = rows.withColumn("_table", F.when(left, "").otherwise(table)).observe(seen, F.count("*").alias("all"), F.count_if(F.col("_table") == "").alias("left_out"), *counts)
    placed.where("_table <> ''").write.mode("overwrite").partitionBy("_table").parquet(path)
    found = dict(seen.get)
    spark = rows.sparkSession
    out = spark.read.parquet(path).count() if found["all"] > found["left_out"] else 0
    if out != found["all"] - found["left_out"]:
        raise ValueError(f"{found['all']} rows came in, {found['left_out']} are left out, {out} are in {path}")
    return found


def export(nodes: DataFrame, edges: DataFrame, path: str) -> dict[str, int]:
    """Writes all typed tables under ``path`` and gives the rows of each.

    ``nodes`` is ``(node_id, layer, name, description, properties)``, ``properties`` a map of strings; ``edges`` ``(source_id,
    target_id, edge_type)``. Beside the edges as they stand goes ``graph_edge_uses_table``, each metric and every table it
    ultimately reads, and ``graph_edge_c2t`` holds every step that a metric is calculated by, not only the first ones.
    Layers and edge types that are unknown raise, as does a row that gets lost, or a closure that lacks a root.
    """
    found = _written(nodes, "layer", LAYERS, LEFT_OUT_LAYERS, f"{path}/nodes")
    roots = edges.where(F.col("edge_type") == graph.C2T).select(F.col("source_id").alias("sourceId"), F.col("target_id").alias("targetId"))
    found |= _written(edges, "edge_type", EDGES, LEFT_OUT_EDGES, f"{path}/edges")
    lineage = nodes.select("node_id", F.when((F.col("layer") == "technical") & F.col("properties")["column"].isNotNull() & (F.col("properties")["column"] != ""), "column").otherwise(F.col("layer")).alias("layer"))
    steps = graph.settled(graph.calculated_by(lineage, edges).select(F.col("metric_id").alias("sourceId"), F.col("step_id").alias("targetId")))
    uses = graph.settled(graph.uses_table(lineage, edges).select(F.col("metric_id").alias("sourceId"), F.col("table_id").alias("targetId")))
    lost = roots.join(lineage.where("layer = 'transformation'").select(F.col("node_id").alias("targetId")), "targetId", "left_semi").join(steps, ["sourceId", "targetId"], "left_anti")
    if not lost.isEmpty():
        raise ValueError("the closure lacks a root edge")
    for name, rows in (("graph_edge_c2t", steps), (USES_TABLE, uses)):
        rows.write.mode("overwrite").parquet(f"{path}/derived/{name}")
        found[name] = rows.count()
    return found


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A typed table of an export. Metrics carry the number of their steps and of the tables they read."""
    if name in ("graph_edge_c2t", USES_TABLE):
        return spark.read.parquet(f"{path}/derived/{name}")
    if name in EDGES.values():
        rows = spark.read.parquet(f"{path}/edges").where(F.col("_table") == name)
        return rows.select(F.col("source_id").alias("sourceId"), F.col("target_id").alias("targetId"))
    rows = spark.read.parquet(f"{path}/nodes").where(F.col("_table") == name)
    bare = F.regexp_replace("node_id", "^canonical:", "")
    plain = {"node_id": F.col("node_id"), "name": F.col("name"), "description": F.coalesce("description", F.lit(""))} | ({"metric_id": bare} if name == "graph_canonical" else {})
    out = rows.select(*(plain.get(c, F.coalesce(F.col("properties")[c], F.lit(""))).alias(alias) for alias, c in COLUMNS[name].items()))
    if name != "graph_canonical":
        return out
    steps = table(spark, path, "graph_transformation").groupBy(F.col("metricId")).agg(F.count("*").alias("stepCount"))
    reads = table(spark, path, USES_TABLE).groupBy(F.col("sourceId").alias("nodeId")).agg(F.count("*").alias("tableCount"))
    return out.join(steps, "metricId", "left").join(reads, "nodeId", "left").na.fill(0, ["stepCount", "tableCount"])
