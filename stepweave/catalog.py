"""Every query of the library by name, over stand-ins in the driver's tables, and the SQL that checks it.

The stand-in for the lineage graph: regions are metrics, nations are calculation steps, suppliers are tables and their
parts columns. A region declares its nations; a nation depends on the nation numbered ``(7 k + 3) mod 25`` (which makes
cycles) and reads its suppliers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions import text as tx
from stepweave.operators import algebra, changes, compare, contracts, products, records, search
from stepweave.plans import graph
from stepweave.streaming import events as ev


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def demo_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    region, nation, supplier = (_t(spark, d, x) for x in ("region", "nation", "supplier"))
    rid, nid, sid = (lambda c: F.concat(F.lit("canonical:"), c.cast("string"))), (lambda c: F.concat(F.lit("transform:"), c.cast("string"))), (lambda c: F.concat(F.lit("tech:"), c.cast("string")))
    node = lambda i, layer, name: (i.alias("node_id"), F.lit(layer).alias("layer"), name.alias("name"))
    edge = lambda a, b, kind: (a.alias("source_id"), b.alias("target_id"), F.lit(kind).alias("edge_type"))
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    nodes = region.select(*node(rid(F.col("r_regionkey")), "canonical", F.col("r_name"))).unionByName(nation.select(*node(nid(n), "transformation", F.col("n_name")))).unionByName(supplier.select(*node(sid(s), "technical", F.col("s_name"))))
    columns = _t(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    edges = nation.select(*edge(rid(F.col("n_regionkey")), nid(n), graph.C2T)).unionByName(nation.select(*edge(nid(n), nid((n * 7 + 3) % 25), graph.T2T)))
    edges = edges.unionByName(supplier.select(*edge(nid(F.col("s_nationkey")), sid(s), graph.T2TECH)))
    edges = edges.unionByName(columns.select(*edge(sid(F.col("l_suppkey")), F.concat(F.lit("col:"), F.col("l_partkey").cast("string")), graph.TAB2COL)))
    return nodes, edges


GRAPH_SQL = f"""
nodes AS (
  SELECT 'canonical:' || r_regionkey AS node_id, 'canonical' AS layer, r_name AS name FROM region
  UNION ALL SELECT 'transform:' || n_nationkey, 'transformation', n_name FROM nation
  UNION ALL SELECT 'tech:' || s_suppkey, 'technical', s_name FROM supplier),
edges AS (
  SELECT 'canonical:' || n_regionkey AS source_id, 'transform:' || n_nationkey AS target_id, '{graph.C2T}' AS edge_type FROM nation
  UNION ALL SELECT 'transform:' || n_nationkey, 'transform:' || ((n_nationkey * 7 + 3) % 25), '{graph.T2T}' FROM nation
  UNION ALL SELECT 'transform:' || s_nationkey, 'tech:' || s_suppkey, '{graph.T2TECH}' FROM supplier
  UNION ALL SELECT DISTINCT 'tech:' || l_suppkey, 'col:' || l_partkey, '{graph.TAB2COL}' FROM lineitem),
walk(root, node_id) AS (
  SELECT node_id, node_id FROM nodes WHERE layer = 'canonical'
  UNION SELECT w.root, e.target_id FROM walk w JOIN edges e ON e.source_id = w.node_id WHERE e.edge_type <> '{graph.TAB2COL}'),
uses AS (SELECT w.root AS metric_id, w.node_id AS table_id FROM walk w JOIN nodes n USING (node_id) WHERE n.layer = 'technical')
"""
WITH_GRAPH = "WITH RECURSIVE " + GRAPH_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None):
    def keep(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


# Graph


@_query(WITH_GRAPH + "SELECT metric_id, table_id FROM uses")
def q_tables_of_metric(spark, d):
    return graph.uses_table(*demo_graph(spark, d))


@_query(WITH_GRAPH + "SELECT metric_id FROM uses WHERE table_id = 'tech:7'")
def q_metrics_of_table(spark, d):
    return graph.uses_table(*demo_graph(spark, d)).where("table_id = 'tech:7'").select("metric_id")


@_query(WITH_GRAPH + "SELECT metric_id, count(*) AS tables FROM uses GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def q_most_read_metrics(spark, d):
    return graph.most_read(graph.uses_table(*demo_graph(spark, d)), 3)


@_query(WITH_GRAPH + "SELECT a.metric_id AS a, b.metric_id AS b, count(*) AS shared FROM uses a JOIN uses b USING (table_id) WHERE a.metric_id < b.metric_id GROUP BY 1, 2")
def q_shared_source_metrics(spark, d):
    return graph.shared_sources(graph.uses_table(*demo_graph(spark, d)))


STEPS_SQL = f"""WITH RECURSIVE {GRAPH_SQL},
hops(root, node_id, hop) AS (
  SELECT node_id, node_id, 0 FROM nodes WHERE layer = 'canonical'
  UNION SELECT h.root, e.target_id, h.hop + 1 FROM hops h JOIN edges e ON e.source_id = h.node_id WHERE e.edge_type IN ('{graph.C2T}', '{graph.T2T}') AND h.hop < 30),
steps AS (SELECT root AS metric_id, node_id AS step_id, min(hop) AS hop FROM hops WHERE node_id LIKE 'transform:%' GROUP BY 1, 2)
"""


@_query(STEPS_SQL + "SELECT metric_id, step_id, row_number() OVER (PARTITION BY metric_id ORDER BY hop, step_id)::INTEGER AS step_no FROM steps")
def q_steps_of_metric(spark, d):
    return graph.calculated_by(*demo_graph(spark, d))


@_query(STEPS_SQL + f"SELECT s.metric_id, count(DISTINCT s.step_id) AS steps, count(e.target_id) AS table_edges FROM steps s LEFT JOIN edges e ON e.source_id = s.step_id AND e.edge_type = '{graph.T2TECH}' GROUP BY 1")
def q_validator_walk(spark, d):
    return graph.validator_walk(*demo_graph(spark, d))


@_query(WITH_GRAPH + "SELECT DISTINCT e.target_id AS column_id FROM edges e WHERE e.source_id = 'tech:7' AND e.edge_type = 'table_to_column'")
def q_columns_of_table(spark, d):
    edges = demo_graph(spark, d)[1]
    return edges.where((F.col("source_id") == "tech:7") & (F.col("edge_type") == graph.TAB2COL)).select(F.col("target_id").alias("column_id")).distinct()


@_query(WITH_GRAPH + "SELECT 'node' AS kind, layer AS value, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY 2")
def q_node_counts(spark, d):
    return graph.degree_by_layer(*demo_graph(spark, d))


@_query(WITH_GRAPH + "SELECT DISTINCT source_id, target_id, edge_type FROM edges WHERE source_id NOT IN (SELECT node_id FROM nodes) OR target_id NOT IN (SELECT node_id FROM nodes)")
def q_dangling_edges(spark, d):
    return graph.dangling_edges(*demo_graph(spark, d))


@_query("""WITH RECURSIVE links AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation UNION SELECT (n_nationkey * 7 + 3) % 25, n_nationkey FROM nation),
paths(path, hop) AS (SELECT [1::BIGINT], 0 UNION ALL SELECT list_append(p.path, l.b::BIGINT), p.hop + 1 FROM paths p JOIN links l ON l.a = p.path[len(p.path)] WHERE l.a <> l.b AND NOT list_contains(p.path, l.b) AND p.hop < 6)
SELECT array_to_string(path, '>') AS path FROM paths WHERE hop > 0 AND path[len(path)] IN (2, 10, 17)""")
def q_path_enumeration(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("source_id"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("string").alias("target_id"))
    ends = n.where(F.col("source_id").isin("2", "10", "17")).select(F.col("source_id").alias("node_id"))
    return graph.simple_paths(n, n.where("source_id = '1'").select(F.col("source_id").alias("node_id")), ends, 6).select(F.array_join("path", ">").alias("path"))


# Contracts


@_query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q_unique_violations(spark, d):
    return contracts.unique_violations(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("SELECT upper(c_mktsegment) AS c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def q_unique_violations_folded(spark, d):
    return contracts.unique_violations(_t(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], fold_case=True)


@_query("SELECT o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1")
def q_allowed_values(spark, d):
    return contracts.allowed_violations(_t(spark, d, "orders"), "o_orderstatus", ["F", "O"])


@_query("SELECT l_orderkey AS value, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def q_reference_violations(spark, d):
    return contracts.reference_violations(_t(spark, d, "lineitem"), "l_orderkey", _t(spark, d, "orders").where("o_orderstatus = 'F'"), "o_orderkey")


@_query("SELECT a.n AS left_count, b.n AS right_count, a.n = b.n AS equal FROM (SELECT count(*) AS n FROM orders) a, (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem) b")
def q_count_equals(spark, d):
    return contracts.count_equals(_t(spark, d, "orders"), _t(spark, d, "lineitem").select("l_orderkey").distinct())


# Changes


@_query("""WITH a AS (SELECT o_orderkey, o_orderstatus AS h FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'new' WHEN b.o_orderkey IS NULL THEN 'deleted' WHEN a.h IS NOT DISTINCT FROM b.h THEN 'unchanged' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def q_change_data(spark, d):
    o = _t(spark, d, "orders")
    before = o.where("o_orderkey % 7 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("h"))
    now = o.where("o_orderkey % 11 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("h"))
    return changes.change_data(before, now, "o_orderkey", "h")


@_query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def q_upsert(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_acctbal")
    return changes.upsert(c, c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(-1.0)), "c_custkey")


@_query("""WITH n AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-15'), o AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-05'), g AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-05')
SELECT coalesce(n.user_id, o.user_id) AS user_id, CASE WHEN n.user_id IS NULL THEN 'resolved' WHEN o.user_id IS NOT NULL THEN 'known' WHEN g.user_id IS NOT NULL THEN 'regressed' ELSE 'new' END AS status
FROM n FULL JOIN o ON n.user_id = o.user_id LEFT JOIN g ON g.user_id = coalesce(n.user_id, o.user_id)""")
def q_error_status(spark, d):
    e = _t(spark, d, "events")
    errors = e.where("event_type = 'error'")
    return changes.error_status(errors.where("ts >= timestamp'2024-01-15'"), errors.where("ts < timestamp'2024-01-05'"), e.where("event_type = 'purchase' AND ts < timestamp'2024-01-05'"), "user_id")


@_query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def q_first_wins(spark, d):
    return changes.first_wins(_t(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@_query("SELECT event_id, user_id FROM events WHERE ts = (SELECT max(ts) FROM events)")
def q_latest_run(spark, d):
    return changes.latest_run(_t(spark, d, "events"), "ts").select("event_id", "user_id")


@_query("SELECT conv_id, turn, CASE WHEN k = 1 THEN role ELSE role || '#' || k END AS occurrence FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, upper(role) ORDER BY turn) AS k FROM conversations)")
def q_occurrence_names(spark, d):
    return changes.occurrence_names(_t(spark, d, "conversations"), ["conv_id"], "role", ["turn"]).select("conv_id", "turn", "occurrence")


@_query("SELECT n.c_custkey, CASE WHEN n.c_custkey % 4 <> 0 AND n.c_custkey % 9 <> 0 THEN '2024-01-01' ELSE '2024-02-01' END AS logic_last_changed_at FROM customer n")
def q_freshness(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    old = c.where("c_custkey % 9 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, "other").otherwise(F.col("c_mktsegment"))).withColumn("logic_last_changed_at", F.lit("2024-01-01"))
    return changes.freshness(c, old, "c_custkey", "c_mktsegment", "2024-02-01")


# Products


@_query(r"""SELECT left(sha256(lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')))), 16) AS content_key, count(*) AS members, min(doc_id) AS first_id FROM documents WHERE length(trim(coalesce(text, ''))) > 0 GROUP BY 1""")
def q_content_partition(spark, d):
    return products.content_partition(_t(spark, d, "documents"), "doc_id", "text")


@_query("""SELECT 'documents' AS stage, count(*) AS in_count, count(*) AS out_count, 0::BIGINT AS fell_off FROM documents
UNION ALL SELECT 'labelled', (SELECT count(*) FROM documents), count(*), (SELECT count(*) FROM documents) - count(*) FROM labels
UNION ALL SELECT 'trusted', (SELECT count(*) FROM labels), count(*), (SELECT count(*) FROM labels) - count(*) FROM labels WHERE quality = 1""")
def q_funnel(spark, d):
    labels = _t(spark, d, "labels")
    return products.funnel([("documents", _t(spark, d, "documents")), ("labelled", labels), ("trusted", labels.where("quality = 1"))])


@_query("SELECT lang, count(*) AS total, count(l.doc_id) AS covered, floor(count(l.doc_id) * 100 / count(*))::BIGINT AS percent FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def q_coverage(spark, d):
    joined = _t(spark, d, "documents").select("doc_id", "lang").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return products.coverage(joined, F.col("quality").isNotNull(), "lang")


@_query("SELECT c_custkey, coalesce(o.n, 0) AS orders, coalesce(u.n, 0) AS urgent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) u ON u.o_custkey = c_custkey")
def q_metric_journey(spark, d):
    orders = _t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return products.journey(_t(spark, d, "customer").select("c_custkey"), [("orders", orders), ("urgent", orders.where(F.col("o_orderpriority").startswith("1")))], "c_custkey")


@_query("SELECT event_type, count(DISTINCT user_id) AS owners, count(DISTINCT user_id) = (SELECT count(DISTINCT user_id) FROM events) AS in_all FROM events GROUP BY 1")
def q_set_algebra(spark, d):
    return products.set_algebra(_t(spark, d, "events"), "user_id", "event_type")


@_query("SELECT p_partkey, p_brand, p_retailprice, group_rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS group_rank FROM part) WHERE group_rank <= 2 ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def q_stratified_plurality(spark, d):
    return products.stratified(_t(spark, d, "part"), "p_brand", "p_retailprice", "p_partkey", 2, 10).select("p_partkey", "p_brand", "p_retailprice", "group_rank")


@_query("SELECT s_suppkey, s_name, 'A. Steward' AS steward FROM supplier WHERE contains(lower(s_name), '1')")
def q_steward_by_pattern(spark, d):
    return products.steward_names(_t(spark, d, "supplier"), "s_name", "1", "A. Steward").select("s_suppkey", "s_name", "steward")


# Texts


@_query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])license($|[^a-z0-9])')")
def q_token_mention(spark, d):
    return _t(spark, d, "documents").where(tx.mentions(F.col("text"), "license")).select("doc_id")


@_query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])the($|[^a-z0-9])') AND regexp_matches(lower(text), '(^|[^a-z0-9])license($|[^a-z0-9])')")
def q_all_tokens(spark, d):
    return _t(spark, d, "documents").where(tx.mentions_all(F.col("text"), "The License")).select("doc_id")


# Search


SEARCH_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(e.v, q.v) / sqrt(list_dot_product(e.v, e.v)) / sqrt(list_dot_product(q.v, q.v)) AS closeness FROM v e, v q WHERE q.vec_id % 20 = 0),
near AS (SELECT query_id, vec_id, round(closeness, 6) AS closeness FROM s WHERE closeness >= {least})
SELECT query_id, vec_id, closeness, count(*) OVER (PARTITION BY query_id) AS total_matches FROM near
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY closeness DESC, vec_id) <= 8"""


@_query(SEARCH_SQL.format(least=0.35))
def q_semantic_search(spark, d):
    """At the threshold below which a search refuses to answer."""
    e = _t(spark, d, "embeddings")
    return search.similar_to_each(e, e.where("vec_id % 20 = 0"), "embedding", "vec_id", 0.35, 8)


@_query(SEARCH_SQL.format(least=0.1))
def q_semantic_searches(spark, d):
    e = _t(spark, d, "embeddings")
    return search.similar_to_each(e, e.where("vec_id % 20 = 0"), "embedding", "vec_id", 0.1, 8)


# Comparisons


@_query("SELECT lower(o_orderpriority || ':' || (o_custkey % 100)) AS group_key, count(*) AS member_count, count(DISTINCT o_orderstatus) AS versions, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN 'identical' ELSE 'divergent' END AS verdict FROM orders GROUP BY 1 HAVING count(*) > 1")
def q_twins(spark, d):
    o = _t(spark, d, "orders")
    return compare.twins(o.withColumn("name", F.concat("o_orderpriority", F.lit(":"), (F.col("o_custkey") % 100).cast("string"))), "name", "o_orderstatus")


@_query("WITH r AS (SELECT lower(o_orderpriority) AS term, count(DISTINCT o_custkey) AS reach FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 2) SELECT term, o_orderstatus AS fragment, count(DISTINCT o_custkey) AS owners, any_value(reach) AS reach FROM orders JOIN r ON term = lower(o_orderpriority) GROUP BY 1, 2")
def q_mined_terms(spark, d):
    return compare.mined_terms(_t(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderstatus")


@_query("SELECT o_custkey, count(*) AS members, count(DISTINCT o_orderstatus) AS values, count(DISTINCT o_orderstatus) = 1 AND count(o_orderstatus) = count(*) AS all_equal FROM orders GROUP BY 1")
def q_field_diff(spark, d):
    return compare.field_diff(_t(spark, d, "orders"), "o_custkey", "o_orderstatus")


@_query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'a' WHEN a.k IS NULL THEN 'b' ELSE 'both' END AS side FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40) b ON a.k = b.k")
def q_set_sides(spark, d):
    rows = _t(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return compare.set_sides(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"), ["k"])


@_query("""WITH t AS (SELECT s_nationkey AS g, s_suppkey % 40 AS n, 's' || s_suppkey AS target FROM supplier), f AS (SELECT g, n, min(target) AS target FROM t GROUP BY 1, 2), b AS (SELECT n, min(target) AS target, count(DISTINCT target) AS many FROM t GROUP BY 1)
SELECT c_custkey, coalesce(f.target, b.target) AS target, CASE WHEN f.target IS NOT NULL THEN 'qualified' WHEN b.many = 1 THEN 'bare' WHEN b.many > 1 THEN 'ambiguous' ELSE 'unresolved' END AS how
FROM customer LEFT JOIN f ON f.g = c_nationkey AND f.n = c_custkey % 60 LEFT JOIN b ON b.n = c_custkey % 60""")
def q_tiered_resolution(spark, d):
    targets = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), (F.col("s_suppkey") % 40).alias("n"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("target"))
    refs = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("g"), (F.col("c_custkey") % 60).alias("n"))
    return compare.resolve(refs, targets, "g", "n").select("c_custkey", "target", "how")


@_query(None)
def q_step_alignment(spark, d):
    """Suppliers as steps that read parts: all lines beside those of odd orders, some renamed. Best first has no SQL."""
    lines = _t(spark, d, "lineitem")
    steps = lambda rows: rows.groupBy(F.col("l_suppkey").alias("step")).agg(F.array_sort(F.collect_set("l_partkey")).alias("tables")).withColumn("content", F.when(F.col("step") % 3 == 0, F.concat(F.lit("c"), F.col("step").cast("string"))))
    a = steps(lines).withColumn("name", F.concat(F.lit("S"), F.col("step").cast("string")))
    b = steps(lines.where("l_orderkey % 8 <> 1")).withColumn("name", F.when(F.col("step") % 2 == 0, F.concat(F.lit("s"), F.col("step").cast("string"))))
    return compare.align_steps(a, b)


# Questions


@_query(WITH_GRAPH + "SELECT node_id, layer, name FROM nodes WHERE regexp_matches(lower(name), '(^|[^a-z0-9])asia($|[^a-z0-9])')")
def q_census(spark, d):
    return algebra.census(demo_graph(spark, d)[0], ["name"], "asia zzqq")[0]


@_query(STEPS_SQL + """, named AS (SELECT s.metric_id, s.step_id, n.name, row_number() OVER (PARTITION BY s.metric_id ORDER BY s.hop, s.step_id) AS k FROM steps s JOIN nodes n ON n.node_id = s.step_id),
c AS (SELECT metric_id, count(*) AS transform_count, string_agg(name, ' -> ' ORDER BY k) AS calculation FROM named GROUP BY 1),
u AS (SELECT metric_id, count(DISTINCT table_id) AS table_count, string_agg(DISTINCT n.name, ', ' ORDER BY n.name) AS source_tables FROM uses JOIN nodes n ON n.node_id = table_id GROUP BY 1)
SELECT n.node_id AS metric_id, n.name, coalesce(transform_count, 0) AS transform_count, coalesce(calculation, '') AS calculation, coalesce(table_count, 0) AS table_count, coalesce(source_tables, '') AS source_tables
FROM nodes n LEFT JOIN c ON c.metric_id = n.node_id LEFT JOIN u ON u.metric_id = n.node_id WHERE n.layer = 'canonical'""")
def q_metric_cards(spark, d):
    return algebra.metric_cards(*demo_graph(spark, d))


@_query("""SELECT name, value, threshold, blocking, value >= threshold AS passed FROM (
SELECT 'parse' AS name, coalesce(avg(CASE WHEN text IS NOT NULL THEN 1.0 ELSE 0.0 END), 0) AS value, 0.9::DOUBLE AS threshold, true AS blocking FROM documents
UNION ALL SELECT 'trusted', coalesce(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 0), 0.8::DOUBLE, false FROM labels)""")
def q_readiness_gate(spark, d):
    return algebra.readiness([("parse", _t(spark, d, "documents"), "text IS NOT NULL", 0.9, True), ("trusted", _t(spark, d, "labels"), "quality = 1", 0.8, False)])


@_query("""WITH RECURSIVE hit(kind, id) AS (SELECT 'table', '3' UNION
SELECT e.tk, e.t FROM hit h JOIN (SELECT 'table' AS fk, s_suppkey::VARCHAR AS f, 'job' AS tk, s_nationkey::VARCHAR AS t FROM supplier UNION ALL SELECT 'job', n_nationkey::VARCHAR, 'table', (n_nationkey * 3 + 1)::VARCHAR FROM nation) e ON e.fk = h.kind AND e.f = h.id)
SELECT kind, id FROM hit""")
def q_replan(spark, d):
    reads = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("table"), F.col("s_nationkey").alias("job"))
    writes = _t(spark, d, "nation").select(F.col("n_nationkey").alias("job"), (F.col("n_nationkey") * 3 + 1).alias("table"))
    return algebra.replan(reads.where("table = 3").select("table").distinct(), reads, writes)


@_query("WITH n AS (SELECT DISTINCT source, lang, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS number FROM documents) SELECT source, number FROM n WHERE lang = 'en' EXCEPT SELECT source, number FROM n WHERE lang = 'de'")
def q_ungrounded_numbers(spark, d):
    docs = _t(spark, d, "documents")
    return algebra.ungrounded_numbers(docs.where("lang = 'en'"), docs.where("lang = 'de'"), "source", "text")


@_query("SELECT doc_id, score FROM (SELECT doc_id, contains(lower(text), 'the')::INTEGER + contains(lower(text), 'license')::INTEGER + contains(lower(text), 'data')::INTEGER AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def q_keyword_scores(spark, d):
    return algebra.keyword_scores(_t(spark, d, "documents"), "text", ["the", "License", "data"], "doc_id", 20).select("doc_id", "score")


@_query("SELECT least(l_partkey % 50, l_suppkey % 50) AS a, greatest(l_partkey % 50, l_suppkey % 50) AS b, count(*) AS evidence FROM lineitem WHERE l_partkey % 50 <> l_suppkey % 50 GROUP BY 1, 2")
def q_join_evidence(spark, d):
    return algebra.join_evidence(_t(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("x"), (F.col("l_suppkey") % 50).alias("y")), "x", "y")


@_query("SELECT event_type, count(value) AS n, median(value) AS median FROM events GROUP BY 1")
def q_median_latency(spark, d):
    return algebra.latency(_t(spark, d, "events"), "event_type", "value")


@_query("SELECT o_custkey, o_orderkey, o_orderstatus IS NOT DISTINCT FROM first_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS same_as_first FROM orders")
def q_n_way_diff(spark, d):
    return algebra.first_in_row(_t(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")


# Records


@_query("SELECT CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE lower(s_name) END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'own' ELSE 'vendor' END AS origin, CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END AS place FROM supplier")
def q_dictionary_merge(spark, d):
    s = _t(spark, d, "supplier")
    own = s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("name"), F.lit("own").alias("origin"))
    return records.merge_dictionaries([own, s.select(F.lower("s_name").alias("name"), F.lit("vendor").alias("origin"), F.col("s_nationkey").alias("place"))], "name")


@_query("SELECT upper(c_mktsegment) AS name, string_agg(DISTINCT c_nationkey::VARCHAR, ',' ORDER BY c_nationkey::VARCHAR) AS schemas FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1")
def q_schema_collisions(spark, d):
    return records.schema_collisions(_t(spark, d, "customer"), "c_mktsegment", "c_nationkey")


@_query("SELECT count(*) AS total, count(s_suppkey) AS covered, count(s_suppkey) / count(*) AS fraction FROM (SELECT DISTINCT l_suppkey FROM lineitem) LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0) ON s_suppkey = l_suppkey")
def q_dictionary_coverage(spark, d):
    known = _t(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return records.dictionary_coverage(_t(spark, d, "lineitem"), known, "l_suppkey")


@_query("SELECT l_orderkey, count(*) AS leaves, count(*) - count(s_suppkey) AS missing, CASE WHEN count(*) = count(s_suppkey) THEN 'grounded' ELSE 'fallout' END AS verdict FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0) ON s_suppkey = l_suppkey GROUP BY 1")
def q_leaf_grounding(spark, d):
    known = _t(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return records.leaf_grounding(_t(spark, d, "lineitem"), known, "l_orderkey", "l_suppkey")


@_query("""WITH r AS (SELECT o_custkey AS k, o_orderkey % 25 AS h, o_orderstatus AS s FROM orders)
SELECT c_custkey AS k, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.k = c_custkey AND r.h = c_nationkey AND r.s = 'F') THEN 'reuse' WHEN EXISTS (SELECT 1 FROM r WHERE r.k = c_custkey AND r.s = 'O') THEN 'retry' ELSE 'generate' END AS plan FROM customer""")
def q_generation_plan(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "rejected").otherwise("failed")
    made = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 25).alias("h"), status.alias("status"))
    return records.generation_plan(_t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("h")), made, "k", "h", "status")


@_query("WITH e AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN date_diff('day', ts::DATE, DATE '2024-02-01') END AS age_days FROM events) SELECT event_id, age_days, CASE WHEN age_days IS NULL THEN 'unknown' WHEN age_days > 14 THEN 'stale' ELSE 'fresh' END AS state FROM e")
def q_staleness(spark, d):
    e = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.col("ts").cast("string")).alias("stamp"))
    return records.staleness(e, "event_id", "stamp", "2024-02-01", 14)


@_query("""WITH r AS (SELECT l_orderkey % 50 AS step, CASE WHEN l_linenumber % 3 <> 0 THEN 'A' || (l_suppkey % 5) END AS q, CASE WHEN l_partkey % 20 <> 19 THEN 'C' || (l_partkey % 20) END AS c, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
t AS (SELECT DISTINCT s_suppkey % 40 AS step, 'A' || (s_suppkey % 4) AS a, 'T' || (s_suppkey % 7) AS tab FROM supplier), c AS (SELECT DISTINCT 'T' || (n_nationkey % 7) AS tab, 'C' || (n_nationkey % 20) AS col FROM nation),
x AS (SELECT r.step, q, r.c, n, count(t.tab) AS tabs, count(DISTINCT c.tab) AS hits, min(c.tab) AS one FROM r LEFT JOIN t ON t.step = r.step AND (q IS NULL OR q = t.a) LEFT JOIN c ON c.tab = t.tab AND c.col = r.c GROUP BY 1, 2, 3, 4),
y AS (SELECT *, CASE WHEN hits = 1 THEN one || '.' || c END AS target FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY step, target ORDER BY q NULLS FIRST) AS k FROM y),
o AS (SELECT *, CASE WHEN c IS NULL THEN 'no_column_name' WHEN q IS NOT NULL AND tabs = 0 THEN 'unresolved_qualifier' WHEN hits = 0 THEN 'no_dictionary_column' WHEN hits > 1 THEN 'ambiguous' WHEN k > 1 THEN 'duplicate' ELSE 'minted' END AS outcome FROM z)
SELECT step, q AS qualifier, c AS column_name, n, (outcome = 'minted')::INTEGER AS minted, outcome, target FROM o""")
def q_projection_edges(spark, d):
    named = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    line, sup, nat = F.col("l_linenumber"), F.col("s_suppkey"), F.col("n_nationkey")
    refs = _t(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("step"), F.when(line % 3 != 0, named("a", F.col("l_suppkey") % 5)).alias("qualifier"), F.when(F.col("l_partkey") % 20 != 19, named("c", F.col("l_partkey") % 20)).alias("column_name"))
    tables = _t(spark, d, "supplier").select((sup % 40).alias("step"), named("A", sup % 4).alias("alias"), named("t", sup % 7).alias("table"))
    return records.projection_edges(refs, tables, _t(spark, d, "nation").select(named("T", nat % 7).alias("table"), named("c", nat % 20).alias("column_name")))


@_query("""WITH a AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS g FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS g FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT * FROM (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'missing' WHEN a.o_custkey IS NULL THEN 'extra' WHEN a.g <> b.g THEN 'grouping' END AS difference FROM a FULL JOIN b ON a.o_custkey = b.o_custkey) WHERE difference IS NOT NULL""")
def q_fact_diff(spark, d):
    o = _t(spark, d, "orders").withColumn("g", F.col("o_orderstatus") == "F")
    return records.fact_diff(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), "o_custkey", "g")


@_query("SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'both' ELSE 'neither' END AS problem FROM customer WHERE c_custkey % 10 <> 0 AND (c_custkey % 6 = 0 OR c_custkey % 6 IN (1, 5)) UNION ALL SELECT c_custkey, 'unknown' FROM customer WHERE c_custkey % 10 = 0 AND (c_custkey % 2 = 0 OR c_custkey % 3 = 0)")
def q_cover_gaps(spark, d):
    c = _t(spark, d, "customer").select("c_custkey")
    return records.cover_gaps(c.where("c_custkey % 10 <> 0"), c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0"), "c_custkey")


@_query("SELECT source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.lang = 'de' AND c.source = d.source AND c.n_chars > 8000) GROUP BY 1")
def q_undeclared(spark, d):
    docs = _t(spark, d, "documents")
    return records.undeclared(docs, "source", docs.where("lang = 'de' AND n_chars > 8000"))


@_query("WITH e AS (SELECT event_type, ts::DATE AS run, user_id % 10 AS code FROM events) SELECT event_type, code, count(*) AS n FROM e WHERE run = (SELECT max(run) FROM e f WHERE f.event_type = e.event_type) GROUP BY 1, 2")
def q_fallout_reasons(spark, d):
    e = _t(spark, d, "events").select("event_type", F.col("ts").cast("date").alias("run"), (F.col("user_id") % 10).alias("code"))
    return records.fallout_reasons(e, "event_type", "run", "code")


@_query("SELECT DISTINCT 'filters' AS relation, l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT DISTINCT 'selects', l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.08")
def q_column_usage(spark, d):
    rows = _t(spark, d, "lineitem")
    return records.column_usage(rows.where("l_quantity > 45"), rows.where("l_discount > 0.08"), "l_partkey", "l_suppkey")


@_query("SELECT p_partkey, concat_ws(' | ', nullif(trim(p_name), ''), CASE WHEN p_size % 2 = 0 THEN nullif(trim(p_brand), '') END, p_size::VARCHAR) AS document FROM part")
def q_catalog_documents(spark, d):
    return records.catalog_documents(_t(spark, d, "part"), "p_partkey", [F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit(" ")), F.col("p_size")])


@_query("""WITH l AS (SELECT o_custkey AS k, count(DISTINCT o_orderkey % 3) AS n, min(o_orderkey % 3) AS m FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1)
SELECT c_custkey, CASE WHEN n = 1 AND m <> 2 THEN m END AS metric, CASE WHEN n IS NULL THEN 'no_link' WHEN n > 1 THEN 'many_links' WHEN m = 2 THEN 'no_description' ELSE 'matched' END AS outcome FROM customer LEFT JOIN l ON k = c_custkey""")
def q_report_matches(spark, d):
    links = _t(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 3).alias("metric"))
    cards = _t(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("metric"), F.when(F.col("r_regionkey") != 2, F.col("r_name")).alias("description"))
    return records.report_matches(_t(spark, d, "customer"), links, cards, "c_custkey", "metric", "description")


# Events


@_query("SELECT date_trunc('day', ts) AS window_start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_windowed_counts(spark, d):
    return ev.windowed_counts(_t(spark, d, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@_query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_type = 'click'")
def q_event_properties(spark, d):
    return _t(spark, d, "events").where("event_type = 'click'").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@_query("SELECT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE ts < TIMESTAMP '2024-01-03') GROUP BY 1, 2")
def q_idempotent_ingest(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_type", "ts")
    return ev.new_events(e.where("ts >= timestamp'2024-01-20'"), e.where("ts < timestamp'2024-01-03'"), ("user_id", "event_type")).select("user_id", "event_type")


# Analytical reports over the star schema


@_query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def q_pricing_summary(spark, d):
    rows = _t(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@_query("SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def q_revenue_by_region(spark, d):
    t = lambda n: _t(spark, d, n)
    joined = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


from stepweave import catalog_checks, catalog_governance, catalog_privacy, catalog_wiring  # noqa: E402, F401  (their queries register themselves here)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
