"""Queries over lookups, stewardship, decisions, summaries and texts, with their SQL; ``catalog`` registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepweave.catalog import WITH_GRAPH, _query, _t, demo_graph
from stepweave.functions import text as tx
from stepweave.operators import changes, governance, lookups, privacy, records
from stepweave.plans import graph
from stepweave.streaming import events as ev


def _id(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# Lookups


@_query(WITH_GRAPH + "SELECT node_id, name FROM nodes WHERE upper(name) = 'EUROPE'")
def q_named_nodes(spark, d):
    return lookups.named(demo_graph(spark, d)[0], ["name"], " [europe] ").select("node_id", "name")


@_query("""WITH r AS (SELECT p_partkey, lower(p_name) = 'hot gear' AS same FROM part WHERE lower(p_name) = 'hot gear' OR (regexp_matches(lower(p_name), '(^|[^a-z0-9])hot($|[^a-z0-9])') AND regexp_matches(lower(p_name), '(^|[^a-z0-9])gear($|[^a-z0-9])')))
SELECT p_partkey FROM r WHERE same OR NOT (SELECT bool_or(same) FROM r)""")
def q_exact_scope(spark, d):
    return lookups.exact_else_token(_t(spark, d, "part"), "p_name", "Hot Gear").select("p_partkey")


@_query("SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), '(^|[^a-z0-9])gear($|[^a-z0-9])')")
def q_token_scope(spark, d):
    return lookups.exact_else_token(_t(spark, d, "part"), "p_name", "gear").select("p_partkey")


@_query("SELECT 'decision:' || o_custkey || ':' || o_orderkey AS node_id FROM orders WHERE o_custkey = 7")
def q_decisions_of(spark, d):
    nodes = _t(spark, d, "orders").select(F.concat(_id("decision:", "o_custkey"), F.lit(":"), F.col("o_orderkey").cast("string")).alias("node_id"))
    return lookups.of_owner(nodes, "decision", "7")


@_query(WITH_GRAPH + "SELECT node_id, layer, name FROM nodes WHERE node_id IN (SELECT 'tech:' || s_suppkey FROM supplier WHERE s_acctbal < 0)")
def q_node_cards(spark, d):
    return lookups.cards(demo_graph(spark, d)[0], _t(spark, d, "supplier").where("s_acctbal < 0").select(_id("tech:", "s_suppkey").alias("node_id")), "layer", "name")


@_query(WITH_GRAPH + "SELECT node_id FROM nodes WHERE layer = 'canonical' OR contains('what of transform:12 and more', lower(node_id))")
def q_permitted_nodes(spark, d):
    nodes = demo_graph(spark, d)[0]
    return lookups.permitted(nodes, nodes.where("layer = 'canonical'"), "What of TRANSFORM:12 and more").select("node_id")


@_query("SELECT event_id::VARCHAR AS node_id, event_type AS name, coalesce(json_extract_string(props, '$.k')::BIGINT, NULL) AS k, coalesce(json_extract_string(props, '$.note'), '') AS note FROM events WHERE event_type = 'view'")
def q_node_table(spark, d):
    nodes = _t(spark, d, "events").select(F.col("event_id").cast("string").alias("node_id"), F.col("event_type").alias("layer"), F.col("event_type").alias("name"), F.col("props").alias("properties"))
    return lookups.node_tables(nodes, "view", "k bigint, note string")


@_query(WITH_GRAPH + "SELECT source_id, target_id FROM edges WHERE edge_type = 'transformation_to_technical'")
def q_edge_table(spark, d):
    return lookups.edge_tables(demo_graph(spark, d)[1], [graph.C2T, graph.T2T, graph.T2TECH], [graph.TAB2COL])[graph.T2TECH]


@_query("SELECT 'tech:' || s_suppkey AS node_id, s_name AS name, coalesce(string_agg(DISTINCT p_name, ', ' ORDER BY p_name), '') AS columns FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_discount > 0.09 LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def q_table_records(spark, d):
    tables = _t(spark, d, "supplier").select(_id("tech:", "s_suppkey").alias("node_id"), F.col("s_name").alias("name"))
    edges = _t(spark, d, "lineitem").where("l_discount > 0.09").select(_id("tech:", "l_suppkey").alias("source_id"), _id("col:", "l_partkey").alias("target_id")).distinct()
    return lookups.table_records(tables, edges, _t(spark, d, "part").select(_id("col:", "p_partkey").alias("node_id"), F.col("p_name").alias("name")))


@_query(WITH_GRAPH + "SELECT e.target_id AS from_id, e.edge_type, n.node_id, n.name FROM edges e JOIN nodes n ON n.node_id = e.source_id WHERE e.edge_type IN ('canonical_to_transformation', 'transformation_to_technical')")
def q_linked_back(spark, d):
    return lookups.linked(*demo_graph(spark, d), [graph.C2T, graph.T2TECH], backwards=True)


@_query("SELECT c_custkey, coalesce(m, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS m FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def q_updated_column(spark, d):
    new = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("c_mktsegment"))
    return lookups.updated(_t(spark, d, "customer").select("c_custkey", "c_mktsegment"), new, "c_custkey", "c_mktsegment")


@_query("SELECT 'n' || c_custkey AS node_id, CASE WHEN c_acctbal < 0 THEN c_name WHEN c_nationkey < 10 THEN c_mktsegment END AS text FROM customer")
def q_comparable_texts(spark, d):
    c = _t(spark, d, "customer").withColumn("node_id", _id("n", "c_custkey"))
    return lookups.comparable_texts(c, c.where("c_acctbal < 0").select("node_id", F.col("c_name").alias("fragment")), c.where("c_nationkey < 10").select("node_id", F.col("c_mktsegment").alias("calculation")))


@_query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#3' THEN 'meaning' ELSE 'name' END AS how FROM part WHERE p_brand = 'Brand#3' OR contains(lower(p_name), 'gear')")
def q_search_union(spark, d):
    part = _t(spark, d, "part")
    return lookups.with_contained(part.where("p_brand = 'Brand#3'"), part, "p_partkey", "p_name", "Gear")


@_query("WITH w AS (SELECT DISTINCT l_orderkey AS s, l_suppkey AS t, l_returnflag AS f FROM lineitem) SELECT DISTINCT s AS source_id, t AS target_id FROM w WHERE (s, t) NOT IN (SELECT (s, t) FROM w WHERE f <> 'R')")
def q_missing_roots(spark, d):
    edges = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), "l_returnflag")
    return lookups.missing_roots(edges, edges.where("l_returnflag <> 'R'").select(F.col("source_id").alias("root"), F.col("target_id").alias("node_id")).distinct())


@_query("SELECT 'a/' || c_nationkey || '/' || c_mktsegment || '/' || c_custkey AS path, CASE WHEN c_nationkey < 5 THEN 'a/' || c_nationkey WHEN c_mktsegment = 'BUILDING' THEN 'a/' || c_nationkey || '/BUILDING' END AS or_root FROM customer")
def q_or_groups(spark, d):
    c = _t(spark, d, "customer").withColumn("nation", _id("a/", "c_nationkey"))
    segment = F.concat_ws("/", "nation", "c_mktsegment")
    roots = c.where("c_nationkey < 5").select(F.col("nation").alias("path")).unionByName(c.where("c_mktsegment = 'BUILDING'").select(segment.alias("path")))
    return lookups.or_groups(c.select(F.concat_ws("/", segment, F.col("c_custkey").cast("string")).alias("path")), roots)


@_query("""WITH RECURSIVE s AS (SELECT s_suppkey AS step FROM supplier), e AS (SELECT a.step, b.step AS o FROM s a JOIN s b ON b.step IN (a.step // 2, a.step // 3) AND b.step < a.step),
r(step, depth) AS (SELECT step, 0 FROM s UNION SELECT e.step, r.depth + 1 FROM r JOIN e ON e.o = r.step), m AS (SELECT step, max(depth) AS depth FROM r GROUP BY 1)
SELECT step, depth, row_number() OVER (ORDER BY depth, step) AS place FROM m""")
def q_step_order(spark, d):
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("step"))
    depends = s.select("step", F.explode(F.array(F.floor(F.col("step") / 2), F.floor(F.col("step") / 3))).alias("on")).join(s.select(F.col("step").alias("on")), "on", "left_semi").where("on < step").distinct()
    return lookups.step_order(s, depends)


@_query("""WITH k AS (SELECT key, unnest(string_split(lower(key), ' ')) AS w FROM (SELECT DISTINCT p_type || ' ' || split_part(p_name, ' ', 1) AS key FROM part)), n AS (SELECT name, unnest(string_split(lower(name), ' ')) AS v FROM (SELECT DISTINCT p_name AS name FROM part)),
t AS (SELECT key, count(DISTINCT w) AS words FROM k GROUP BY 1),
h AS (SELECT key, name, count(DISTINCT w) AS held FROM k JOIN n ON w = v OR (length(w) >= 3 AND length(v) >= 3 AND (contains(w, v) OR contains(v, w))) GROUP BY 1, 2),
s AS (SELECT h.key, name, held / words AS score FROM h JOIN t USING (key) WHERE held / words >= 0.5)
SELECT key, name, score FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, name) = 1""")
def q_fuzzy_matches(spark, d):
    part = _t(spark, d, "part")
    keys = part.select(F.concat_ws(" ", "p_type", F.split_part("p_name", F.lit(" "), F.lit(1))).alias("key"))
    return lookups.fuzzy_matches(keys, part.select(F.col("p_name").alias("name")))


@_query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type || CASE WHEN event_id % 3 = 0 THEN 's' ELSE '' END WHEN event_type = 'error' THEN 'error' END AS kind FROM events")
def q_kinds(spark, d):
    """Kinds of which some are known with their s, some without."""
    words = F.concat(F.lit(" "), F.initcap("event_type"), F.when((F.col("event_id") % 3 == 0) | (F.col("event_type") == "error"), "s").otherwise(""))
    return _t(spark, d, "events").select("event_id", lookups.kind_of(words, ["click", "clicks", "view", "views", "error"]).alias("kind"))


@_query("SELECT DISTINCT l_orderkey AS owner, 'T' || l_suppkey AS leaf FROM lineitem WHERE l_linenumber < 4")
def q_physical_leaves(spark, d):
    name = F.when(F.col("l_linenumber") < 4, _id("t", "l_suppkey")).otherwise(_id("#t", "l_suppkey"))
    steps = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("owner")).agg(F.collect_list(name).alias("tables"))
    return lookups.physical_leaves(steps, "owner", "tables")


@_query("SELECT s_suppkey, s_name FROM supplier ORDER BY upper(s_name), s_suppkey LIMIT 15")
def q_table_catalog(spark, d):
    return _t(spark, d, "supplier").select("s_suppkey", "s_name").orderBy(F.upper("s_name"), "s_suppkey").limit(15)


@_query("SELECT r_regionkey, r_name FROM region WHERE lower(r_name) IN ('asia', 'europe')")
def q_lexical_hits(spark, d):
    return lookups.lexical_hits(_t(spark, d, "region"), "r_name", "Which parts go from Asia to Europe, if any?")


# Stewardship, decisions, summaries


@_query("""WITH d AS (SELECT o_custkey AS metric, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'where' WHEN '2' THEN 'having' WHEN '3' THEN 'join_on' ELSE 'select' END AS context, 'S' || (o_orderkey % 5) AS step, o_orderkey AS site,
'b.CUST_ID = <ID> AND o.TOTAL > ' || floor(o_totalprice / 7)::BIGINT || ' AND o.PLACED < <DATE>' AS expression FROM orders WHERE o_orderstatus <> 'P'),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY step, site) AS k, count(*) OVER (PARTITION BY metric) AS n FROM d WHERE context <> 'select')
SELECT metric, any_value(n) AS decisions, string_agg(step || ' [' || context || ']: ' || expression, chr(10) ORDER BY k) FILTER (WHERE k <= 3) || CASE WHEN any_value(n) > 3 THEN chr(10) || '(+' || (any_value(n) - 3) || ' more decision sites ' || chr(8212) || ' see graph_decision_sites)' ELSE '' END AS lines FROM r GROUP BY 1""")
def q_decision_summary(spark, d):
    first = F.substr("o_orderpriority", F.lit(1), F.lit(1))
    context = F.when(first == "1", "where").when(first == "2", "having").when(first == "3", "join_on").otherwise("select")
    total = F.floor(F.col("o_totalprice") / 7).cast("string")
    expression = F.concat(F.lit(" b.CUST_ID  = "), (F.col("o_custkey") + 70_000_000).cast("string"), F.lit("\t AND o.TOTAL > "), total, F.lit(" AND o.PLACED < '"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("'"))
    status = F.when(F.col("o_orderstatus") != "P", "extracted").otherwise("failed")
    named = [F.col("o_custkey").alias("metric"), F.concat(F.lit("S"), (F.col("o_orderkey") % 5).cast("string")).alias("step"), F.col("o_orderkey").alias("site")]
    return governance.decision_summary(_t(spark, d, "orders").select(*named, status.alias("status"), context.alias("context"), expression.alias("expression")), 3)


@_query("WITH c AS (SELECT l_orderkey, count(*) AS predicates FROM lineitem GROUP BY 1) SELECT l_orderkey, predicates, (SELECT count(*) FROM c) AS total FROM c ORDER BY predicates DESC, l_orderkey LIMIT 12")
def q_top_decisions(spark, d):
    return governance.top_decisions(_t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("predicates")), "predicates", "l_orderkey")


@_query("""SELECT p_partkey FROM (SELECT p_partkey, upper(trim(CASE p_size % 4 WHEN 0 THEN '_Final_' || p_size WHEN 1 THEN ' cte' || p_size WHEN 2 THEN substr(p_name, 1, p_size % 7) ELSE p_name END)) AS t FROM part)
WHERE length(t) >= 4 AND lower(trim(t, '_0123456789')) NOT IN ('final_select', 'final', 'finaldata', 'main', 'base', 'temp', 'tmp', 'cte', 'data', 'result', 'results', 'output')""")
def q_term_candidates(spark, d):
    size, kind = F.col("p_size").cast("string"), F.col("p_size") % 4
    name = F.when(kind == 0, F.concat(F.lit("_Final_"), size)).when(kind == 1, F.concat(F.lit(" cte"), size)).when(kind == 2, F.substr("p_name", F.lit(1), F.col("p_size") % 7)).otherwise(F.col("p_name"))
    return governance.term_candidates(_t(spark, d, "part").withColumn("term", name), "term").select("p_partkey")


_STEWARDS = "a AS (SELECT o_custkey AS k, min(o_orderpriority) AS steward FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"


def _stewards(spark, d):
    return _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("steward"))


@_query(f"WITH {_STEWARDS} SELECT c_custkey, steward FROM customer LEFT JOIN a ON k = c_custkey")
def q_stewards(spark, d):
    return governance.with_stewards(_t(spark, d, "customer").select("c_custkey"), _stewards(spark, d), "c_custkey")


@_query(f"WITH {_STEWARDS} SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT k FROM a)")
def q_unassigned(spark, d):
    return governance.unassigned(_t(spark, d, "customer"), _stewards(spark, d), "c_custkey")


@_query("SELECT o_custkey AS c_custkey, o_orderpriority AS steward FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def q_assignments_of(spark, d):
    return governance.assignments_of(_stewards(spark, d), "1-urgent")


@_query("""SELECT (SELECT count(*) FROM customer) AS total, count(DISTINCT o_custkey) AS assigned, (SELECT count(*) FROM customer) - count(DISTINCT o_custkey) AS unassigned, count(DISTINCT o_orderpriority) AS stewards,
count(DISTINCT nullif(trim(o_orderpriority, '0123456789-'), 'LOW')) AS departments, count(DISTINCT o_custkey) * 100 // (SELECT count(*) FROM customer) AS percent FROM orders WHERE o_orderstatus = 'F'""")
def q_steward_coverage(spark, d):
    bare = F.regexp_replace("steward", "^[0-9-]+", "")
    given = _stewards(spark, d).withColumn("department", F.when(bare != "LOW", bare).otherwise(""))
    return governance.steward_coverage(_t(spark, d, "customer"), given, "c_custkey")


@_query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'error') AS error FROM events")
def q_validation_summary(spark, d):
    return governance.validation_summary(_t(spark, d, "events"), "event_type", ("click", "view", "error"))


@_query("SELECT l_returnflag AS target, count(*) AS total, count(*) FILTER (WHERE l_linenumber = 1) AS succeeded, count(*) FILTER (WHERE l_linenumber = 2) AS skipped, count(*) FILTER (WHERE l_linenumber > 2) AS failed FROM lineitem GROUP BY 1")
def q_publish_tallies(spark, d):
    status = F.when(F.col("l_linenumber") == 1, "succeeded").when(F.col("l_linenumber") == 2, "skipped").otherwise("failed")
    return governance.tallies(_t(spark, d, "lineitem").select(F.col("l_returnflag").alias("target"), status.alias("status")), "target", "status")


@_query("""WITH t AS (SELECT DISTINCT user_id FROM events), n AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-15'), o AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-05'), g AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-05')
SELECT (SELECT count(*) FROM t) AS total, (SELECT count(*) FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-15') AS errors, (SELECT count(*) FROM t) - (SELECT count(*) FROM n) AS success_count, round(((SELECT count(*) FROM t) - (SELECT count(*) FROM n)) * 100.0 / (SELECT count(*) FROM t), 1) AS success_rate,
(SELECT count(*) FROM n WHERE user_id NOT IN (FROM o) AND user_id NOT IN (FROM g)) AS new, (SELECT count(*) FROM n WHERE user_id IN (FROM o)) AS known, (SELECT count(*) FROM n WHERE user_id NOT IN (FROM o) AND user_id IN (FROM g)) AS regressed, (SELECT count(*) FROM o WHERE user_id NOT IN (FROM n)) AS resolved""")
def q_run_summary(spark, d):
    e = _t(spark, d, "events")
    errors = e.where("event_type = 'error'")
    now, before = errors.where("ts >= timestamp'2024-01-15'"), errors.where("ts < timestamp'2024-01-05'")
    return governance.run_summary(e, now, changes.error_status(now, before, e.where("event_type = 'purchase' AND ts < timestamp'2024-01-05'"), "user_id"), "user_id")


@_query("SELECT o_orderpriority AS kind, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def q_error_summary(spark, d):
    return governance.error_summary(_t(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status")), "kind", "status")


@_query("SELECT l_suppkey, max(l_extendedprice) AS lines FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def q_largest_failing(spark, d):
    return governance.largest_failing(_t(spark, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("lines")), "l_suppkey", "lines")


@_query("""WITH p AS (SELECT l_orderkey AS owner, l_linenumber AS s, CASE WHEN l_linenumber % 5 <> 0 THEN l_suppkey END AS a, CASE WHEN l_linenumber % 4 <> 0 THEN l_partkey END AS b, l_quantity > 10 AS same FROM lineitem)
SELECT owner, count(*) AS steps, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS missing, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND NOT same) AS divergent, count(*) FILTER (WHERE a IS NULL OR b IS NULL OR NOT same) = 0 AS identical FROM p GROUP BY 1""")
def q_diff_verdicts(spark, d):
    line = F.col("l_linenumber")
    pairs = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.when(line % 5 != 0, F.col("l_suppkey")).alias("a"), F.when(line % 4 != 0, F.col("l_partkey")).alias("b"), (F.col("l_quantity") > 10).alias("same"))
    return governance.diff_verdicts(pairs, "owner")


@_query("""SELECT o_custkey, o_orderkey, coalesce(f, '2024-02-01') AS first_seen, coalesce(s, 'open') AS disposition FROM orders LEFT JOIN (SELECT c_custkey, '2024-01-01' AS f, c_mktsegment AS s FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey WHERE o_orderstatus = 'P'""")
def q_carried_findings(spark, d):
    earlier = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("2024-01-01").alias("first_seen"), F.col("c_mktsegment").alias("disposition"))
    return governance.carried(_t(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey"), earlier, "o_custkey", "2024-02-01")


@_query("""WITH s AS (SELECT l_orderkey AS report, 'rep.S' || l_suppkey AS metric, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2), k AS (SELECT 'rep.s' || s_suppkey AS k FROM supplier WHERE s_acctbal > 3000)
SELECT report, count(*) AS sources, count(k) AS in_corpus, CASE WHEN count(k) = 0 THEN 'lineage_outside_corpus' WHEN count(k) < count(*) THEN 'lineage_partial_corpus' ELSE 'lineage_in_corpus' END AS tie_kind,
string_agg(metric, '; ' ORDER BY pos, metric) AS names FROM s LEFT JOIN k ON k = lower(metric) GROUP BY 1""")
def q_report_journey(spark, d):
    sources = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("report"), F.col("l_linenumber").alias("pos"), _id("rep.S", "l_suppkey").alias("metric"))
    return governance.report_journey(sources, _t(spark, d, "supplier").where("s_acctbal > 3000").select(_id("REP.s", "s_suppkey").alias("metric")))


@_query("""WITH r AS (SELECT DISTINCT l_orderkey AS report, 'T' || (l_suppkey % 30) AS "table", 'C' || (l_partkey % 20) AS column_name FROM lineitem), s AS (SELECT o_orderkey, 'T' || (o_custkey % 30) AS t, 'P' || (o_custkey % 7) AS p FROM orders), c AS (SELECT DISTINCT 'P' || (n_nationkey % 7) AS p, 'C' || (n_nationkey % 20) AS c FROM nation)
SELECT report, "table", column_name, CASE WHEN s.p IS NULL THEN 'no_source' WHEN c.p IS NULL THEN 'no_column' ELSE 'wired' END AS outcome FROM r LEFT JOIN s ON s.o_orderkey = report AND s.t = "table" LEFT JOIN c ON c.p = s.p AND c.c = column_name""")
def q_consumption(spark, d):
    mod = lambda prefix, column, n: F.concat(F.lit(prefix), (F.col(column) % n).cast("string"))
    refs = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("report"), mod("t", "l_suppkey", 30).alias("table"), mod("c", "l_partkey", 20).alias("column_name"))
    sources = _t(spark, d, "orders").select(F.col("o_orderkey").alias("report"), mod("T", "o_custkey", 30).alias("table"), mod("p", "o_custkey", 7).alias("physical"))
    return governance.consumption(refs, sources, _t(spark, d, "nation").select(mod("P", "n_nationkey", 7).alias("physical"), mod("C", "n_nationkey", 20).alias("column_name")))


@_query("SELECT 'd' || o_orderkey AS node_id, coalesce(string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand), '') AS columns FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1")
def q_decision_columns(spark, d):
    edges = _t(spark, d, "lineitem").select(_id("d", "l_orderkey").alias("source_id"), _id("col:", "l_partkey").alias("target_id"))
    columns = _t(spark, d, "part").select(_id("col:", "p_partkey").alias("node_id"), F.col("p_brand").alias("name"))
    return governance.decision_columns(_t(spark, d, "orders").select(_id("d", "o_orderkey").alias("node_id")), edges, columns)


@_query("SELECT c_custkey AS item, c_mktsegment AS target, c_acctbal > 0 AS status, 'r1' AS run_id FROM customer")
def q_publish_log(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("target"), (F.col("c_acctbal") > 0).alias("status"))
    return governance.publish_log(c, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "r1")


@_query("SELECT DISTINCT o_orderpriority AS term, o_custkey AS node_id FROM orders")
def q_term_links(spark, d):
    terms = _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("term"), F.pmod("o_custkey", F.lit(64)).alias("part")).agg(F.collect_set("o_custkey").alias("links"))
    return governance.term_records(terms)[1]


@_query("""SELECT n_name AS contract, CASE WHEN s.k IS NOT NULL THEN 'present' WHEN n_nationkey % 2 = 0 THEN 'absent' ELSE 'blocking' END AS state
FROM nation LEFT JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 8000) s ON s.k = n_nationkey WHERE n_nationkey % 5 <> 0 AND n_regionkey <> 2""")
def q_setup_rows(spark, d):
    """Nations are contracts that their region owns; those of rich suppliers exist."""
    nation, key = _t(spark, d, "nation"), F.col("n_nationkey")
    optional = F.when(key % 2 == 0, F.array(F.lit("search"))).otherwise(F.array().cast("array<string>"))
    owner = F.when(F.col("n_regionkey") == 2, "search").otherwise("build")
    registry = nation.select(F.col("n_name").alias("contract"), owner.alias("owner"), (key % 5 != 0).alias("active"), F.array(F.lit("search"), F.lit("export")).alias("consumers"), optional.alias("optional"))
    have = _t(spark, d, "supplier").where("s_acctbal > 8000").join(nation, F.col("s_nationkey") == key).select(F.col("n_name").alias("contract"))
    return governance.setup_rows(governance.required_inputs(registry, "search"), have)


@_query("SELECT DISTINCT event_type AS kind FROM events WHERE event_type NOT IN ('click', 'view')")
def q_unreachable_kinds(spark, d):
    return governance.unreachable_kinds(_t(spark, d, "events").select(F.col("event_type").alias("kind")), spark.createDataFrame([("click",), ("view",)], "kind string"))


_CALLS = {"click": "get_facts", "view": "list_steps", "purchase": "check_same_logic", "signup": "search", "error": "search"}
_ANSWERS = ("Both use the SAME LOGIC", "I COULDN'T FIND it", "The two differ, and one is not available", "It is 7", "the only metric")


@_query("""WITH c AS (SELECT user_id * 40 + event_id % 40 AS turn, user_id, CASE event_type WHEN 'click' THEN 'get_facts' WHEN 'view' THEN 'list_steps' WHEN 'purchase' THEN 'check_same_logic' ELSE 'search' END AS tool, event_type = 'error' AS failed FROM events),
t AS (SELECT turn, any_value(user_id) % 5 AS a, count(*) FILTER (WHERE tool IN ('get_facts', 'list_steps')) AS reads, bool_or(tool = 'check_same_logic') AS verified, count(*) FILTER (WHERE failed) AS bad FROM c GROUP BY 1
  UNION ALL SELECT -1 - c_custkey, c_custkey % 5, 0, false, 0 FROM customer)
SELECT turn, verified AS verified_by_tool, reads >= 2 AND NOT verified AS llm_assembled, a IN (0, 2, 4) AND NOT verified AS unverified_sameness_language, turn >= 0 AND reads = 0 AND NOT verified AS search_only, turn < 0 AS no_tools, bad::INTEGER AS tool_errors, a IN (1, 2) AS refused FROM t""")
def q_decision_shape(spark, d):
    """Turns are the events of a user in fortieths, and customers, who called no tool."""
    tool = F.element_at(F.create_map(*(F.lit(x) for pair in _CALLS.items() for x in pair)), F.col("event_type"))
    call = F.struct(tool.alias("tool"), F.when(F.col("event_type") == "error", "error: no rows").otherwise("12 rows").alias("result"))
    events = _t(spark, d, "events").groupBy((F.col("user_id") * 40 + F.col("event_id") % 40).alias("turn"), "user_id").agg(F.collect_list(call).alias("calls"))
    silent = _t(spark, d, "customer").select((-1 - F.col("c_custkey")).alias("turn"), F.col("c_custkey").alias("user_id"), F.lit(None).cast(dict(events.dtypes)["calls"]).alias("calls"))
    answer = F.get(F.array(*map(F.lit, _ANSWERS)), (F.col("user_id") % 5).cast("int"))
    return governance.decision_shape(events.unionByName(silent).withColumn("answer", answer))


@_query("SELECT user_id, event_type, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1, 2")
def q_usage_rows(spark, d):
    return ev.usage_rows(_t(spark, d, "events"))


@_query("SELECT count(s_suppkey) / count(*) AS fraction FROM (SELECT DISTINCT l_suppkey FROM lineitem) LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0) ON s_suppkey = l_suppkey")
def q_grounded_fraction(spark, d):
    known = _t(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return records.grounded_fraction(_t(spark, d, "lineitem"), known, "l_suppkey")


# Texts


@_query(r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN chr(13) || chr(10) || chr(160) || ' x' || chr(8203) || chr(9) || 'y' || chr(12) || chr(11) || 'z ' ELSE '' END, '[\x{feff}\x{200b}]', '', 'g'), '\r\n', chr(10), 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[\r\x0b\x0c]', chr(10), 'g'), '[ \t\x{a0}]+', ' ', 'g') AS t FROM a)
SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS plain FROM b""")
def q_plain_whitespace(spark, d):
    """All texts, every fifth with all marks and odd blanks after it."""
    marks = F.when(F.col("doc_id") % 5 == 0, "\r\n  x​\ty\u000c\u000bz ").otherwise("")
    docs = _t(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), marks).alias("text"))
    return docs.select("doc_id", F.sha2(tx.plain_whitespace(F.col("text")), 256).alias("plain"))


@_query("""SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN value < 50 THEN 'no_query' ELSE 'all_queries_failed' END WHEN 'view' THEN 'complex_sql' WHEN 'error' THEN 'parse_failure' WHEN 'signup' THEN 'extraction_failure' ELSE 'unknown' END AS category FROM events""")
def q_error_category(spark, d):
    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    said = F.when((kind == "click") & (F.col("value") < 50), F.concat(F.lit("No SELECT found in "), n)).when(kind == "click", F.concat(F.lit("None of "), n, F.lit(" queries Parsed successfully, failed to parse sql")))
    said = said.when(kind == "view", F.concat(F.lit("Unexpected token at "), n)).when(kind == "error", F.concat(F.lit("Failed to parse SQL by ScriptDom: "), n)).when(kind == "signup", F.concat(F.lit("ScriptDom failed: "), n))
    return _t(spark, d, "events").select("event_id", tx.error_category(said.otherwise(n)).alias("category"))


@_query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'dw' ELSE '' END AS database, CASE WHEN s_suppkey % 3 = 2 THEN '' ELSE 'rep' END AS schema, 'usp_' || s_suppkey AS name FROM supplier")
def q_exec_target(spark, d):
    third = F.col("s_suppkey") % 3
    sql = F.concat(F.when(third == 0, "EXEC [dw] . [rep].[").when(third == 1, "execute rep.[").otherwise("exec ["), _id("usp_", "s_suppkey"), F.lit("] @x = 1, @y.z"))
    return _t(spark, d, "supplier").select("s_suppkey", tx.exec_target(sql).alias("t")).select("s_suppkey", "t.*")


@_query("SELECT p_partkey, 'Sales.' || p_type || ', ' || 'Table X.' || p_size AS refs FROM part")
def q_column_refs(spark, d):
    measure = F.concat(F.lit("SUM('Table X'["), F.col("p_size").cast("string"), F.lit("]) / COUNT(Sales["), F.col("p_type"), F.lit("]) + [Own] + Sales["), F.col("p_type"), F.lit("]"))
    return _t(spark, d, "part").select("p_partkey", F.array_join(tx.column_refs(measure), ", ").alias("refs"))


@_query("SELECT n_nationkey, 'DBO.' || n_name || ', REGION' AS tables FROM nation")
def q_table_refs(spark, d):
    sql = F.concat(F.lit("select * from [dbo].["), F.col("n_name"), F.lit("] n join region r on 1=1 left join #t t on 1=1 from (select 1)"))
    return _t(spark, d, "nation").select("n_nationkey", F.array_join(tx.table_refs(sql), ", ").alias("tables"))


@_query("SELECT c_custkey, 'say ' || c_name || ' now' AS token, 'C ' || c_mktsegment[1] || lower(c_mktsegment[2:]) AS title FROM customer")
def q_sanitised(spark, d):
    return _t(spark, d, "customer").select("c_custkey", tx.sanitised(F.concat(F.lit('say "'), "c_name", F.lit("'   now` "))).alias("token"), tx.titled(F.concat(F.lit("c_-"), "c_mktsegment")).alias("title"))


@_query(r"SELECT doc_id, sha256(replace(regexp_replace(regexp_replace(text, '\bthe\b', 'X', 'gi'), '\bder\b', 'Y', 'gi'), 'license', 'Z')) AS text_sha256 FROM documents WHERE lang IN ('en', 'de') AND NOT regexp_matches(text, '[^\x00-\x7f]')")
def q_anonymised(spark, d):
    docs = _t(spark, d, "documents").where("lang IN ('en', 'de')").where(~F.rlike("text", F.lit(r"[^\x00-\x7f]")))
    return docs.select("doc_id", F.sha2(tx.anonymised(F.col("text"), [("word", "the", "X"), ("word", "der", "Y"), ("literal", "license", "Z")]), 256).alias("text_sha256"))


@_query("""WITH t AS (SELECT doc_id AS id, text, term, instr(lower(text), term) AS pos FROM documents, (SELECT unnest(['license', 'ing, ', 'qzx']) AS term)) SELECT id, term, substr(text, greatest(1, pos - 30), pos - greatest(1, pos - 30) + length(term) + 30) AS context FROM t WHERE pos > 0""")
def q_leaks(spark, d):
    return tx.leaks(_t(spark, d, "documents"), "doc_id", "text", ["License", "ing, ", "QZX"])


@_query("""WITH t AS (SELECT o_orderkey, o_orderkey % 40 AS n, o_orderdate::DATE AS day FROM orders), today AS (SELECT DATE '2024-03-31' AS d)
SELECT o_orderkey, (CASE o_orderkey % 7 WHEN 0 THEN d - n::INTEGER WHEN 1 THEN date_trunc('month', d - to_months(n::INTEGER)) WHEN 2 THEN date_trunc('month', d - to_months(n::INTEGER)) + INTERVAL 1 MONTH - INTERVAL 1 DAY
  WHEN 3 THEN make_date(2024 - n, 1, 1) WHEN 4 THEN make_date(2024 - n, 12, 31) WHEN 5 THEN day ELSE d END)::DATE::VARCHAR AS day FROM t, today""")
def q_date_tokens(spark, d):
    """A token of each kind with the orders' figures; what has a plus sign is no token, and today is a month's end."""
    k, n = F.col("o_orderkey") % 7, (F.col("o_orderkey") % 40).cast("string")
    back = lambda head: F.concat(F.lit(head), n)
    token = F.when(k == 0, back("t-")).when(k == 1, back(" MB -")).when(k == 2, back("me-")).when(k == 3, back("Yb-")).when(k == 4, back("YE- ")).when(k == 5, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(back("ME+"))
    return _t(spark, d, "orders").select("o_orderkey", tx.date_token(token, "2024-03-31").cast("string").alias("day"))


@_query("SELECT doc_id, left(sha256(concat_ws('|', coalesce(doc_id::VARCHAR, ''), coalesce(source, ''), coalesce(lang, ''))), 16) AS finding_id FROM documents")
def q_finding_ids(spark, d):
    return _t(spark, d, "documents").select("doc_id", privacy.finding_id(F.col("doc_id"), F.col("source"), F.col("lang")).alias("finding_id"))


@_query("SELECT doc_id, substr(text, 1, 200) AS head FROM documents WHERE length(text) > 5000")
def q_text_caps(spark, d):
    return _t(spark, d, "documents").where(F.length("text") > 5000).select("doc_id", F.substr("text", F.lit(1), F.lit(200)).alias("head"))


# Names, payloads and whole journeys


@_query("""WITH n AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'rep.V_ACME_' WHEN 1 THEN 'usp_Acme_' WHEN 2 THEN '' ELSE 'X_' END || replace(p_name, ' ', '_') || CASE WHEN p_size % 5 = 0 THEN '' ELSE '_pbi' END AS name, p_size % 4 AS k, p_size % 5 AS m, lower(p_name) AS w FROM part)
SELECT p_partkey, CASE WHEN m = 0 THEN NULL WHEN k = 2 AND contains(w, ' ') THEN substr(w, instr(w, ' ') + 1) ELSE w END AS key FROM n""")
def q_match_keys(spark, d):
    size = F.col("p_size")
    head = F.when(size % 4 == 0, "rep.V_ACME_").when(size % 4 == 1, "usp_Acme_").when(size % 4 == 2, "").otherwise("X_")
    name = F.concat(head, F.replace("p_name", F.lit(" "), F.lit("_")), F.when(size % 5 == 0, "").otherwise("_pbi"))
    return _t(spark, d, "part").select("p_partkey", tx.match_key(name).alias("key"))


@_query("SELECT doc_id, text AS decoded, lower(trim(source)) || ' report' AS key FROM documents WHERE text IS NOT NULL")
def q_decoded_payloads(spark, d):
    docs = _t(spark, d, "documents").where("text IS NOT NULL")
    name = F.concat(F.lit("[433bbb97-0a] "), F.upper("source"), F.lit("   Report [667ad212-ff]"))
    return docs.select("doc_id", tx.decoded(F.base64(F.encode("text", "UTF-8"))).alias("decoded"), tx.report_key(name).alias("key"))


@_query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'calculated_table' WHEN 1 THEN 'no_partition' WHEN 2 THEN 'directlake_entity' WHEN 3 THEN 'non_sql_source:Excel.Workbook' WHEN 4 THEN 'non_sql_source:#table' ELSE 'unrecognized_shape' END AS reason FROM part""")
def q_partition_fallout(spark, d):
    k, name = F.col("p_size") % 6, F.col("p_name")
    body = F.when(k == 0, "= calculated\n source = x").when(k == 2, "= entity\n entityName").when(k == 3, "= m\n Excel.Workbook(x, #table)").when(k == 4, "= m\n #table({})").otherwise("= m\n Odd.Source(x)")
    content = F.when(k == 1, F.concat(F.lit("measure "), name)).otherwise(F.concat(F.lit("table "), name, F.lit("\n  partition "), name, F.lit(" "), body))
    return _t(spark, d, "part").select("p_partkey", tx.partition_fallout(content).alias("reason"))


@_query("""WITH m AS (SELECT s_suppkey AS k, 'rep.M' || s_suppkey AS metric_id FROM supplier),
r AS (SELECT l_suppkey AS k, 'R' || (l_orderkey % 9) AS report_name, min(l_linenumber) AS pos FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2),
p AS (SELECT o_custkey AS k, bool_or(o_orderpriority = '1-URGENT') AS c, bool_or(o_orderpriority = '2-HIGH') AS w FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
t AS (SELECT c_custkey AS k, c_acctbal > 2000 AS ok FROM customer WHERE c_custkey % 4 = 0)
SELECT metric_id, 'view' AS source_type, 'rep' AS source_schema, true AS loaded, coalesce(m.k % 5 > 0 AND m.k % 3 <> 0, false) AS parsed, CASE WHEN m.k % 5 = 0 THEN 'complex_sql' WHEN m.k % 7 = 0 THEN 'parse_error' END AS error_type,
  m.k % 3 = 1 AS in_graph, coalesce(x.c_acctbal > 0, false) AS card, CASE WHEN t.ok THEN 'ok' WHEN t.ok IS NOT NULL THEN 'rejected_by_agent' WHEN x.c_custkey IS NOT NULL THEN 'pending' END AS described_status,
  (SELECT count(*) FROM r WHERE r.k = m.k) AS report_count, coalesce((SELECT string_agg(report_name, '; ' ORDER BY pos, report_name) FROM r WHERE r.k = m.k), '') AS report_names, coalesce(p.c, false) AS published_collibra, coalesce(p.w, false) AS published_pbi_writeback
FROM m LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) x ON x.c_custkey = m.k LEFT JOIN t ON t.k = m.k LEFT JOIN p ON p.k = m.k""")
def q_metric_journeys(spark, d):
    """Suppliers are metrics; customers of the same number their cards and descriptions, orders what was published."""
    s, c, key = _t(spark, d, "supplier"), _t(spark, d, "customer"), F.col("s_suppkey")
    sources = s.select(_id("rep.M", "s_suppkey").alias("metric_id"), F.lit("view").alias("source_type"), F.lit("rep").alias("source_schema"))
    checked = s.where(key % 3 != 0).select(_id("REP.m", "s_suppkey").alias("metric_id"), (key % 5 > 0).alias("parsed"), (key % 3 == 1).alias("canonical"))
    errors = s.where((key % 5 == 0) | (key % 7 == 0)).select(_id("rep.m", "s_suppkey").alias("metric_id"), F.when(key % 5 == 0, "complex_sql").alias("error_category"))
    cards = c.where("c_custkey % 2 = 0").select(_id("Rep.M", "c_custkey").alias("metric_id"), F.when(F.col("c_acctbal") > 0, "sums").alias("calculation_logic"))
    bare = F.when(F.col("c_custkey") % 8 == 0, _id("m", "c_custkey")).otherwise(_id("rep.M", "c_custkey"))
    told = c.where("c_custkey % 4 = 0").select(bare.alias("metric_name"), F.when(F.col("c_acctbal") > 2000, "ok").otherwise("rejected").alias("status"))
    links = _t(spark, d, "lineitem").where("l_linenumber <= 3").select(F.concat(F.lit("R"), (F.col("l_orderkey") % 9).cast("string")).alias("report_name"), F.lit("REP").alias("schema_name"), _id("m", "l_suppkey").alias("sql_object"), F.col("l_linenumber").alias("pos"))
    target = F.when(F.col("o_orderpriority") == "1-URGENT", "collibra").when(F.col("o_orderpriority") == "2-HIGH", "fabric_pbi").otherwise("other")
    even = F.col("o_orderkey") % 2 == 0
    published = _t(spark, d, "orders").select(F.when(even, _id("REP.M", "o_custkey")).alias("asset_id"), F.when(~even, _id("M", "o_custkey")).alias("name"), target.alias("target"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"))
    return governance.metric_journey(sources, checked, errors, cards, told, links, published)


@_query("""SELECT 'r7' AS run_id, '2024-02-01' AS run_timestamp, o_orderkey AS metric_id, o_orderpriority AS metric_name, 'unknown' AS error_type, repeat('x', (o_orderkey % 700)::INTEGER)[1:500] AS error_message, o_custkey AS line_count, 1 AS query_count,
repeat('y', 250 + (o_orderkey % 100)::INTEGER)[1:300] AS clean_sql_preview, CASE WHEN o_custkey % 2 = 0 THEN 'known' ELSE 'new' END AS status FROM orders WHERE o_orderstatus = 'P'""")
def q_error_records(spark, d):
    o = _t(spark, d, "orders").where("o_orderstatus = 'P'")
    texts = F.repeat(F.lit("x"), (F.col("o_orderkey") % 700).cast("int")), F.repeat(F.lit("y"), (250 + F.col("o_orderkey") % 100).cast("int"))
    current = o.select(F.col("o_orderkey").alias("metric_id"), F.col("o_orderpriority").alias("metric_name"), F.lit("unknown").alias("error_type"), texts[0].alias("error_message"), F.col("o_custkey").alias("line_count"), F.lit(1).alias("query_count"), texts[1].alias("clean_sql_preview"))
    return governance.error_records(current, o.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("metric_id"), F.lit("known").alias("status")), "r7", "2024-02-01")
