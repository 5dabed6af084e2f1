"""Gates, typed export, grounding of descriptions, canonical predicates and line differences."""

import difflib
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stepweave.operators import gates, grounding, predicates
from stepweave.plans import export, graph

REGISTRY = {
    "graph_nodes": {
        "status": "active", "columns": [("node_id", "string", False), ("layer", "string", False)], "owner": {"notebook": "build"}, "consumers": ["export"], "must_be_nonempty": True,
        "invariants": [{"kind": "unique", "columns": ["node_id"]}, {"kind": "allowed_values", "column": "layer", "values": ["canonical", "technical"]}],
    },
    "graph_edges": {
        "status": "active", "columns": [("source_id", "string", False), ("target_id", "string", False)], "owner": {"notebook": "build"}, "consumers": ["export", "build"],
        "invariants": [{"kind": "reference", "column": "source_id", "references": "graph_nodes.node_id"}],
    },
    "cards": {
        "status": "active", "columns": [("id", "string", False)], "owner": {"notebook": "cards"}, "consumers": ["export"], "optional_input": True, "remediation": "run cards", "enrichers": ["build"],
        "relations": [{"kind": "count_equals", "other_table": "graph_nodes", "other_where": {"layer": "canonical"}}],
    },
    "future": {"status": "planned", "columns": [("x", "string", False)], "consumers": ["export"], "invariants": [{"kind": "unique", "columns": ["x"]}]},
}


def frames(spark, nodes=(("c:1", "canonical"), ("t:1", "technical")), edges=(("c:1", "t:1"),), cards=(("a",),)):
    make = lambda rows, s: spark.createDataFrame(list(rows), s)
    return {"graph_nodes": make(nodes, "node_id string, layer string"), "graph_edges": make(edges, "source_id string, target_id string"), "cards": make(cards, "id string")}


def test_clean_tables_pass(spark):
    tables = frames(spark)
    assert gates.check_all(tables, REGISTRY).count() == 0
    assert gates.postcondition_gate("build", tables, REGISTRY) == ["graph_nodes", "graph_edges", "cards"]
    assert gates.precondition_gate("export", tables, REGISTRY) == ["graph_edges", "graph_nodes"]
    assert gates.setup_rows("export", {}, REGISTRY, "now") == [{"run_at": "now", "step": "export", "table_name": "cards", "present": False, "remediation": "run cards"}]


def test_every_rule_reports_its_values(spark):
    nodes = [("c:1", "canonical"), ("c:1", "canonical"), (None, "zombie"), (None, None), *[(f"n{k}", "technical") for k in range(9)], *[(f"n{k}", "technical") for k in range(9)]]
    edges = [("c:1", "x"), ("ghost:1", "x"), ("ghost:2", "x"), ("ghost:2", "x"), (None, "x")]
    found = {(r.table, r.kind): (r.found, r.samples) for r in gates.violations(list(REGISTRY)[:3], frames(spark, nodes, edges), REGISTRY).collect()}
    assert found == {
        ("graph_nodes", "unique"): (11, ["None", "c:1", "n0", "n1", "n2"]), ("graph_nodes", "allowed_values"): (1, ["zombie"]),
        ("graph_edges", "reference"): (2, ["ghost:1", "ghost:2"]), ("cards", "count_equals"): (1, [""]),
    }
    with pytest.raises(gates.GateError, match="ghost:1"):
        gates.postcondition_gate("build", frames(spark, nodes, edges), REGISTRY)
    only = {k: v for k, v in frames(spark, nodes, edges).items() if k == "graph_edges"}
    assert gates.postcondition_gate("build", only, REGISTRY) == [] and gates.check_all(only, REGISTRY).count() == 0


def test_unique_over_columns_and_folded(spark):
    contract = lambda **rule: {"t": {"status": "active", "invariants": [{"kind": "unique", **rule}]}}
    rows = spark.createDataFrame([("x", "1,2"), ("x", "2"), ("x", "2"), ("x,1", "2"), ("X", "2"), (None, "2")], "a string, b string")
    out = gates.violations(["t"], {"t": rows}, contract(columns=["a", "b"])).collect()
    assert [(r.found, len(r.samples)) for r in out] == [(1, 1)] and '"x"' in out[0].samples[0]
    out = gates.violations(["t"], {"t": rows.select("a").distinct()}, contract(columns=["a"], fold_case=True)).collect()
    assert [(r.found, r.samples) for r in out] == [(1, ["X"])]
    with pytest.raises(ValueError):
        gates.violations(["t"], {"t": rows}, {"t": {"invariants": [{"kind": "other"}]}})


def test_preconditions_name_what_is_wrong(spark):
    tables = frames(spark, nodes=())
    tables["graph_edges"] = tables["graph_edges"].drop("target_id")
    with pytest.raises(gates.GateError) as error:
        gates.precondition_gate("export", tables, REGISTRY)
    assert [(f["table"], f["problem"], f["producer"]) for f in error.value.failures] == [("graph_edges", "is missing column(s) target_id", "build"), ("graph_nodes", "is empty", "build")]
    with pytest.raises(gates.GateError, match="missing"):
        gates.precondition_gate("export", {}, REGISTRY)


def test_one_scan_a_table(spark, tmp_path):
    for name, df in frames(spark).items():
        df.write.parquet(f"{tmp_path}/{name}")
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("graph_nodes", "graph_edges", "cards")}
    plan = gates.violations(list(tables), tables, REGISTRY)._jdf.queryExecution().optimizedPlan().toString()
    # What is broken is read twice, for its size and its samples; each reading scans a table once.
    assert all(len(re.findall(r"Relation \[[^\]]*" + c, plan)) == 2 for c in ("node_id", "source_id"))


def graph_rows(spark):
    p = lambda **k: k
    nodes = [
        ("canonical:s.m", "canonical", "m", None, p(steward="x")), ("transform:s.m:a", "transformation", "a", "d", p(metric_id="s.m", sql_fragment="SELECT")), ("transform:s.m:b", "transformation", "b", None, p(metric_id="s.m")),
        ("tech:T", "technical", "T", None, p(table="T", schema="dbo")), ("tech:T.C", "technical", "C", None, p(table="T", column="C")), ("decision:1", "decision", "x", None, {}), ("report:R", "report", "R", None, p(repo_name="r")),
        ("measure:R", "measure", "M", None, p(dax_expression="1")),
    ]
    edges = [
        ("canonical:s.m", "transform:s.m:b", graph.C2T), ("transform:s.m:b", "transform:s.m:a", graph.T2T), ("transform:s.m:a", "tech:T", graph.T2TECH), ("tech:T", "tech:T.C", graph.TAB2COL),
        ("transform:s.m:a", "decision:1", "step_to_decision"), ("report:R", "canonical:s.m", "report_to_canonical"), ("report:R", "measure:R", "report_to_measure"),
    ]
    return spark.createDataFrame(nodes, "node_id string, layer string, name string, description string, properties map<string,string>"), spark.createDataFrame(edges, "source_id string, target_id string, edge_type string")


def test_export_conserves_rows_and_closes_paths(spark, tmp_path):
    nodes, edges = graph_rows(spark)
    found = export.export(nodes, edges, str(tmp_path))
    tables = {n: export.table(spark, str(tmp_path), n) for n in [*export.LAYERS.values(), *export.EDGES.values(), export.USES_TABLE]}
    assert len(tables) == 14 and {n: t.count() for n, t in tables.items()} == {n: found[n] for n in tables}
    assert sum(found[n] for n in export.LAYERS.values()) == nodes.count() - 1
    assert {(r.sourceId, r.targetId) for r in tables["graph_edge_c2t"].collect()} == {("canonical:s.m", "transform:s.m:a"), ("canonical:s.m", "transform:s.m:b")}
    assert [tuple(r) for r in tables[export.USES_TABLE].collect()] == [("canonical:s.m", "tech:T")]
    metric = tables["graph_canonical"].first()
    assert (metric.metricId, metric.name, metric.bareName, metric.steward, metric.developer, metric.stepCount, metric.tableCount) == ("s.m", "s.m", "m", "x", "", 2, 1)
    assert {(r.tableName, r.columnName) for r in tables["graph_technical"].collect()} == {("T", ""), ("T", "C")}
    with pytest.raises(PySparkException):
        export.export(nodes, edges.unionByName(edges.limit(1).withColumn("edge_type", F.lit("odd"))), str(tmp_path / "x"))
    with pytest.raises(PySparkException):
        export.export(nodes.unionByName(nodes.limit(1).withColumn("layer", F.lit(None).cast("string"))), edges, str(tmp_path / "y"))


FRAGMENT = "SELECT status, pending FROM visits WHERE device_code IN ('900112', '900111') AND arrival > 30"


@pytest.mark.parametrize(
    ("text", "dialect", "want", "kinds"),
    [
        ("Counts visits.\n- filters on device_code 900112", "sql", "Counts visits.\n- filters on device_code 900112", []),
        ("Counts visits.\n- excludes pending visits\n- arrival over 30", "sql", "Counts visits.\n- arrival over 30", ["selected_not_filtered"]),
        ("Counts visits.\n- excludes pending visits", "dax", "Counts visits.\n- excludes pending visits", []),
        ("Counts visits.\n  - restricted to cardiology wards  \nEnd", "sql", "Counts visits.\nEnd", ["ungrounded_claim"]),
        ("Uses code 123.", "sql", "", ["ungrounded_number"]),
        ("- excludes cardiology code 77", "sql", "", ["ungrounded_number", "ungrounded_claim"]),
        ("Devices '900112' and 'Xyz'", "sql", "", ["ungrounded_quote"]),
        ("- excludes cardiology\n- excludes pending", "sql", "", ["ungrounded_claim", "selected_not_filtered"]),
        ("Fine.\n- excludes 'cardiology'", "sql", "", ["ungrounded_quote", "ungrounded_claim"]),
        ("Fine.\n- excludes records that patients have", "sql", "Fine.\n- excludes records that patients have", []),
        (None, "sql", "", []),
    ],
)
def test_descriptions_keep_what_the_source_bears(spark, text, dialect, want, kinds):
    texts = spark.createDataFrame([("m", text)], "owner string, text string")
    evidence = spark.createDataFrame([("m", FRAGMENT, ["- visits: stays"], dialect)], "owner string, fragment string, dict_lines array<string>, dialect string")
    out = grounding.enforced(texts, evidence).first()
    assert (out.text, [v.kind for v in out.violations]) == (want, kinds)


def test_scope_and_dictionary_lines(spark):
    texts = spark.createDataFrame([("m", "All.\nThere are no filters here.\nWithout any\nfilter", 5), ("n", "no filter", 0)], "owner string, text string, decisions int")
    assert [tuple(r) for r in grounding.scope_violations(texts).collect()] == [("m", 2, "There are no filters here.")]
    steps = spark.createDataFrame([("s", "select PAT_ID from t1"), ("r", "x")], "step_id string, fragment string")
    reads = spark.createDataFrame([("s", "t2"), ("s", "t1"), ("s", "t1"), ("r", "t3")], "step_id string, table_id string")
    columns = spark.createDataFrame([("t1", "t1.b"), ("t1", "t1.a"), ("t2", "t2.c")], "table_id string, column_id string")
    told = spark.createDataFrame([("t1", "T1", " first "), ("t2", "T2", None), ("t1.a", "pat_id", "key"), ("t1.b", "other", "no"), ("t2.c", "id", "c"), ("t3", "T3", " ")], "node_id string, name string, description string")
    assert {r.step_id: r.lines for r in grounding.dictionary_lines(steps, reads, columns, told).collect()} == {"s": ["- T1: first", "  - pat_id: key", "  - id: c"]}
    assert grounding.dictionary_lines(steps, reads, columns, told, 1).first().lines == ["- T1: first"]


FACTS = "owner string, pos int, op string, column string, columns array<string>, values array<string>, operands array<string>, or_group string"


def test_meaning_of_predicates(spark):
    rows = [
        ("in", "IN", "FSD.FLO_ID", None, [" '900112' ", "900111", "900111"], None), ("in", "in", "flo_id", [], None, ["900111", "900112"]), ("join", "MATCHES", "a.X", ["a.X", "b.[y]"], None, None), ("join", "eq", "b.y", ["b.y", "a.x"], [], None),
        ("between", "BETWEEN", "t.d", ["t.d", "t.lo", "t.hi"], ["5"], None), ("between", "between", "d", ["d"], ["hi", "LO", "5"], None), ("none", None, None, None, None, None), ("not", "NOT_IN", "flo_id", None, ["900111", "900112"], None),
    ]
    facts = predicates.canonical(spark.createDataFrame([(o, k, op, c, cs, v, a, "") for k, (o, op, c, cs, v, a) in enumerate(rows)], FACTS))
    got = {}
    for r in facts.collect():
        got.setdefault(r.owner, set()).add((r.fact.op, r.fact.pair, r.fact.key, tuple(r.fact["values"])))
    assert got == {
        "in": {("IN", False, "FLO_ID", ("900111", "900112"))}, "join": {("EQ", True, "X<->Y", ())}, "between": {("BETWEEN", False, "D", ("5", "HI", "LO"))}, "none": {("?", False, "?", ())},
        "not": {("NOT_IN", False, "FLO_ID", ("900111", "900112"))},
    }


def test_trees_differ_by_meaning_and_grouping(spark):
    row = lambda owner, pos, op, column, values, group="": (owner, pos, op, column, None, values, None, group)
    want = spark.createDataFrame([row("m", 1, "IN", "a", ["1", "2"], "g"), row("m", 2, "EQ", "b", ["x"]), row("m", 3, "LT", "c", ["100"]), row("same", 1, "EQ", "b", ["x"])], FACTS)
    have = spark.createDataFrame([row("m", 1, "in", "t.a", ["2", "1"]), row("m", 2, "EQ", "b", ["'X'"], "h"), row("m", 3, "GT", "c", ["100"]), row("same", 1, "eq", "b", ["X"])], FACTS)
    got = {(r.kind, r.op, r.key) for r in predicates.tree_diff(want, have).collect()}
    assert got == {("alternative", "IN", "A"), ("requirement", "EQ", "B"), ("missing", "LT", "C"), ("extra", "GT", "C")}


def test_line_differences_against_difflib(spark):
    rng = random.Random(3)
    text = lambda: "\n".join(rng.choice(["SELECT a", "FROM t", "WHERE x > 1", "  AND y", ""]) for _ in range(rng.randrange(30)))
    pairs = [(k, text(), text()) for k in range(40)] + [(98, None, "a"), (99, "a\nb", "a\nb")]
    rows = spark.createDataFrame(pairs, "k int, a string, b string")
    for most, named in ((predicates.STEP_LINES, None), (predicates.WHOLE_LINES, ("group_1", "group_2"))):
        for r in predicates.line_diff(rows, "a", "b", most, named).collect():
            names = named or ("", "")
            lines = list(difflib.unified_diff((r.a or "").splitlines(), (r.b or "").splitlines(), *names, lineterm="", n=1))[0 if named else 2 :]
            assert r.diff.splitlines()[:most] == lines[:most] and len(r.diff.splitlines()) == min(len(lines), most + 1)
            assert len(lines) <= most or r.diff.endswith(f"... ({len(lines) - most} more diff lines)")


def most_rows(df):
    """The most rows that a join of the plan gave, once the rows are collected."""

    def seen(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return seen(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return seen(node.plan())
        rows = [seen(node.children().apply(i)) for i in range(node.children().size())]
        if "Join" in name and node.metrics().contains("numOutputRows"):
            rows.append(node.metrics().apply("numOutputRows").value())
        return max(rows, default=0)

    return seen(df._jdf.queryExecution().executedPlan())


def test_a_step_meets_the_columns_it_names_alone(spark):
    steps = spark.range(300).selectExpr("concat('s', id) AS step_id", "concat('SELECT Col', id, 'x FROM t') AS fragment", "concat('t', id % 2) AS table_id")
    reads, columns = steps.select("step_id", "table_id"), spark.range(300).selectExpr("concat('t', id % 2) AS table_id", "concat('c', id) AS column_id")
    told = spark.range(300).selectExpr("concat('c', id) AS node_id", "concat('cOl', id, 'X') AS name", "'said' AS description")
    out = grounding.dictionary_lines(steps, reads, columns, told)
    assert {r.step_id: r.lines for r in out.collect()} == {f"s{k}": [f"  - cOl{k}X: said"] for k in range(300)}
    assert most_rows(out) < 3000  # of 45000 pairs of a step and a column of its table


def test_names_anywhere_in_a_fragment(spark):
    """Names inside words, of several words, of none, empty and null ones, against a loop."""
    texts = ["select PAT_ID, b from t1", "x", "", "  ", "order id = 'ÄÖ-straße'", "a.b$$c [order  id]", None, "patient_id_number"]
    names = ["id", "pat_id", "ID_NUM", "order id", "$$", "", "b", "äö", "STRASSE", "straße", "d_nu", "no such", None, "r i", ".", "patient_id_numbers"]
    steps = spark.createDataFrame([(f"s{k}", t) for k, t in enumerate(texts)], "step_id string, fragment string")
    reads = steps.selectExpr("step_id", "'t' AS table_id")
    columns = spark.createDataFrame([("t", f"c{k}") for k in range(len(names))], "table_id string, column_id string")
    told = spark.createDataFrame([(f"c{k}", n, f"n{k}") for k, n in enumerate(names)], "node_id string, name string, description string")
    got = {r.step_id: sorted(x.rsplit(": ", 1)[1] for x in r.lines) for r in grounding.dictionary_lines(steps, reads, columns, told).collect()}
    held = {f"s{k}": sorted(f"n{j}" for j, n in enumerate(names) if t is not None and n is not None and n.lower() in t.lower()) for k, t in enumerate(texts)}
    assert got == {k: v for k, v in held.items() if v}
