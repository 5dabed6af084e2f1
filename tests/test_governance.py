"""Lookups, stewardship, decisions and texts where the driver's tables have no odd rows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stepweave.functions import text as tx
from stepweave.operators import algebra, changes, compare, governance, lookups, records
from stepweave.streaming import events as ev


def test_scopes_and_names(spark):
    rows = spark.createDataFrame([("Wait", 1), ("wait time", 2), ("other", 3), (None, 4)], "name string, k int")
    assert [r.k for r in lookups.exact_else_token(rows, "name", "wait").collect()] == [1]
    assert [r.k for r in lookups.exact_else_token(rows, "name", "time wait").collect()] == [2]
    assert lookups.exact_else_token(rows.limit(0), "name", "wait").count() == 0
    assert [r.k for r in lookups.named(rows, ["name"], "[WAIT]").collect()] == [1]


def test_edges_of_undeclared_types_raise(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("a", "c", "y")], "source_id string, target_id string, edge_type string")
    assert lookups.edge_tables(edges, ["x"], ["y"])["x"].count() == 1
    with pytest.raises(KeyError):
        lookups.edge_tables(edges, ["x"])


def test_step_order_leaves_cycles_last(spark):
    steps = spark.createDataFrame([(s,) for s in "abcdef"], "step string")
    depends = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "e"), ("e", "d"), ("f", "e"), ("a", "a")], "step string, on string")
    assert [(r.step, r.depth) for r in lookups.step_order(steps, depends).orderBy("place").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", None), ("e", None), ("f", None)]


def test_decisions_and_journeys(spark):
    rows = [("m", f"S{k % 2}", k, "extracted", "where", f"  x  > {k}\t") for k in range(14)] + [("m", "S", 99, "failed", "where", "no"), ("n", "S", 1, "extracted", "select", "no")]
    rows += [("p", "A", 1, "extracted", "case_when", "PAT_ID = 123456 AND DOB = '1980-02-03' AND x > 5 " + "y" * 300)]
    out = {r.metric: r for r in governance.decision_summary(spark.createDataFrame(rows, "metric string, step string, site long, status string, context string, expression string")).collect()}
    lines = out["m"].lines.splitlines()
    assert set(out) == {"m", "p"} and out["m"].decisions == 14 and lines[0] == "S0 [where]: x > 0" and lines[7] == "S1 [where]: x > 1" and len(lines) == 13
    assert lines[12] == "(+2 more decision sites \u2014 see graph_decision_sites)"
    assert out["p"].lines == "A [case_when]: " + ("PAT_ID = <ID> AND DOB = <DATE> AND x > 5 " + "y" * 300)[:160]
    links = spark.createDataFrame([("r", 2, "a"), ("r", 1, "b"), ("r", 3, "a"), ("s", 1, "z"), ("t", 1, "A"), ("u", 1, "")], "report string, pos int, metric string")
    got = {r.report: (r.tie_kind, r.names, r.sources) for r in governance.report_journey(links, spark.createDataFrame([("a",)], "metric string")).collect()}
    assert got == {"r": ("lineage_partial_corpus", "b; a", 2), "s": ("lineage_outside_corpus", "z", 1), "t": ("lineage_in_corpus", "A", 1), "u": ("lineage_outside_corpus", "", 0)}
    assert {r.tie_kind for r in governance.report_journey(links, None).collect()} == {"lineage"}
    none = spark.createDataFrame([], "report string, status string")
    assert governance.run_summary(links.limit(0), links.limit(0), none, "report").first().success_rate == 0.0
    some = governance.run_summary(links, links.where("report = 'r'"), spark.createDataFrame([("r", "new"), ("x", "resolved")], none.schema), "report").first()
    assert (some.total, some.errors, some.success_count, some.success_rate, some.new, some.resolved) == (4, 3, 3, 75.0, 1, 1)


def test_stewards_and_terms(spark):
    metrics = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    given = spark.createDataFrame([("a", "x", "d1"), ("a", "x", "d1"), ("b", "y", ""), ("c", None, "d2")], "k string, steward string, department string")
    assert tuple(governance.steward_coverage(metrics, given, "k").first()) == (3, 2, 1, 2, 1, 66)
    assert tuple(governance.steward_coverage(metrics.limit(0), given.limit(0), "k").first()) == (0, 0, 0, 0, 0, 0)
    names = ["Final_Select", "__temp_2", "2base", "cohort", "los", " los ", "Results1", "stage", "source", "DATA_MART", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n for r in governance.term_candidates(rows, "n").collect()} == {"cohort", "stage", "source", "DATA_MART"}


def test_who_decided(spark):
    call = lambda *tools: [(t, "ok") for t in tools]
    turns = [
        (1, call("get_facts", "list_steps"), "They differ."), (2, call("get_facts", "get_facts", "check_same_logic"), "IDENTICAL"), (3, call("search"), "candidates"), (4, [], "I don't have information"),
        (5, None, None), (6, [("search", '{"error": 1}'), ("get_facts", "error")], "no other metric"),
    ]
    out = governance.decision_shape(spark.createDataFrame(turns, "turn int, calls array<struct<tool: string, result: string>>, answer string"))
    assert [tuple(r) for r in out.orderBy("turn").collect()] == [
        (1, False, True, True, False, False, 0, False), (2, True, False, False, False, False, 0, False), (3, False, False, False, True, False, 0, False), (4, False, False, False, False, True, 0, True),
        (5, False, False, False, False, True, 0, False), (6, False, False, True, False, False, 2, False)]


def test_errors_by_category(spark):
    cases = {
        "No SELECT found": "no_query", "no SQL queries found in proc": "no_query", "Error tokenizing 'x'": "complex_sql", "Unexpected token": "complex_sql", "invalid expression near": "complex_sql",
        "none of 3 queries parsed successfully": "all_queries_failed", "failed to parse sql": "parse_failure", "ScriptDom failed": "extraction_failure", "timeout": "unknown", None: "unknown",
    }
    rows = spark.createDataFrame([(m,) for m in cases], "m string")
    assert [r[0] for r in rows.select(tx.error_category(F.col("m"))).collect()] == list(cases.values())


def test_date_tokens_shift_their_own_unit(spark):
    cases = {"T": "2024-02-10", "t-7": "2024-02-03", "MB-1": "2024-01-01", "ME-1": "2024-01-31", "YB-1": "2023-01-01", "YE-2": "2022-12-31", " mb - 12 ": "2023-02-01", "me+1": "2024-02-10", "2023-05-06": "2023-05-06", "X-5": "2024-02-10", None: "2024-02-10"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [str(r[0]) for r in rows.select(tx.date_token(F.col("t"), "2024-02-10")).collect()] == list(cases.values())


def test_targets_that_are_not_allowed_raise(spark):
    rows = spark.createDataFrame([(1, "good", "ok"), (2, "bad", "ok")], "item long, target string, status string")
    assert governance.publish_log(rows.where("item = 1"), ["good"], "r").first().target == "good"
    with pytest.raises(PySparkException):
        governance.publish_log(rows, ["good"], "r").collect()


def test_events_come_in_once_and_first(spark):
    e = spark.createDataFrame([("c", None, "t", 2), ("c", None, "t", 1), ("d", 1, "t", 5)], "conversation_id string, turn_index int, event_at string, n int")
    assert sorted((r.conversation_id, r.n) for r in ev.new_events(e, e.limit(0), order=("n",)).collect()) == [("c", 1), ("d", 5)]
    assert ev.new_events(e, e).count() == 0


def test_upserts_of_one_key_and_of_null(spark):
    now = spark.createDataFrame([(1, "a"), (None, "b")], "k long, v string")
    assert sorted(map(tuple, changes.upsert(now, spark.createDataFrame([(None, "c")], "k long, v string"), "k").collect()), key=str) == [(1, "a"), (None, "c")]
    with pytest.raises(ValueError):
        changes.upsert(now, spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string"), "k")


def test_texts(spark):
    rows = spark.createDataFrame([("﻿a  b\r\n\r\n \t c​ ",), ("exec p",), ("EXECUTE [x].[y].[z];",)], "t string")
    assert rows.select(tx.plain_whitespace(F.col("t"))).first()[0] == "a b\nc"
    assert [tuple(r[0]) if r[0] else None for r in rows.select(tx.exec_target(F.col("t"))).collect()] == [None, ("", "", "p"), ("x", "y", "z")]
    masked = tx.anonymised(F.lit("The 12 of 112, THE end"), [("word", "the", "A"), ("number", "12", "N"), ("literal", "end", "E")])
    assert spark.range(1).select(masked).first()[0] == "A N of 112, A E"
    assert spark.range(1).select(tx.mentions_all(F.lit("other things"), "the")).first()[0] is False


def test_ambiguous_names_take_the_least_target(spark):
    refs = spark.createDataFrame([("g", "n"), ("h", "m")], "g string, n string")
    targets = spark.createDataFrame([("x", "n", "t2"), ("y", "n", "t1")], "g string, n string, target string")
    assert {(r.target, r.how) for r in compare.resolve(refs, targets, "g", "n").collect()} == {("t1", "ambiguous"), (None, "unresolved")}


def test_nothing_to_ground_is_grounded(spark):
    empty = spark.createDataFrame([], "k long")
    assert records.grounded_fraction(empty, empty, "k").first()[0] == 1.0
    assert algebra.Registry().found == {}


def test_names_reports_are_matched_by(spark):
    cases = {
        "V_ACME_SomeReport_PBI": "somereport", "rep.V_ACME_Some_Report_Name_PBI": "some report name", "USP_ACME_ED_Sepsis_pbi": "ed sepsis", "V_ACME_340B_Charges_PBI": "340b charges", "SomeOtherProc": None,
        "V_Single_PBI": "single", "_PBI": None, None: None,
    }
    rows = spark.createDataFrame([(n,) for n in cases], "n string")
    assert [r[0] for r in rows.select(tx.match_key(F.col("n"))).collect()] == list(cases.values())
    name = F.lit("[433bbb97-0a1b]  340B  Eligible Charges [667ad212-ff] ")
    assert spark.range(1).select(tx.report_key(name)).first()[0] == "340b eligible charges"
    rows = spark.createDataFrame([("aGkgw6Q=",), ("%%%",), (None,)], "p string")
    assert [r[0] for r in rows.select(tx.decoded(F.col("p"))).collect()] == ["hi ä", None, None]


def test_metrics_that_repeat_raise_and_facts_never_multiply(spark):
    frame = spark.createDataFrame
    tables = [
        frame([("s.M", "view", "s")], "metric_id string, source_type string, source_schema string"), frame([("S.m", True, True), ("s.M", False, True)], "metric_id string, parsed boolean, canonical boolean"),
        frame([("s.m", None), ("s.m", "x")], "metric_id string, error_category string"), frame([("s.M", ""), ("s.m", "logic")], "metric_id string, calculation_logic string"),
        frame([("m", "rejected"), ("M", "ok")], "metric_name string, status string"), frame([("R2", "s", "m", 2), ("R1", "S", "M", 3), ("R2", "s", "m", 9)], "report_name string, schema_name string, sql_object string, pos int"),
        frame([(None, "m", "collibra", "success"), ("s.m", "x", "fabric_pbi", "failed")], "asset_id string, name string, target string, status string"),
    ]
    assert [tuple(r) for r in governance.metric_journey(*tables).collect()] == [("s.M", "view", "s", True, True, "x", True, True, "ok", 2, "R2; R1", True, False)]
    with pytest.raises(PySparkException):
        governance.metric_journey(tables[0].unionByName(tables[0]), *tables[1:]).collect()
