"""Literals by rule and place, findings, dispositions and redaction."""

import re

import pytest

from stepweave.operators import privacy

CASES = {
    "WHERE ssn = '123-45-6789'": [("contact_literal", "123-45-6789")],
    "WHERE email = 'a.b@example.com' OR phone = '312-555-1234'": [("contact_literal", "a.b@example.com"), ("contact_literal", "312-555-1234")],
    "WHERE peh.PAT_ENC_CSN_ID = 123456789": [("id_literal", "123456789")],
    "WHERE PAT_MRN_ID IN (1234567, 7654321, 1112223)": [("id_literal", "1234567"), ("id_literal", "7654321"), ("id_literal", "1112223")],
    "AND m.FLO_ID in ('9000002731','9000002732')": [("id_literal", "9000002731"), ("id_literal", "9000002732")],
    "WHERE PROVIDER_NAME LIKE '%SMITH%'": [("name_literal", "'%SMITH%'")],
    "BETWEEN '2023-01-01' AND '2023-12-31 23:59:59'": [("date_literal", "'2023-01-01'"), ("date_literal", "'2023-12-31 23:59:59'")],
    "WHERE lactate.RESULT_VALUE >= 2.0": [("threshold_literal", "2.0")],
    "WHERE dt BETWEEN @dStartDate AND @dEndDate": [],
    "WHERE ped.LINE = 1 AND x.GROUP_ID = 3": [],
    'CALCULATE([x], Patients[MRN] = "12345678")': [("id_literal", "12345678")],
    "d = '1/2/2023' AND x > 5 AND y_ID <> '1234567'": [("date_literal", "'1/2/2023'"), ("threshold_literal", "5"), ("id_literal", "1234567")],
    "USER_NAME = 'é@b.com' AND näme_ID = 55555": [("contact_literal", "é@b.com"), ("id_literal", "55555")],
    "": [],
    None: [],
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(CASES)), "id long, t string")


def test_every_rule_and_its_places(texts):
    got = {}
    for r in privacy.scan(texts, "id", "t").collect():
        got.setdefault(r.id, []).append((r.start, r.rule, r.matched_text))
        text = list(CASES)[r.id]
        assert text[r.start : r.end] == r.matched_text
        shown = text[max(0, r.start - 30) : r.start] + privacy.PLACEHOLDERS[r.rule] + text[r.end : r.end + 30]
        assert r.masked_context == shown.strip()
    for i, want in enumerate(CASES.values()):
        assert [x[1:] for x in sorted(got.get(i, []))] == sorted(want, key=lambda w: list(CASES)[i].index(w[1])), list(CASES)[i]


def test_spans_against_a_plain_loop(spark):
    """Overlaps go to the earlier rule, even where the later one starts before it."""
    parts = ["A_ID = 12345", "A_ID IN (12345, 312-555-1234, x)", "B_NAME = '2020-01-01'", "a.b@c.de", "x >= 123-45-6789", "'1/1/20'", "q\nr", 'N_NAME = "2020-01-01"', "z < 10.5"]
    rows = [(i, " ".join(parts[(i * k + k) % len(parts)] for k in range(1, 8))) for i in range(40)]
    got = {}
    for r in privacy.scan(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect():
        got.setdefault(r.id, set()).add((r.prio, r.rule, r.start, r.end))
    whole = lambda r: re.compile(("(?i)" if r[1].startswith("(?i)") else "") + f"({r[1].removeprefix('(?i)')})({r[2]}){r[3]}")
    for i, text in rows:
        kept = []
        spans = [(0, "id_literal", m.start(2) + n.start(), m.start(2) + n.end()) for m in whole(privacy.ID_LIST).finditer(text) for n in re.finditer(r"\d{5,}", m[2])]
        for k, rule in enumerate(privacy.RULES, start=1):
            spans += [(k, rule[0], *m.span(2)) for m in whole(rule).finditer(text)]
        for s in spans:
            if not any(o[2] < s[3] and s[2] < o[3] for o in kept):
                kept.append(s)
        assert got.get(i, set()) == set(kept), text


def test_findings_are_one_for_each_literal_and_owner(spark):
    sql = "WITH a AS (SELECT * FROM t WHERE patient_id = 1234567890),\nb AS (SELECT * FROM t WHERE patient_id = 1234567890)"
    rows = spark.createDataFrame([("m1", sql), ("m1", sql), ("m2", sql), (None, sql)], "id string, t string")
    found = privacy.findings(privacy.scan(rows, "id", "t")).collect()
    assert len(found) == 3 and len({r.finding_id for r in found}) == 3
    assert all("\n" not in r.masked_context and r.severity == "high" and r.disposition == "redact" for r in found)


def test_redaction_and_what_a_steward_said(spark):
    rows = [("a", "WHERE PAT_ENC_CSN_ID = 123456789 AND score >= 2"), ("b", "BETWEEN '2023-01-01' AND '2023-01-01 23:59:59'"), ("c", "WHERE PAT_MRN_ID = 1234567"), ("d", "WHERE age_days < 21"), ("e", None)]
    texts = spark.createDataFrame(rows, "id string, t string")
    found = privacy.findings(privacy.scan(texts, "id", "t"))
    out = {r.id: r.t for r in privacy.redacted(texts, found, "id", "t").collect()}
    assert out == {"a": "WHERE PAT_ENC_CSN_ID = <ID> AND score >= 2", "b": "BETWEEN <DATE> AND <DATE>", "c": "WHERE PAT_MRN_ID = <ID>", "d": "WHERE age_days < 21", "e": None}
    said = spark.createDataFrame([(r.finding_id, {"c": "allow", "d": "redact"}.get(r.id, "")) for r in found.collect()], "finding_id string, disposition string")
    out = {r.id: r.t for r in privacy.redacted(texts, privacy.with_dispositions(found, said), "id", "t").collect()}
    assert out["c"] == "WHERE PAT_MRN_ID = 1234567" and out["d"] == "WHERE age_days < <VALUE>" and out["a"].endswith(">= 2")


def test_nodes_and_measures(spark):
    expr = "WHERE PatientName = 'John Smith'"
    schema = "node_id string, layer string, metric_id string, sql_fragment string, expression_sql string, dax_expression string"
    rows = [("t", "transformation", "m1", expr, expr, None), ("d", "decision", "m1", None, expr, None), ("c", "canonical", "m1", expr, expr, None), ("o", "decision", "m2", None, expr, None)]
    nodes = spark.createDataFrame(rows, schema)
    found = privacy.findings(privacy.scan(nodes.where("node_id = 'd'"), "metric_id", "expression_sql"))
    out = {r.node_id: r for r in privacy.redacted_nodes(nodes, found).collect()}
    clean = "WHERE PatientName = <NAME>"
    assert (out["t"].sql_fragment, out["t"].expression_sql) == (clean, expr) and out["d"].expression_sql == clean
    assert out["c"].sql_fragment == expr and out["o"].expression_sql == expr and len(out) == 4
    measures = [("m", "measure", None, None, None, 'CALCULATE([x], Patients[MRN] = "12345678")'), ("k", "measure", None, None, None, "DIVIDE(SUM(T[a]), COUNTROWS(T))"), ("x", "technical", None, None, None, 'T[MRN] = "12345678"')]
    out = {r.node_id: r.dax_expression for r in privacy.redacted_measures(spark.createDataFrame(measures, schema)).collect()}
    assert out == {"m": 'CALCULATE([x], Patients[MRN] = "<ID>")', "k": "DIVIDE(SUM(T[a]), COUNTROWS(T))", "x": 'T[MRN] = "12345678"'}


def test_no_texts(spark):
    none = spark.createDataFrame([], "id long, t string")
    assert privacy.findings(privacy.scan(none, "id", "t")).count() == 0
