"""Queries over literals that should not leave, with SQL that finds their positions on its own; ``catalog`` registers them.

Two kinds of text: the documents, and statements that the orders of each customer make, which name ids, an id list, a
name, dates and thresholds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stepweave.catalog import _query, _t
from stepweave.operators import privacy

STATEMENTS_SQL = """statements AS (
  SELECT c_custkey AS id, 'SELECT * FROM ORDERS o' || chr(10) || 'WHERE o.ORDER_NBR IN (' || string_agg(o_orderkey + 10000, ', ' ORDER BY o_orderkey) || ') AND c.CUST_ID = '
    || (c_custkey + 99000) || ' AND c.CUSTOMER_NAME = ''' || c_name || ''' AND o.PLACED >= ''' || strftime(min(o_orderdate), '%Y-%m-%d') || ''' AND [o].[TOTAL] > '
    || max(o_totalprice)::DECIMAL(18, 2) || ' -- see ' || lower(c_mktsegment) || '@example.com or 312-555-' || (1000 + c_custkey % 9000) AS text
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey, c_name, c_mktsegment)"""


def statements(spark, d):
    joined = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    own = joined.groupBy("c_custkey", "c_name", "c_mktsegment").agg(
        F.array_sort(F.collect_list("o_orderkey")).alias("keys"), F.min("o_orderdate").alias("first"), F.max("o_totalprice").alias("most"))
    listed = F.array_join(F.transform("keys", lambda k: (k + 10000).cast("string")), ", ")
    key = F.col("c_custkey")
    text = F.concat(
        F.lit("SELECT * FROM ORDERS o\nWHERE o.ORDER_NBR IN ("), listed, F.lit(") AND c.CUST_ID = "), (key + 99000).cast("string"), F.lit(" AND c.CUSTOMER_NAME = '"), F.col("c_name"),
        F.lit("' AND o.PLACED >= '"), F.date_format("first", "yyyy-MM-dd"), F.lit("' AND [o].[TOTAL] > "), F.col("most").cast("decimal(18,2)").cast("string"), F.lit(" -- see "),
        F.lower("c_mktsegment"), F.lit("@example.com or 312-555-"), (key % 9000 + 1000).cast("string"),
    )
    return own.select(key.alias("id"), text.alias("text"))


def _pattern(rule: tuple, group: int = 0) -> str:
    _, before, literal, after = rule
    case = "(?i)" if before.startswith("(?i)") else ""
    return (f"{case}({before.removeprefix('(?i)')})({literal}){after}").replace("'", "''")


def _places_sql(rule: tuple, prio: int, source: str) -> str:
    """Matches of one rule in ``source`` (id, text, base): the gaps between matches and the matches add up to their places."""
    p = _pattern(rule)
    return f"""SELECT id, {prio} AS prio, '{rule[0]}' AS rule, (base + place + length(ahead))::INTEGER AS s, (base + place + length(ahead) + length(found))::INTEGER AS e FROM (
    SELECT id, base, ahead, found, (sum(length(gap) + length(whole)) OVER (PARTITION BY id, base ORDER BY k) - length(whole)) AS place FROM (
      SELECT id, base, generate_subscripts(w, 1) AS k, unnest(w) AS whole, unnest(regexp_extract_all(text, '{p}', 1)) AS ahead, unnest(regexp_extract_all(text, '{p}', 2)) AS found,
        unnest(regexp_split_to_array(text, '{p}')[1:len(w)]) AS gap FROM (SELECT *, regexp_extract_all(text, '{p}', 0) AS w FROM {source}) WHERE len(w) > 0))"""


def _spans_sql(texts: str) -> str:
    """``found`` (id, prio, rule, s, e) over ``texts`` (id, text): spans in rule order, each kept unless one before overlaps."""
    rules = " UNION ALL ".join(_places_sql(r, k, "plain") for k, r in enumerate(privacy.RULES, start=1))
    return f"""{texts}, plain AS (SELECT id, text, 0 AS base FROM texts WHERE text IS NOT NULL),
lists AS (SELECT l.id, substr(text, s + 1, e - s) AS text, s AS base FROM ({_places_sql(privacy.ID_LIST, 0, "plain")}) l JOIN plain p ON p.id = l.id),
every AS ({_places_sql(privacy.LIST_MEMBER, 0, "lists")} UNION ALL {rules}),
folded AS (
  SELECT id, list_reduce(list([{{'prio': prio, 's': s, 'e': e, 'rule': rule}}] ORDER BY prio, s),
    lambda held, x: CASE WHEN len(list_filter(held, lambda h: h.s < x[1].e AND x[1].s < h.e)) > 0 THEN held ELSE list_concat(held, x) END) AS spans FROM every GROUP BY id),
found AS (SELECT id, sp.prio AS prio, sp.rule AS rule, sp.s AS s, sp.e AS e FROM (SELECT id, unnest(spans) AS sp FROM folded))"""


def _case(values: dict[str, str]) -> str:
    return "CASE rule " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


DOCUMENTS = "texts AS (SELECT doc_id AS id, text FROM documents)"
OF_STATEMENTS = STATEMENTS_SQL + ", texts AS (SELECT id, text FROM statements)"
_SHOWN = f"""trim(replace(substr(text, greatest(s - {privacy.CONTEXT}, 0) + 1, s - greatest(s - {privacy.CONTEXT}, 0)) || {_case(privacy.PLACEHOLDERS)}
  || substr(text, e + 1, {privacy.CONTEXT}), chr(10), ' '), ' ' || chr(9) || chr(13) || chr(11) || chr(12) || chr(160) || chr(8239) || chr(8195))"""
_SPANS = "SELECT id, rule, prio, s AS \"start\", e AS \"end\", substr(text, s + 1, e - s) AS matched_text, {shown} AS masked_context FROM found JOIN texts USING (id)"
_REDACTED = """, chosen AS (SELECT DISTINCT id, rule, substr(text, s + 1, e - s) AS m FROM found JOIN texts USING (id) WHERE {which}),
g AS (SELECT id, list(rule || chr(1) || m ORDER BY length(m) DESC, rule, m) AS held FROM chosen GROUP BY id)
SELECT id, sha256(CASE WHEN held IS NULL THEN text ELSE list_reduce(list_concat([text], held), lambda t, x: replace(t, split_part(x, chr(1), 2), {mark})) END) AS redacted
FROM texts LEFT JOIN g USING (id) WHERE text IS NOT NULL"""
_MARK = _case(privacy.PLACEHOLDERS).replace("CASE rule", "CASE split_part(x, chr(1), 1)")


@_query(f"WITH {_spans_sql(DOCUMENTS)} {_SPANS.format(shown=_SHOWN)}")
def q_privacy_scan(spark, d):
    return privacy.scan(_t(spark, d, "documents"), "doc_id", "text")


@_query(f"WITH {_spans_sql(OF_STATEMENTS)} {_SPANS.format(shown=_SHOWN)}")
def q_privacy_statements(spark, d):
    return privacy.scan(statements(spark, d), "id", "text")


@_query(f"""WITH {_spans_sql(OF_STATEMENTS)}, one AS (SELECT id, rule, substr(text, s + 1, e - s) AS matched_text, prio, s, {_SHOWN} AS shown FROM found JOIN texts USING (id))
SELECT left(sha256(id || '|' || rule || '|' || matched_text), 16) AS finding_id, id, rule, matched_text, arg_min(shown, prio::BIGINT * 1000000000 + s) AS masked_context,
  {_case(privacy.SEVERITY)} AS severity, {_case(privacy.DISPOSITION)} AS disposition FROM one GROUP BY id, rule, matched_text""")
def q_privacy_findings(spark, d):
    return privacy.findings(privacy.scan(statements(spark, d), "id", "text"))


@_query(f"WITH {_spans_sql(DOCUMENTS)}" + _REDACTED.format(which=f"{_case(privacy.DISPOSITION)} = 'redact'", mark=_MARK))
def q_privacy_redact_literals(spark, d):
    docs = _t(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    found = privacy.findings(privacy.scan(docs, "id", "text"))
    return privacy.redacted(docs, found, "id", "text").select("id", F.sha2("text", 256).alias("redacted"))


@_query(f"WITH {_spans_sql(OF_STATEMENTS)}" + _REDACTED.format(which="rule <> 'name_literal'", mark=_MARK))
def q_privacy_redact(spark, d):
    """A steward has allowed all names and has all thresholds redacted."""
    texts = statements(spark, d)
    found = privacy.findings(privacy.scan(texts, "id", "text"))
    said = F.when(F.col("rule") == "name_literal", "allow").when(F.col("rule") == "threshold_literal", "redact").otherwise("")
    found = privacy.with_dispositions(found, found.select("finding_id", said.alias("disposition")))
    return privacy.redacted(texts, found, "id", "text").select("id", F.sha2("text", 256).alias("redacted"))
