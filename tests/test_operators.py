import json

import pytest

from stepweave.functions import text as tx
from stepweave.operators import changes, contracts, products
from stepweave.plans import graph
from stepweave.sources import files
from stepweave.streaming import events as ev
from pyspark.sql import functions as F


def test_walks_end_on_cycles_and_differ(spark):
    nodes = spark.createDataFrame([("canonical:a", "canonical", "a"), ("transform:x", "transformation", "x"), ("transform:y", "transformation", "y"), ("tech:t", "technical", "t")], "node_id string, layer string, name string")
    edges = spark.createDataFrame([("canonical:a", "transform:x", graph.C2T), ("transform:x", "transform:y", graph.T2T), ("transform:y", "transform:x", graph.T2T), ("transform:x", "decision:d", "step_to_decision"), ("decision:d", "tech:t", "decision_to_column")], "source_id string, target_id string, edge_type string")
    assert [tuple(r) for r in graph.uses_table(nodes, edges).collect()] == [("canonical:a", "tech:t")]
    assert [tuple(r) for r in graph.calculated_by(nodes, edges).orderBy("step_no").collect()] == [("canonical:a", "transform:x", 1), ("canonical:a", "transform:y", 2)]
    assert [tuple(r) for r in graph.validator_walk(nodes, edges).collect()] == [("canonical:a", 2, 0)]
    assert graph.dangling_edges(nodes, edges).count() == 2


def test_contracts(spark):
    df = spark.createDataFrame([("A", "x"), ("a", "y"), (None, None)], "id string, kind string")
    assert contracts.unique_violations(df, ["id"], fold_case=True).collect()[0]["n"] == 2
    assert contracts.allowed_violations(df, "kind", ["x"]).collect()[0]["value"] == "y"
    found = contracts.check(df, contracts.Contract("t", (("id", "string", False), ("more", "integer", True))))
    assert [(r.rule, r.detail) for r in found] == [("column", "more")]
    assert contracts.Contract("t", (("id", "string", False),)).schema().fieldNames() == ["id"]


def test_changes(spark):
    a = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "k long, h string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "n")], "k long, h string")
    assert {r.k: r.change for r in changes.change_data(a, b, "k", "h").collect()} == {1: "deleted", 2: "changed", 3: "unchanged", 4: "new"}
    assert {r.k: r.h for r in changes.upsert(a, b, "k").collect()} == {1: "p", 2: "z", 3: None, 4: "n"}
    same = spark.createDataFrame([("SELECT  1",), ("select 1 ",)], "sql string").select(changes.change_hash(F.col("sql")).alias("h"))
    assert same.distinct().count() == 1


def test_identity_and_mentions(spark):
    df = spark.createDataFrame([("CREATE OR ALTER PROCEDURE [rep].[usp_x] AS SELECT 1",), ("create view v_a as select 2",), ("select 3",)], "sql string")
    out = [r[0] for r in df.select(tx.object_identity(F.col("sql"))).collect()]
    assert [tuple(x) if x else None for x in out] == [("rep", "usp_x", "procedure"), ("dbo", "v_a", "view"), None]
    df = spark.createDataFrame([("the ED_SEPSIS rule",), ("AGGREGATED",)], "t string")
    assert [r[0] for r in df.select(tx.mentions(F.col("t"), "ed")).collect()] == [True, False]


def test_products(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, ""), (4, None)], "id long, t string")
    assert [(r.members, r.first_id) for r in products.content_partition(df, "id", "t").collect()] == [(2, 1)]


def test_sources(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "one.sql").write_text("CREATE VIEW s.v AS\r\nSELECT 1")
    (tmp_path / "two.sql").write_text("SELECT 2")
    rows = {r.name: r for r in files.sql_files(spark, str(tmp_path)).collect()}
    assert rows["v"].schema == "s" and rows["v"].kind == "view" and "\r" not in rows["v"].sql and rows["two"].schema == "dbo"
    (tmp_path / "d.csv").write_text("TABLE_NAME,DESCRIPTION\nA,x\na,y\n")
    with pytest.raises(ValueError):
        files.dictionary_csv(spark, str(tmp_path / "d.csv"), ["TABLE_NAME"])


def test_events_batch_and_stream(spark, tmp_path):
    lines = [json.dumps({"event_at": "t1", "conversation_id": "c", "turn_index": 0, "question": "q", "answered": True}), json.dumps({"event_at": "t2", "conversation_id": "c", "turn_index": 0, "verdict": "up"}), "{broken"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    batch = ev.parse_events(spark.read.text(str(tmp_path / "in")))
    assert sorted(r.kind for r in batch.collect()) == ["feedback", "malformed", "turn"]
    stream = ev.parse_events(spark.readStream.text(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("events_seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("events_seen").collect())) == sorted(map(str, batch.collect()))
    assert ev.new_events(batch.where("kind = 'turn'"), batch.where("kind = 'turn'")).count() == 0
