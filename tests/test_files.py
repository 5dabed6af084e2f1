"""Sources that are missing or odd, and sinks that never write over what they should add to."""

import json

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException

from stepweave.sources import files


def test_folders_with_labels_fail_together(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "one.sql").write_text(f"CREATE VIEW {name}.v AS SELECT 1")
    rows = files.sql_folders(spark, [(f"{tmp_path}/b", "view", "x"), (f"{tmp_path}/a", "procedure", "y")]).orderBy("folder_no").collect()
    assert [(r.schema, r.source_type, r.source_schema, r.folder_no) for r in rows] == [("b", "view", "x", 0), ("a", "procedure", "y", 1)]
    with pytest.raises(AnalysisException):
        files.sql_folders(spark, [(f"{tmp_path}/a", "view", "x"), (f"{tmp_path}/none", "view", "x")])


def test_dictionaries(spark, tmp_path):
    (tmp_path / "t.csv").write_text("TABLE_NAME,TABLE_ID\nA,1\nB,2\n")
    tables = files.dictionary_csv(spark, f"{tmp_path}/t.csv", ["TABLE_NAME"], ("DESCRIPTION", "table_id"))
    assert tables.columns == ["TABLE_NAME", "TABLE_ID", "DESCRIPTION"] and tables.where("DESCRIPTION IS NULL").count() == 2
    columns = spark.createDataFrame([("1", "x"), ("9", "y")], "TABLE_ID string, COLUMN_NAME string")
    got = {(r.COLUMN_NAME, r.TABLE_NAME) for r in files.id_keyed_columns(columns, tables.unionByName(tables)).collect()}
    assert got == {("x", "A"), ("y", None)}
    told = spark.createDataFrame([("t", "old", 1), ("T", "new", 2), ("u", None, 1)], "TABLE_NAME string, DESCRIPTION string, pos int")
    refs = spark.createDataFrame([("T",), ("U",), ("zz",)], "TABLE_NAME string")
    assert {(r.TABLE_NAME, r.description) for r in files.looked_up(refs, told).collect()} == {("T", "new"), ("U", ""), ("zz", "")}


def test_lines_and_recorded_rows(spark, tmp_path):
    path = f"{tmp_path}/events"
    assert files.event_lines(spark, path).count() == 0
    events = spark.createDataFrame([("t1", None), ("t2", "q")], "event_at string, question string")
    files.append_events(events, path)
    files.append_events(events.limit(1), path)
    (tmp_path / "events" / "other.txt").write_text("no event")
    lines = sorted(r.value for r in files.event_lines(spark, path).collect())
    assert len(lines) == 3 and [json.loads(x) for x in lines[::2]] == [{"event_at": "t1", "question": None}, {"event_at": "t2", "question": "q"}]
    (tmp_path / "r.json").write_text(json.dumps([{"a": "x", "n": 1}, {"a": None, "n": 2}]))
    assert [tuple(r) for r in files.recorded(spark, f"{tmp_path}/r.json", "a string, n int").collect()] == [("x", 1), (None, 2)]
    (tmp_path / "r.json").write_text('[{"a": "x", "n": "many"}]')
    with pytest.raises((PySparkException, Py4JError)):
        files.recorded(spark, f"{tmp_path}/r.json", "a string, n int").collect()


def test_history_is_added_to_and_never_replaced(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS sinks LOCATION '{tmp_path}/db'")
    rows = spark.createDataFrame([(1, "a")], "n int, s string")
    files.append_table(rows, "sinks.history")
    files.append_table(rows.select("s", "n"), "sinks.history")
    assert [tuple(r) for r in spark.table("sinks.history").select("n", "s").collect()] == [(1, "a"), (1, "a")]
    for odd in (rows.drop("s"), rows.withColumn("more", rows.n), rows.withColumn("n", rows.n.cast("string"))):
        with pytest.raises(ValueError):
            files.append_table(odd, "sinks.history")
    assert spark.table("sinks.history").count() == 2
    assert files.snapshot(spark, "sinks.history", "sinks.golden").count() == 2
    files.append_table(rows, "sinks.history")
    assert spark.table("sinks.golden").count() == 2 and files.snapshot(spark, "sinks.history", "sinks.golden").count() == 3
    files.overwrite_table(rows.drop("s"), "sinks.golden")
    assert spark.table("sinks.golden").columns == ["n"]
    spark.sql("DROP DATABASE sinks CASCADE")
