from pyspark.sql import functions as F

from stepweave.operators import records


def test_dictionaries(spark):
    own = spark.createDataFrame([("T", "ours"), (None, "none")], "name string, text string")
    more = spark.createDataFrame([("t", 1), ("U", 2), (None, 3)], "name string, size int")
    got = sorted(map(tuple, records.merge_dictionaries([own, more], "name").collect()), key=str)
    assert got == [("T", "ours", None), ("U", None, 2), (None, "none", None)]
    assert [tuple(r) for r in records.schema_collisions(more.withColumn("name", F.lit("x")), "name", "size").collect()] == [("X", "1,2,3")]


def test_no_references_cover_nothing(spark):
    empty = spark.createDataFrame([], "k long")
    assert tuple(records.dictionary_coverage(empty, empty, "k").first()) == (0, 0, 0.0)
    some = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    assert tuple(records.dictionary_coverage(some, some.where("k = 1"), "k").first()) == (2, 1, 0.5)


def test_projection_edges_account_for_every_reference(spark):
    refs = [("s", "A", "x"), ("s", "a", "X"), ("s", None, "x"), ("s", "b", "x"), ("s", None, "z"), ("s", "a", None), ("s", None, "both"), ("other", None, "x")]
    refs = spark.createDataFrame(refs, "step string, qualifier string, column_name string")
    tables = spark.createDataFrame([("s", "a", "t"), ("s", "u", "w")], "step string, alias string, table string")
    columns = spark.createDataFrame([("T", "x"), ("t", "both"), ("W", "both")], "table string, column_name string")
    got = {(r.step, r.qualifier, r.column_name): (r.n, r.minted, r.outcome) for r in records.projection_edges(refs, tables, columns).collect()}
    assert got == {
        ("s", None, "X"): (1, 1, "minted"),
        ("s", "A", "X"): (2, 0, "duplicate"),
        ("s", "B", "X"): (1, 0, "unresolved_qualifier"),
        ("s", None, "Z"): (1, 0, "no_dictionary_column"),
        ("s", "A", None): (1, 0, "no_column_name"),
        ("s", None, "BOTH"): (1, 0, "ambiguous"),
        ("other", None, "X"): (1, 0, "no_dictionary_column"),
    }


def test_plans_and_ages(spark):
    items = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", None)], "k string, h string")
    made = spark.createDataFrame([("a", "1", "ok"), ("a", "1", "ok"), ("b", "0", "ok"), ("b", "1", "rejected"), ("c", "0", "ok")], "k string, h string, s string")
    assert {r.k: r.plan for r in records.generation_plan(items, made, "k", "h", "s").collect()} == {"a": "reuse", "b": "retry", "c": "generate", "d": "generate"}
    stamps = spark.createDataFrame([(1, "2024-01-01"), (2, "soon"), (3, None), (4, "2024-01-30 10:00:00")], "k long, t string")
    assert {r.k: r.state for r in records.staleness(stamps, "k", "t", "2024-02-01", 14).collect()} == {1: "stale", 2: "unknown", 3: "unknown", 4: "fresh"}


def test_differences_and_gaps(spark):
    want = spark.createDataFrame([("p", True), ("q", False), ("r", None)], "f string, g boolean")
    got = spark.createDataFrame([("q", True), ("r", False), ("z", False)], "f string, g boolean")
    assert {r.f: r.difference for r in records.fact_diff(want, got, "f", "g").collect()} == {"p": "missing", "q": "grouping", "z": "extra"}
    assert {r.f: r.problem for r in records.cover_gaps(want, got, got.where("f = 'q'"), "f").collect()} == {"p": "neither", "q": "both", "z": "unknown"}
    documents = records.catalog_documents(spark.createDataFrame([(1, " a ", None), (2, " ", "b"), (3, None, "")], "k long, x string, y string"), "k", [F.col("x"), F.col("y")])
    assert {r.k: r.document for r in documents.collect()} == {1: "a", 2: "b"}
