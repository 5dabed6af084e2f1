"""Refreshing the search index: one retry, offenders by name, and the old index whole whatever happens."""

import pytest
from pyspark.sql import functions as F

from stepweave.sources import search_index

ROWS = "node_id string, kind string, ref string, name string, business_name string, search_text string, display_text string"


def catalog(spark, n, tag="a"):
    return spark.createDataFrame([(f"n{k}", "metric", f"r{k}", f"name {k}", None, f"{tag} {k}" + "x" * k, "shown") for k in range(n)], ROWS)


class Embedder:
    """Gives no vector for some rows, a number of times."""

    def __init__(self, fails, times):
        self.fails, self.times, self.asked = fails, times, []

    def __call__(self, rows):
        self.asked.append(rows.count())
        vector = F.array(F.length("search_text").cast("float"), F.lit(1.0).cast("float"))
        ok = ~F.col("node_id").isin(*self.fails) if len(self.asked) <= self.times else F.lit(True)
        return rows.select("node_id", F.when(ok, vector).alias("emb")).where("node_id <> 'n1' OR emb IS NOT NULL")


def test_a_refresh_is_taken_into_use_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path)
    assert search_index.published(spark, path) is None
    with pytest.raises(search_index.SearchIndexError):
        search_index.read(spark, path)
    first = Embedder(["n1", "n2"], 1)
    out = search_index.refresh(catalog(spark, 5), first, path, "one", 1, [0.0, -1.0])
    assert out == {"rows": 5, "embed_retried": True, "missing_embeddings": 0, "refusal_probe_rows": 0, "threshold_ok": True} and first.asked == [5, 2]
    held = sorted(map(tuple, search_index.read(spark, path).collect()), key=str)
    assert len(held) == 5 and all(r[-1] for r in held)
    with pytest.raises(search_index.SearchIndexError, match=r"2 of 6 rows.*n2 .*; n1 "):
        search_index.refresh(catalog(spark, 6, "b"), Embedder(["n1", "n2"], 2), path, "two", 2)

    def dies(rows):
        raise RuntimeError("gone")

    with pytest.raises(RuntimeError, match="gone"):
        search_index.refresh(catalog(spark, 6, "c"), dies, path, "three", 3)
    assert sorted(map(tuple, search_index.read(spark, path).collect()), key=str) == held
    out = search_index.refresh(catalog(spark, 7, "d").select(*reversed(search_index.COLUMNS)), Embedder([], 0), path, "four", 4, [1.0, 0.0])
    assert out["rows"] == 7 and not out["embed_retried"] and not out["threshold_ok"]
    assert {r.search_text[0] for r in search_index.read(spark, path).collect()} == {"d"}
