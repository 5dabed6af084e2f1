"""The stages one by one against what each promises, and the queries' contracts on the smallest tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from stepweave.llm import queries
from tests.llm.test_near_copies import groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, seen, SF)
        rows = out.collect()
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if name == "language_id":
            assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()} and len(rows) > 0.97 * docs.count()
        if name == "near_duplicates":
            texts = [r.text for r in sorted(seen.collect(), key=lambda r: r.doc_id)]
            ids = sorted(r.doc_id for r in seen.collect())
            assert sorted(r.doc_id for r in rows) == sorted(ids[g[0]] for g in groups(texts))
        if name == "repeated_passages":
            windows = Counter(tuple(r.text.split()[i : i + 35]) for r in seen.collect() for i in range(len(r.text.split()) - 34))
            before = {r.doc_id: r.text for r in seen.collect()}
            for r in rows:
                if all(windows[tuple(before[r.doc_id].split()[i : i + 35])] == 1 for i in range(len(before[r.doc_id].split()) - 34)):
                    assert r.text == before[r.doc_id]
        if name == "pack_sequences":
            assert sum(r.size for r in rows) == sum(len(r.text.encode().split()) for r in seen.collect())
        if k < 4:
            seen = spark.createDataFrame(rows, docs.schema)
    assert len(cp.STAGES) == 5 and cp.run(spark, SF).count() == len(rows)


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    rows = [(1, "ein Wort", "de", None, None, "x"), (1, "ein Wort", "de", None, None, "x"), (None, "deux mots", "fr", "s", 1, "x"), (2, None, None, "s", 1, "x"), (3, "", "fr", "s", 1, "x")]
    docs = spark.createDataFrame(rows, schema)
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0
        stage(spark, docs, SF).count()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_columns(spark, name):
    wanted = {
        "op1_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op2_best_fit": "doc_id", "op3_language": "doc_id held_out lang_pred score",
        "op4_quality": "doc_id perplexity", "op5_simhash": "doc_id fingerprint component_id", "op6_substrings": "doc_id n_words n_removed kept_sha256", "op7_mixing": "doc_id size source_size target taken",
        "op8_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op9_toxicity": "doc_id held_out score predicted", "op10_embeddings": "vec_id n_links component_id kept",
        "op11_centroids": "vec_id cluster distance cluster_inertia inertia centroid_sha256", "op12_sharding": "doc_id size text_crc32 law shard slot grown_shard",
        "op13_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    }
    out = queries.queries()[name](spark, SF)
    assert set(wanted[name].split()) <= set(out.columns)
    if "score" in out.columns:
        assert out.where((F.col("score") < 0) | (F.col("score") > 1) | F.col("score").isNull()).count() == 0
