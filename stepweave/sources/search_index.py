"""The search index: written whole beside the old one, and taken into use only when every row has its vector.

A refresh writes a folder of its own under the index and adds one row to ``published`` at the end. Readers take the last
run that was published, so a refresh that dies, or leaves rows without a vector, leaves the old index as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.operators.search import similar

COLUMNS = ("node_id", "kind", "ref", "name", "business_name", "search_text", "display_text")
#: Rows that an error names.
NAMED = 20


class SearchIndexError(RuntimeError):
    """Rows without a vector are left after a second try."""


def published(spark: SparkSession, path: str) -> str | None:
    """The run in use, or None where there is none yet."""
    try:
        runs = spark.read.schema("at bigint, run string").parquet(f"{path}/published")
        last = runs.orderBy(F.desc("at"), F.desc("run")).first()
    except Exception as error:  # Spark says that a path is missing in this way only
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return last.run if last else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """``COLUMNS`` and ``emb`` of the run in use."""
    run = published(spark, path)
    if run is None:
        raise SearchIndexError(f"no index has been published in {path}")
    return spark.read.parquet(f"{path}/runs/{run}").select(*COLUMNS, "emb")


def _has(vector: str):
    return F.coalesce(F.size(vector) > 0, F.lit(False))


def refresh(catalog: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, run: str, at: int, probe: list[float] | None = None, threshold: float = 0.35) -> dict:
    """Embeds every row of ``catalog`` and puts the result into use.

    ``embed`` gives ``(node_id, emb)`` for rows ``(node_id, search_text)``; it is asked once for all rows and once more for
    those it gave no vector. Rows that still have none raise, the longest of them named, and nothing is published. Columns
    go by name. ``run`` names this refresh, ``at`` orders refreshes. The rows nearer to ``probe`` than ``threshold``, a
    phrase that nothing should match, are reported.
    """
    spark, folder = catalog.sparkSession, f"{path}/runs/{run}"

    def filled(rows: DataFrame, part: str) -> DataFrame:
        vectors = embed(rows.select("node_id", "search_text")).groupBy("node_id").agg(F.first("emb", ignorenulls=True).alias("emb"))
        rows.select(*COLUMNS).join(vectors, "node_id", "left").write.mode("overwrite").parquet(f"{folder}/try={part}")
        return spark.read.parquet(f"{folder}/try={part}")

    first = filled(catalog, "1")
    counts = first.agg(F.count("*").alias("rows"), F.count_if(~_has("emb")).alias("missing")).first()
    missing = counts.missing
    if missing:
        second = filled(first.where(~_has("emb")).drop("emb"), "2")
        bad = second.where(~_has("emb"))
        missing = bad.count()
        if missing:
            named = bad.select("node_id", F.length("search_text").alias("n")).orderBy(F.desc("n"), "node_id").limit(NAMED).collect()
            raise SearchIndexError(f"{missing} of {counts.rows} rows have no vector: " + "; ".join(f"{r.node_id} (search_len={r.n})" for r in named))
        # The index proper: what the first try filled, and what the second did.
        whole = first.where(_has("emb")).select(*COLUMNS, "emb").unionByName(second.select(*COLUMNS, "emb"))
        folder, run = f"{path}/runs/{run}-whole", f"{run}-whole"
        whole.write.mode("overwrite").parquet(folder)
    spark.createDataFrame([(at, run)], "at bigint, run string").write.mode("append").parquet(f"{path}/published")
    near = similar(read(spark, path), probe, "emb", "node_id", threshold, 1).select("total_matches").first() if probe else None
    hits = near.total_matches if near else 0
    return {"rows": counts.rows, "embed_retried": bool(counts.missing), "missing_embeddings": missing, "refusal_probe_rows": hits, "threshold_ok": hits == 0}
