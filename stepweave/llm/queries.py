"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import chat, clustering, embeddings, fingerprints, langid, mixing, negatives, packing, quality, sharding, simhash, substrings, toxicity
from stepweave.llm.common import sha256_hex, table


def _crc_mod(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return packing.pack(simhash.clustered(docs), cluster_col="cluster").withColumnRenamed("id", "doc_id")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    out = langid.with_language(docs.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "score")
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return quality.score_quality(table(spark, sf_dir, "documents"), trusted).withColumnRenamed("id", "doc_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", sha256_hex(F.col("kept")).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(turns.unionByName(extra))
    out = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha256_hex(spoken).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        sha256_hex(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    logp = toxicity.language_model(docs)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out), logp)
    out = toxicity.with_toxicity(docs, logp, model).select("row.doc_id", "score", "predicted")
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustering.clustered(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
    digest = sha256_hex(F.array_join(F.col("centroid").cast("array<string>"), ","))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "version")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_fingerprints, op2_best_fit, op3_language, op4_quality, op5_simhash, op6_substrings, op7_mixing, op8_chat, op9_toxicity, op10_embeddings,
        op11_centroids, op12_sharding, op13_hard_negatives,
    )
    return {f.__name__: f for f in found}


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)),
windows AS (
  SELECT *, CASE WHEN count(*) OVER w = 35 THEN string_agg(word, ' ') OVER w END AS win
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
repeated AS (SELECT win FROM windows WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
covered AS (
  SELECT doc_id, word, p, max(CASE WHEN r.win IS NULL THEN 0 ELSE 1 END)
    OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM windows LEFT JOIN repeated r USING (win)),
kept AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0) AS text
  FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(replace(replace(replace(text, '\', '\e'), '<', '\l'), '|', '\p')) AS text_chars,
    length(replace(replace(replace(role, '\', '\e'), '<', '\l'), '|', '\p')) + CASE WHEN role IN ('end', '+') THEN 2 ELSE 0 END AS role_chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (7 + sum(text_chars + CASE WHEN before IS NULL THEN 4 + role_chars WHEN before = role THEN 5 ELSE 11 + role_chars END))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP10_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
usable AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM vectors
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.v FROM reach r JOIN links l ON l.u = r.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN degree USING (vec_id)
"""


def _lloyd_sql(k: int = clustering.K, rounds: int = clustering.ROUNDS) -> str:
    """The rounds one after the other; distances as a.a - 2 a.c + c.c, which doubles hold exactly."""
    parts = [
        f"""vectors AS MATERIALIZED (
  SELECT vec_id, q, list_dot_product(q, q) AS qq FROM (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY mark) - 1 AS cluster, q AS c FROM (SELECT sha256('3:' || vec_id) AS mark, q FROM vectors ORDER BY mark LIMIT {k}))"""
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, any_value(q) AS q, min({{'d': (qq - 2 * list_dot_product(q, c) + list_dot_product(c, c))::BIGINT, 'cluster': cluster}}) AS best
  FROM vectors, c{i} GROUP BY vec_id)""")
        if i < rounds:
            parts.append(f"""m{i} AS (
  SELECT cluster, list(floor_mean ORDER BY axis) AS c FROM (
    SELECT cluster, axis, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::DOUBLE AS floor_mean FROM (
      SELECT best.cluster AS cluster, unnest(q)::BIGINT AS x, generate_subscripts(q, 1) AS axis FROM a{i}) GROUP BY cluster, axis) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m{i}.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} USING (cluster))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, best.cluster::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c::BIGINT[], ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.cluster = best.cluster"""


OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER best <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_centroids": _lloyd_sql(), "op13_hard_negatives": OP13_SQL, "op6_substrings": OP6_SQL, "op8_chat": OP8_SQL, "op10_embeddings": OP10_SQL}
