"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target over source size. Its whole part is taken
outright; the fractions are rounded by the pivotal method: two units at a time exchange mass at random, in words and
without bias, until one of them is whole. A task rounds one bucket of a source and passes on its one unsettled unit; a
reduction tree over the buckets combines those until one is left per source, which is rounded alone. A source's taken
words so differ from its target by less than one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.common import durable, n_words, plain

#: Weights of the sources in code point order, repeating; share of all words that the mix takes; most copies.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row a source.

    Sources in code point order, null last, weigh ``weights`` over and over; targets share ``share`` of all words by
    weight but stop at ``most`` times the source, and what that leaves over is shared again. That is one level L with
    target = min(cap, weight * L), found by running sums over the sources in the order in which they reach their caps.
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.select("source", F.col("source_size").cast("long").alias("source_size"), (F.row_number().over(order) - 1).alias("rank"))
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    every = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    used, gone = F.coalesce(F.sum("cap").over(filling), F.lit(0.0)), F.coalesce(F.sum("weight").over(filling), F.lit(0.0))
    ranked = ranked.withColumn("level", (total - used) / (F.sum("weight").over(every) - gone))
    valid = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)
    level = F.coalesce(valid["level"], F.lit(float("inf")))  # a share above all caps together leaves every source at its cap
    return ranked.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


_UNIT = "id {id}, th bigint, n int, source {source}, size bigint, bucket bigint, p double"


def _round_bucket(level: int):
    """Rounds the fractions of one bucket; at most one unit stays between zero and one."""

    def pivot(key, table):
        table = table.sort_by([("size", "descending"), ("th", "ascending"), ("n", "ascending"), ("id", "ascending")])  # large units first: many smaller ones are left to settle them
        p = table.column("p").to_numpy().copy()
        size = table.column("size").to_numpy().astype(float)
        rng = np.random.default_rng(xxhash.xxh64_intdigest(repr((level, *(k.as_py() for k in key))), 7))
        draws = rng.random(len(p))
        held = -1
        for i in np.flatnonzero((p > 0) & (p < 1)):
            if held < 0:
                held = i
                continue
            a, b = held, i
            up = min((1 - p[a]) * size[a], p[b] * size[b])
            down = min(p[a] * size[a], (1 - p[b]) * size[b])
            if draws[i] * (up + down) < down:
                whole_a = (1 - p[a]) * size[a] <= p[b] * size[b]
                pa_, pb_ = (1.0, p[b] - up / size[b]) if whole_a else (p[a] + up / size[a], 0.0)
            else:
                whole_b = (1 - p[b]) * size[b] <= p[a] * size[a]
                pa_, pb_ = (p[a] - down / size[a], 1.0) if whole_b else (0.0, p[b] + down / size[b])
            p[a], p[b] = min(max(pa_, 0.0), 1.0), min(max(pb_, 0.0), 1.0)
            held = a if 0 < p[a] < 1 else b if 0 < p[b] < 1 else -1
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))

    return pivot


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, bucket_rows: int = 4096, fan: int = 256) -> DataFrame:
    """``(id, th, n, source, size, source_size, target, copies)``, one row for each row of ``docs``.

    ``size`` is the number of words (null text: none), ``copies`` how often the mix takes the row (0, 1 or up to
    ``most``). Rows without words are taken the whole part of the source's rate. Null sources are one source, the last
    by order. Equal rows are told apart by ``n`` and drawn one by one; ``th`` hashes the text. Draws depend on the rows
    alone, so reruns agree. An empty table gives an empty result. No text leaves its scan; a hot source is many buckets.
    """
    rows = plain(docs, id=id_col, text=text_col, source=source_col).select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "source", n_words(F.col("text")).alias("size"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("id", "th", "source").orderBy("size")))
    rows = durable(rows)
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    aims = durable(targets(stats, weights, share, most).join(stats.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = aims.select(F.col("source").alias("aim"), "source_size", "target", rate.alias("rate"), F.ceil(F.col("rows") / bucket_rows).cast("long").alias("buckets"))
    drawn = rows.join(aims, F.col("source").eqNullSafe(F.col("aim")))
    fraction = F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(F.lit(0.0))
    units = drawn.withColumn("bucket", F.pmod(F.xxhash64("th", "n", "id"), F.col("buckets"))).withColumn("p", fraction)
    fields = dict(rows.dtypes)
    schema = _UNIT.format(id=fields["id"], source=fields["source"])
    names = ["id", "th", "n", "source", "size", "bucket", "p"]
    most_buckets = aims.agg(F.max("buckets")).first()[0] or 1
    level, open_units, settled = 0, units.select(names), []
    while True:
        done = durable(open_units.groupBy("source", "bucket").applyInArrow(_round_bucket(level), schema))
        unsettled = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(done.where(~unsettled))
        if most_buckets <= 1:
            last = done.where(unsettled)
            coin = F.pmod(F.xxhash64("th", "n", "id", F.lit("coin")), F.lit(1 << 30)) / F.lit(float(1 << 30))
            settled.append(last.withColumn("p", F.when(coin < F.col("p"), 1.0).otherwise(0.0)))
            break
        open_units = done.where(unsettled).withColumn("bucket", F.floor(F.col("bucket") / fan).cast("long"))
        most_buckets, level = -(-most_buckets // fan), level + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    out = out.join(aims, F.col("source").eqNullSafe(F.col("aim")))
    return out.select("id", "th", "n", "source", "size", "source_size", "target", (F.floor("rate") + F.round("p")).cast("int").alias("copies"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns."""
    chosen = mix(docs, id_col, text_col, source_col, **options).where("copies > 0").select(F.col("id").alias("m_id"), F.col("th").alias("m_th"), F.col("n").alias("m_n"), F.col("source").alias("m_source"), "copies")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("row", F.col("row")[id_col].alias("id"), F.col("row")[source_col].alias("source"), F.xxhash64(F.coalesce(F.col("row")[text_col], F.lit(""))).alias("th"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("id", "th", "source").orderBy("th")))
    same = F.col("id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")) & F.col("source").eqNullSafe(F.col("m_source")) & (F.col("n") == F.col("m_n"))
    return rows.join(chosen, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
