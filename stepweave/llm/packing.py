"""Best-fit packing of documents into training sequences under conflicts.

Documents go, largest first, to the bin with the least room that still takes them. A bin carries two bitmaps: the
sources it holds (each source has ``source_slots`` bits, set one after the other) and the duplicate clusters it holds.
The bins are kept in order of room; the search starts at the first bin with room enough and goes on to its successors
until it meets one whose bitmaps are free, which is the tightest compatible bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import durable, n_words, plain


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, source_slots: int) -> list[tuple[int, int]]:
    """``(bin, start)`` of each item; items come largest first and none is larger than ``capacity``."""
    order: list[tuple[int, int]] = []  # (room, bin), by room
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    source_at: dict = {}
    cluster_at: dict = {}
    all_slots = (1 << source_slots) - 1
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        shift = source_slots * source_at.setdefault(source, len(source_at))
        mark = 0 if cluster is None else 1 << cluster_at.setdefault(cluster, len(cluster_at))
        at = bisect_left(order, (size, -1))
        while at < len(order):
            room, k = order[at]
            held = (source_bits[k] >> shift) & all_slots
            if held != all_slots and not cluster_bits[k] & mark:
                break
            at += 1
        else:
            room, k, held = capacity, len(source_bits), 0
            source_bits.append(0)
            cluster_bits.append(0)
        if at < len(order):
            order.pop(at)
        source_bits[k] |= (held + 1) << shift  # the slots fill from the lowest bit: held is 0, 1, 3, 7 ...
        cluster_bits[k] |= mark
        out.append((k, capacity - room))
        insort(order, (room - size, k))
    return out


def _pack_shard(capacity: int, source_slots: int):
    def pack(key, table):
        table = table.sort_by([("size", "descending"), ("id", "ascending"), ("th", "ascending"), ("piece", "ascending")])
        col = {name: table.column(name).to_pylist() for name in ("size", "source", "cluster")}
        places = best_fit(col["size"], col["source"], col["cluster"], capacity, source_slots)
        return pa.table({
            "id": table.column("id"), "piece": table.column("piece"), "first_word": table.column("first_word"), "size": table.column("size"),
            "shard": pa.array([key[0].as_py()] * len(places), pa.int64()), "bin": pa.array([p[0] for p in places], pa.int32()), "start": pa.array([p[1] for p in places], pa.int32()),
        })

    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = 4096, source_slots: int = 8, shard_rows: int = 4096) -> DataFrame:
    """``(id, piece, first_word, size, shard, bin, start)``: where each piece of each document lies.

    A bin is ``(shard, bin)`` and holds up to ``capacity`` words; a piece fills it from word ``start`` on. A document of
    more than ``capacity`` words is cut into pieces of that size and a rest, in order; others are one piece. No bin holds
    two documents of a duplicate cluster (``cluster_col``; without one, documents of equal text), pieces of one document
    included, nor more than ``source_slots`` of one source. Null texts have no words and take a place without room; a
    null source is a source; a null cluster conflicts with none. Repeated ids are documents of their own. An empty
    table gives an empty result. Shards of about ``shard_rows`` pieces, dealt by hash, are packed each by one task; only
    sizes and hashes move, never texts.
    """
    named = {"id": id_col, "text": text_col, "source": source_col} | ({"cluster": cluster_col} if cluster_col else {})
    rows = plain(docs, **named)
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    cluster = F.col("cluster").cast("string") if cluster_col else F.concat_ws(":", th, F.xxhash64(F.lit("second"), F.coalesce("text", F.lit(""))))
    rows = durable(rows.select("id", th.alias("th"), "source", cluster.alias("cluster"), n_words(F.col("text")).alias("words")))  # words are counted once
    total = rows.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("words") / capacity)))).first()[0] or 0
    shards = max(1, -(-total // shard_rows))
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.ceil(F.col("words") / capacity) - 1).cast("int")))).alias("piece"))
    first = F.col("piece").cast("long") * capacity
    pieces = pieces.select("id", "th", "source", "cluster", "piece", first.alias("first_word"), F.least(F.lit(capacity), F.col("words") - first).cast("int").alias("size"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "th", "piece"), F.lit(shards)))
    kind = dict(pieces.dtypes)["id"]
    return pieces.groupBy("shard").applyInArrow(_pack_shard(capacity, source_slots), f"id {kind}, piece int, first_word bigint, size int, shard bigint, bin int, start int")
