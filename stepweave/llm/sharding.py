"""Sharding by fixed virtual slots, in DataFrame and SQL expressions only.

Every record hashes into one of some thousands of virtual slots, and that never changes. What changes is the map from
slots to shards: it starts as ``slot % shards``, is edited when the bytes of the slots ask for it, and every edit is a row
``(version, vslot, shard)`` that is stored and never overwritten. A record's shard is looked up in the map of a version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.common import durable, plain

SHARDS, SLOTS = 40, 4096
#: Bytes of a record besides its text.
OVERHEAD = 16
#: Equal records that hash together; further ones hash on their own, or a record repeated often would be one slot.
TOGETHER = 64


def virtual_slot(*record: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*record), F.lit(slots)).cast("int")


def text_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``(id, th, size, text_crc32, chunk, n, vslot)``: equal records counted, in chunks of up to ``TOGETHER``.

    Records are equal if id and text are; they are counted before they are shuffled, however many there are.
    """
    text = F.coalesce("text", F.lit(""))
    rows = plain(docs, id=id_col, text=text_col).select("id", F.xxhash64(text).alias("th"), (text_bytes(F.col("text")) + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    same = rows.groupBy("id", "th", "size", "text_crc32").agg(F.count("*").alias("copies"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / TOGETHER)))
    same = same.select("*", chunk.alias("chunk"))
    n = F.least(F.lit(TOGETHER), F.col("copies") - F.col("chunk") * TOGETHER).cast("int")
    return same.select("id", "th", "size", "text_crc32", "chunk", n.alias("n"), virtual_slot(F.col("id"), F.col("th"), F.col("chunk"), slots=slots).alias("vslot"))


def slot_bytes(found: DataFrame) -> DataFrame:
    """``(vslot, bytes)`` of ``records``, a row a slot that has some."""
    return found.groupBy("vslot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"))


def first_map(spark, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 0: ``(version, vslot, shard)``, whatever the data."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("vslot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def current_map(edits: DataFrame, version: int | None = None) -> DataFrame:
    """``(vslot, shard)`` after all edits, or those up to ``version``."""
    upto = edits if version is None else edits.where(F.col("version") <= version)
    return upto.groupBy("vslot").agg(F.max_by("shard", "version").alias("shard"))


def rebalance(edits: DataFrame, weights: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The edits ``(version, vslot, shard)`` that level the shards; none if they are level.

    ``weights``: ``(vslot, bytes)``. Slots go by bytes, largest first: a slot stays where it is unless that fills its shard
    beyond an equal share; then it goes to the shard with the least. ``shards`` may be more than the map has (the new ones
    are empty) or fewer (the slots of the others move). The slots, some thousands, are one array that one expression folds.
    """
    now = current_map(edits).join(weights, "vslot", "left").select("vslot", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    last = edits.agg(F.max("version").alias("last"))
    # One row: every slot of the map, a number fixed by whoever made it.
    whole = now.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot", "shard"))).alias("slots"), F.sum("bytes").alias("total"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("to"))
    share = F.ceil(F.col("total") / shards)

    def step(acc: Column, s: Column) -> Column:
        load = acc["load"]
        home = F.coalesce(F.get(load, s["shard"]) - s["less"] <= share, F.lit(False))
        to = F.when(home, s["shard"]).otherwise((F.array_position(load, F.array_min(load)) - 1).cast("int"))
        added = F.transform(load, lambda x, i: F.when(i == to, x - s["less"]).otherwise(x))
        return F.struct(added.alias("load"), F.concat(acc["to"], F.array(to)).alias("to"))

    placed = whole.select(F.explode(F.arrays_zip("slots", F.aggregate("slots", start, step)["to"].alias("to"))).alias("s"))
    moved = placed.where(F.col("s.slots.shard") != F.col("s.to")).select("s.slots.vslot", F.col("s.to").alias("shard"))
    return moved.crossJoin(last).select((F.col("last") + 1).alias("version"), "vslot", "shard")  # one row


def store_edits(edits: DataFrame, path: str) -> None:
    """Adds edits to the stored map; earlier versions stay as they are."""
    edits.write.mode("append").parquet(path)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS, edits: DataFrame | None = None) -> DataFrame:
    """``(id, size, text_crc32, shard, slot, vslot, version)``, one row for each row of ``docs``.

    ``size`` is the UTF-8 bytes of the text plus 16 (null text: none); ``slot`` is the row's place in its shard, without
    gaps from 0; ``version`` is the map's. Without ``edits`` the map of version 0 is edited once by the bytes found here;
    given ones are used as they are. Null ids are records like others. Of equal records (id and text) every 64 share a
    virtual slot. An empty table gives an empty result. No text is shuffled, and long ones are only measured and hashed.
    Equal tables give equal results, in whatever order their rows come.
    """
    found = durable(records(docs, id_col, text_col, slots))
    if edits is None:
        edits = first_map(found.sparkSession, shards, slots)
        edits = edits.unionByName(rebalance(edits, slot_bytes(found), shards))
    edits = durable(edits)
    rows_of = found.groupBy("vslot").agg(F.sum("n").alias("rows"))
    inside = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)  # slots, not records
    placed = current_map(edits).join(rows_of, "vslot").select("vslot", "shard", F.coalesce(F.sum("rows").over(inside), F.lit(0)).alias("base"))
    version = edits.agg(F.max("version").alias("version"))
    # A virtual slot is one of thousands that hashing fills evenly.
    before = Window.partitionBy("vslot").orderBy("id", "th", "text_crc32", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    ordered = found.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    each = ordered.join(F.broadcast(placed.crossJoin(version)), "vslot").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))  # a row a slot
    return each.select("id", "size", "text_crc32", "shard", (F.col("base") + F.col("before") + F.col("i")).alias("slot"), "vslot", "version")
