"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over 256 character classes, of order five. Its counts, those of the highest order and the continuation
counts of the orders below down to three, are tables sharded by the two classes before the last: an n-gram, all its
shorter endings and their contexts lie in one shard. Every document's n-grams, counted per block of documents, are dealt
to the same shards and joined there with the counts, and the partial sums of log probabilities come together per
document. Only the two lowest orders, 256 squared entries at most, travel whole. A fifth of the trusted documents is not
counted: thresholds are quantiles of these documents' perplexities, one for each language.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import durable, plain, shuffle_width

#: Bits of a class, and the order of the model.
BITS, ORDER = 8, 5
CLASSES = 1 << BITS
BLOCK_CHARS = 3_000_000
#: Rows of the trusted list that are sent to every executor; a longer list is joined by a shuffle.
SMALL_LIST = 1_000_000
#: Classes of their own, in order: the blank, a to z, U+00DF to U+00FF, marks. The others share the classes that are left.
_OWN = {c: k for k, c in enumerate([" ", *map(chr, range(97, 123)), *map(chr, range(0xDF, 0x100)), *".,;:?!'\"()-"])}
#: Beyond these: one class for the ten figures, one for further marks, and the rest for the letters of other scripts.
_DIGIT, _MARK, _OTHERS = len(_OWN), len(_OWN) + 1, len(_OWN) + 2


def _class(k: int) -> int:
    c = chr(k).lower()[0]
    if c.isspace():
        return 0
    if c in _OWN:
        return _OWN[c]
    if c.isdigit():
        return _DIGIT
    return _OTHERS + ord(c) % (CLASSES - _OTHERS) if c.isalpha() else _MARK


_TABLE = np.array([_class(k) for k in range(0x10000)], np.int16)


def _classes(codes: np.ndarray) -> np.ndarray:
    """Classes of code points; those beyond the first 65536 count as letters of other scripts."""
    return np.where(codes < 0x10000, _TABLE[np.minimum(codes, 0xFFFF)], _OTHERS + codes % (CLASSES - _OTHERS)).astype(np.int64)


def grams(text: str) -> np.ndarray:
    """Codes of the n-grams of a whole text: blanks before it, its classes with runs of blanks as one, a blank after it."""
    lead = " " * (ORDER - 1)
    ids = _classes(np.frombuffer(f"{lead}{text} ".encode("utf-32-le", "surrogatepass"), "<u4"))
    keep = np.ones(len(ids), bool)
    keep[ORDER - 1 :] = (ids[ORDER - 1 :] != 0) | (ids[ORDER - 2 : -1] != 0)
    ids = ids[keep]
    n = len(ids) - ORDER + 1
    out = np.zeros(max(n, 0), np.int64)
    for k in range(ORDER if n > 0 else 0):
        out = out << BITS | ids[k : k + n]
    return out


def _discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Discounts of n-grams seen 0, 1, 2 and 3 or more times (modified Kneser-Ney), within [0, count]."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return np.array([0.0, *(min(max(d, 0.05), k + 0.95) for k, d in enumerate(found))])


@dataclass
class LowerOrders:
    """What tasks need beside their shard: the discounts of orders three and up, and all probabilities of order two."""

    discounts: dict[int, np.ndarray]
    p2: np.ndarray


def bottom(cont2: np.ndarray) -> np.ndarray:
    """Probabilities [c, w] of order two from ``cont2[c, w]``, the number of different classes before each pair."""

    def level(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
        d = _discounts(*(float(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)))[np.minimum(counts, 3)]
        total = counts.sum(axis=-1, keepdims=True)
        return np.where(total > 0, (counts - d + d.sum(axis=-1, keepdims=True) * below) / np.maximum(total, 1), below)

    p1 = level((cont2 > 0).sum(axis=0), np.full(CLASSES, 1 / CLASSES))
    return level(cont2, p1[None, :])


def log_probabilities(query: np.ndarray, shard: dict[int, tuple], lower: LowerOrders) -> np.ndarray:
    """Of n-grams ``query``, all of one shard; ``shard`` has the sorted n-grams of each order and their counts."""
    p = lower.p2.ravel()[query & (1 << 2 * BITS) - 1]
    for order in range(3, ORDER + 1):
        seen, counts = shard[order]
        if not len(seen):
            continue
        own = query & (1 << order * BITS) - 1
        d = lower.discounts[order][np.minimum(counts, 3)]
        contexts, start = np.unique(seen >> BITS, return_index=True)
        total, free = (np.add.reduceat(x.astype(float), start) for x in (counts, d))
        at = np.minimum(np.searchsorted(seen, own), len(seen) - 1)
        left = np.where(seen[at] == own, counts[at] - d[at], 0.0)
        c = np.minimum(np.searchsorted(contexts, own >> BITS), len(contexts) - 1)
        p = np.where(contexts[c] == own >> BITS, (left + free[c] * p) / total[c], p)
    return np.log(p)


def _blocks(texts: list) -> Iterator[tuple[int, list]]:
    start, chars = 0, 0
    for k, text in enumerate(texts):
        if k > start and (chars + len(text or "") > BLOCK_CHARS or k - start >= 60_000):
            yield start, texts[start:k]
            start, chars = k, 0
        chars += len(text or "")
    if start < len(texts):
        yield start, texts[start:]


def gram_counts(texts: DataFrame) -> DataFrame:
    """``(code, n)`` over all rows of a table of one column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for _, block in _blocks(batch.column(0).to_pylist()):
                own, many = np.unique(np.concatenate([grams(t or "") for t in block]), return_counts=True)
                codes, back = np.unique(np.concatenate([codes, own]), return_inverse=True)
                n = np.bincount(back, np.concatenate([n, many])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

    return texts.mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def _shard(codes: np.ndarray, shards: int) -> np.ndarray:
    """By the two classes before the last, which an n-gram shares with all its endings of three classes or more."""
    return ((codes >> BITS & (1 << 2 * BITS) - 1) * 0x9E3779B1 >> 7) % shards


def _deal(shards: int, salts: int):
    """Documents in; out go a head for each block and its n-grams for each shard: codes, documents and counts, packed."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, texts in _blocks(batch.column(3).to_pylist()):
                block, k = task << 32 | k, k + 1
                found = [grams(t) if t else np.empty(0, np.int64) for t in texts]
                sizes = np.array([len(f) for f in found], np.int64)
                keys = (np.concatenate(found).astype(np.int64) << 16) | np.repeat(np.arange(len(texts)), sizes)
                keys, counts = np.unique(keys, return_counts=True)
                shard = _shard(keys >> 16, shards)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                rows = []
                for s in range(shards):
                    own = order[cuts[s] : cuts[s + 1]]
                    if len(own):
                        codes, start, many = np.unique(keys[own] >> 16, return_index=True, return_counts=True)
                        docs = (keys[own] & 0xFFFF).astype(np.int64)
                        step = np.diff(docs, prepend=0)
                        step[start] = docs[start]
                        parts = [np.diff(codes, prepend=0).astype("<i8"), many.astype("<u2"), step.astype("<u2"), np.minimum(counts[own], 65535).astype("<u2")]
                        over = np.flatnonzero(counts[own] > 65535)
                        head = np.array([len(codes), len(own), len(over)], "<i4").tobytes()
                        extra = np.concatenate([over, counts[own][over]]).astype("<i8").tobytes()
                        planes = b"".join(p.view(np.uint8).reshape(-1, p.itemsize).T.tobytes() for p in parts)
                        rows.append((s, zlib.compress(head + planes + extra, 6)))
                n = len(rows)
                span = slice(first, first + len(texts))
                ids, langs, trusted = (batch.column(i)[span] for i in range(3))
                lists = [pa.ListArray.from_arrays(pa.array([0, len(texts)] + [len(texts)] * n, pa.int32()), x) for x in (ids, langs, trusted, pa.array(sizes))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block % shards] + [r[0] for r in rows], pa.int32()), pa.array([block % salts] * (n + 1), pa.int32()), pa.array([2] + [1] * n, pa.int32()), pa.array([block] * (n + 1), pa.int64()), pa.array([b""] + [r[1] for r in rows], pa.binary()), *lists],
                    names=["shard", "salt", "kind", "block", "payload", "ids", "langs", "trusted", "sizes"],
                )

    return deal


def _open(payload: bytes):
    raw = zlib.decompress(payload)
    n_codes, n, n_over = np.frombuffer(raw, "<i4", 3)
    at, out = 12, []
    for kind, count in (("<i8", n_codes), ("<u2", n_codes), ("<u2", n), ("<u2", n)):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * count, at).reshape(width, count).T).view(kind).ravel())
        at += width * count
    over = np.frombuffer(raw, "<i8", 2 * n_over, at)
    codes, many, step, counts = np.cumsum(out[0], dtype=np.int64), out[1].astype(np.int64), out[2].astype(np.int64), out[3].astype(np.int64)
    many = many + 65536 * (many == 0)
    start = np.cumsum(many) - many
    total = np.cumsum(step)
    base = np.where(start > 0, total[start - 1], 0)
    docs = total - np.repeat(base, many)
    counts[over[:n_over]] = over[n_over:]
    return codes, many, docs, counts


def _join(lower):
    """Rows by shard, the shard's counts first: sums of log probabilities for each block and document."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            col = {name: batch.column(i).to_pylist() for i, name in enumerate(("shard", "salt", "kind", "block", "payload"))}
            sums = []
            for shard, salt, kind, payload in zip(col["shard"], col["salt"], col["kind"], col["payload"], strict=True):
                if (shard, salt) != at:
                    at, held = (shard, salt), dict.fromkeys(range(3, ORDER + 1), (np.empty(0, np.int64), np.empty(0, np.int64)))
                if kind == 0:
                    rows = np.frombuffer(payload, "<i8").reshape(3, -1)
                    held = {k: (rows[1][rows[0] == k], rows[2][rows[0] == k]) for k in held}
                    sums.append(b"")
                elif kind == 1:
                    codes, many, docs, n = _open(payload)
                    logp = np.repeat(log_probabilities(codes, held, lower.value), many)
                    sums.append(np.bincount(docs, logp * n).astype("<f8").tobytes())
                else:
                    sums.append(b"")
            keep = np.array(col["kind"]) > 0
            out = pa.RecordBatch.from_arrays([batch.column(3), pa.array(sums, pa.binary()), *(batch.column(i) for i in range(5, 9))], names=["block", "sums", "ids", "langs", "trusted", "sizes"])
            yield out.filter(pa.array(keep))

    return join


def _gather(key, table):
    head = table.filter(pa.compute.greater(pa.compute.list_value_length(table.column("sizes")), 0))
    flat = {name: head.column(name).combine_chunks().flatten() for name in ("ids", "langs", "trusted", "sizes")}
    total = np.zeros(len(flat["sizes"]))
    for raw in table.column("sums").to_pylist():
        own = np.frombuffer(raw, "<f8")
        total[: len(own)] += own
    n = flat["sizes"].to_numpy()
    return pa.table({"id": flat["ids"], "lang": flat["langs"], "trusted": flat["trusted"], "n_grams": pa.array(n), "perplexity": pa.array(np.exp(-total / np.maximum(n, 1)))})


def score_quality(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99, shards: int = 16) -> DataFrame:
    """``(id, lang, trusted, held_out, n_grams, perplexity, threshold, keep)``, one row for each row of ``docs``.

    ``trusted_ids``: one column ``id``, the documents whose text is trusted; nulls are not used. A document is kept if
    its perplexity is at most the ``quantile`` of the trusted documents of its language that were held out of the counts
    (every fifth, by a hash of the id); where a language has none, of all that were held out; then of all trusted
    documents; without any, everything is kept. Null and empty texts have no n-gram, perplexity 1, and are not kept. A
    null language is one of its own. Whole texts are read, whatever their length. Rows that repeat an id are scored
    each, and counted each if the id is trusted. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    held_out = F.pmod(F.xxhash64(F.col("id"), F.lit("held")), F.lit(5)) == 0
    listed = trusted_ids.where("id IS NOT NULL").select("id").distinct().withColumn("trusted", F.when(held_out, 2).otherwise(1))
    small = listed.count() <= SMALL_LIST
    rows = plain(docs, id=id_col, lang=lang_col, text=text_col)
    counted = rows.join(F.broadcast(listed) if small else listed, "id").where("trusted = 1").select("text")
    model = durable(gram_counts(counted))
    # Continuation counts: how many classes stand before an ending, order by order.
    tables, below = [model.select(F.lit(ORDER).alias("order"), "code", "n")], model
    for order in range(ORDER - 1, 1, -1):
        below = below.groupBy(F.col("code").bitwiseAND((1 << order * BITS) - 1).alias("code")).agg(F.count("*").alias("n"))
        below = durable(below) if order > 2 else below
        tables.append(below.select(F.lit(order).alias("order"), "code", "n"))
    cont2 = np.zeros(CLASSES**2, np.int64)
    for _, code, many in tables.pop().collect():  # 256 squared rows at most
        cont2[code] = many
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    found = every.groupBy("order").agg(*(F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4))).collect()  # a row an order
    discounts = dict.fromkeys(range(3, ORDER + 1), _discounts(0, 0, 0, 0)) | {r.order: _discounts(r.n1, r.n2, r.n3, r.n4) for r in found}
    lower = spark.sparkContext.broadcast(LowerOrders(discounts, bottom(cont2.reshape(CLASSES, CLASSES))))
    salts = max(1, -(-2 * shuffle_width(spark) // shards))

    def bundle(key, table):
        table = table.sort_by([("order", "ascending"), ("code", "ascending")])
        payload = np.stack([table.column(c).to_numpy().astype("<i8") for c in ("order", "code", "n")]).tobytes()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "payload": pa.array([payload], pa.binary())})

    middle = F.shiftright("code", BITS).bitwiseAND((1 << 2 * BITS) - 1)
    shard = F.pmod(F.shiftright(middle * 0x9E3779B1, 7), F.lit(shards)).cast("int")
    counts = every.where("n > 0").withColumn("shard", shard).groupBy("shard").applyInArrow(bundle, "shard int, payload binary")
    kind = rows.schema["id"].dataType.simpleString()
    lists = f"ids array<{kind}>, langs array<string>, trusted array<int>, sizes array<bigint>"
    # Ids alone decide what is trusted; where the list is long they are joined once the texts are gone.
    marked = rows.join(F.broadcast(listed), "id", "left") if small else rows.withColumn("trusted", F.lit(0))
    dealt = marked.select("id", F.col("lang").cast("string").alias("lang"), F.coalesce("trusted", F.lit(0)).alias("trusted"), "text").mapInArrow(_deal(shards, salts), f"shard int, salt int, kind int, block bigint, payload binary, {lists}")
    counts = counts.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("block"), "payload", *(F.array().cast(dealt.schema[c].dataType).alias(c) for c in ("ids", "langs", "trusted", "sizes")))
    together = dealt.unionByName(counts).repartition(shuffle_width(spark), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    sums = together.mapInArrow(_join(lower), f"block bigint, sums binary, {lists}")
    scored = durable(sums.groupBy("block").applyInArrow(_gather, f"id {kind}, lang string, trusted int, n_grams bigint, perplexity double"))
    if not small:
        scored = durable(scored.drop("trusted").join(listed, "id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(0))))
    judged = scored.where("trusted > 0 AND n_grams > 0")
    judged = judged.where(F.col("trusted") == (judged.agg(F.max("trusted")).first()[0] or 0))
    overall = judged.agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    limits = judged.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("limit")).withColumnRenamed("lang", "of")
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("threshold", F.coalesce("limit", F.lit(overall).cast("double"), F.lit(float("inf"))))
    keep = (F.col("n_grams") > 0) & (F.col("perplexity") <= F.col("threshold"))
    return out.select("id", "lang", (F.col("trusted") > 0).alias("trusted"), (F.col("trusted") == 2).alias("held_out"), "n_grams", "perplexity", "threshold", keep.alias("keep"))
