"""Document fingerprints: one-permutation MinHash in Spark expressions only.

Every shingle is hashed once; the hash's high bits name its bin and each bin keeps its least hash. Empty bins borrow by
optimal densification: bin i tries the other bins in an order fixed by hashing (i, attempt) until it meets a filled one.
Of each bin's value only the low bits are stored, packed as lowercase hex digits. Unequal values agree on b bits with
probability 2 ** -b, which the likeness takes off.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.common import durable, plain, sha256_hex, shuffle_width, words

BINS = 256
#: Bits that are stored of each bin: one hex digit.
LOW_BITS = 4
SHINGLE = 5


def _probe_order(bins: int) -> list[list[int]]:
    """For each bin the other bins, by the hash of the two."""
    return [sorted((j for j in range(bins) if j != i), key=lambda j: xxhash.xxh64_intdigest(f"{i}:{j}", 11)) for i in range(bins)]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """A 64-bit hash of each run of ``shingle`` words; of the whole sequence if there are fewer words."""

    def runs(w: Column) -> Column:
        several = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(shingle))))
        return F.when(F.size(w) >= shingle, several).otherwise(F.array(F.xxhash64(w, F.lit(shingle))))

    return _let(F.transform(words(text), lambda x: F.xxhash64(x)), runs)


def fingerprint(text: Column, bins: int = BINS, shingle: int = SHINGLE) -> Column:
    """``bins`` hex digits. Null and blank texts are the empty sequence, which has a fingerprint of its own."""
    shift = 64 - (bins - 1).bit_length()
    # The greatest value of each bin marks it empty: sorted among the hashes, it comes first only where there is no other.
    marks = [(b - bins // 2 + 1 << shift) - 1 for b in range(bins)]
    order = _probe_order(bins)
    cuts = (0, 8, 40, bins - 1)
    probes = [F.expr("array(" + ",".join(f"array({','.join(map(str, row[a:b]))})" for row in order) + ")") for a, b in zip(cuts, cuts[1:], strict=False)]
    low = lambda v: v.bitwiseAND((1 << LOW_BITS) - 1)
    empty = lambda v: v.bitwiseAND((1 << shift) - 1) == (1 << shift) - 1

    # The least hash of each bin: the first of its bin in sorted order.
    def firsts(h: Column) -> Column:
        return F.filter(h, lambda v, i: (i == 0) | (F.shiftright(v, shift) != F.shiftright(F.get(h, i - 1), shift)))

    def filled(slots: Column) -> Column:
        def borrowed(i: Column) -> Column:
            tries = [F.get(F.filter(F.get(p, i), lambda j: ~empty(F.get(slots, j))), 0) for p in probes]
            return F.xxhash64(F.get(slots, F.coalesce(*tries)), i)  # hashed anew, or one value would decide all its borrowers

        return F.transform(slots, lambda v, i: F.hex(low(F.when(empty(v), borrowed(i)).otherwise(v))))

    hashes = F.sort_array(F.concat(shingle_hashes(text, shingle), F.expr(f"array({','.join(f'{m}L' for m in marks)})")))
    return F.lower(F.array_join(_let(_let(hashes, firsts), filled), ""))


def likeness(left: Column, right: Column, bins: int = BINS) -> Column:
    """Estimated Jaccard similarity of two fingerprints, between 0 and 1, without the chance matches of low bits."""
    chance = 2.0**-LOW_BITS
    equal = F.size(F.filter(F.zip_with(F.split(left, ""), F.split(right, ""), lambda a, b: a == b), lambda same: same))
    return F.greatest(F.lit(0.0), (equal / bins - chance) / (1 - chance))


def next_documents(ids: DataFrame) -> DataFrame:
    """``(id, n, next_id)`` of distinct ids with ``n`` in descending order, null last; after the last comes the first.

    Ids are range partitioned and numbered inside their partitions; only one row a partition is numbered alone.
    """
    spark = ids.sparkSession
    ordered = ids.repartitionByRange(shuffle_width(spark), F.col("id").desc_nulls_last()).sortWithinPartitions(F.col("id").desc_nulls_last())
    at = durable(ordered.withColumn("at", F.monotonically_increasing_id()))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = at.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = counts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy()).alias("total"))
    placed = at.withColumn("part", part).join(F.broadcast(before), "part").select("id", "n", (F.col("before") + row).alias("place"), "total")  # one row a partition
    following = placed.select(F.col("id").alias("next_id"), F.pmod(F.col("place") - 1 + F.col("total"), F.col("total")).alias("place"))
    return placed.join(following, "place").select("id", "n", "next_id")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of each text and of its edit: the last third replaced by the start of the next document.

    ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``, one row for each row of
    ``docs``. Null texts are empty. The next document of a row is one of the next id: of rows that share an id the longest
    text stands for it (of equally long ones the one of the greatest hash); a null id is the last. The only id is its own
    next. An empty table gives an empty result. Very long texts need memory for their own hashes only.
    """
    rows = plain(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    stands = rows.groupBy("id").agg(F.max(F.length("text")).alias("n"))
    return _edited(rows, next_documents(stands), bins, shingle)


def _key(id_: Column) -> Column:
    """The id as a string that is never null, so that joins on it keep the partitioning of groups by it."""
    return F.coalesce(F.concat(F.lit("i"), id_.cast("string")), F.lit(""))


def _edited(rows: DataFrame, following: DataFrame, bins: int, shingle: int) -> DataFrame:
    # Both joins below read all of these columns, so that what is printed is shuffled once for the two.
    printed = rows.select(_key(F.col("id")).alias("key"), "id", "text", fingerprint(F.col("text"), bins, shingle).alias("fingerprint"))
    before = following.select(_key(F.col("next_id")).alias("key"), _key(F.col("id")).alias("prev"), F.floor(F.col("n") / 3).cast("int").alias("wanted"))
    next_ = F.struct(F.left("text", F.col("wanted")).alias("lent"), F.col("fingerprint").alias("next_print"))
    stands = F.struct(F.length("text"), F.xxhash64("text"), "id")
    lent = printed.join(before, "key").groupBy(F.col("prev").alias("key")).agg(F.max_by(next_, stands).alias("next")).select("key", "next.*")
    both = printed.join(lent, "key")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    both = both.withColumn("edited", F.concat(F.left("text", n - third), F.left("lent", third)))
    out = both.select("id", n.cast("long").alias("n_chars"), sha256_hex(F.col("edited")).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited"), bins, shingle).alias("edited_fingerprint"), "next_print")
    return out.select("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint"), bins).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_print"), bins).alias("near_next"))
