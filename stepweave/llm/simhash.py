"""SimHash near-duplicates with a generalised pigeonhole search.

A 64-bit fingerprint is the bitwise majority over the hashes of word shingles. Fingerprints at Hamming distance
``tau`` or less are linked. The search groups correlated bits into partitions, gives each partition its own threshold
by dynamic programming on estimated candidate counts (thresholds sum to ``tau - partitions + 1``, so no link is lost),
probes each partition within its threshold and verifies the whole distance. ``near_components`` links texts by the exact
Jaccard similarity of their shingles: a prefix filter over rare shingles finds groups, in which sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import durable, has_word, plain, shuffle_width
from stepweave.llm.components import connected_components, local_forest

BITS = 64
#: Rows of a bucket that one task compares; larger buckets are dealt out in pairs of tiles of this size.
TILE = 2048
#: Work of storing a fingerprint under one key, in comparisons.
KEY_WORK = 400
#: Bits in which the fingerprints of near copies differ, at most, where operator 5's own search looks for them.
TAU = 3
#: Jaccard similarity of near copies.
ALIKE = 0.8
#: Words of 64 bits in the marks of a set of shingles: the parity of how many fall on each bit.
MARKS = 8
#: The same for the texts of large groups: few bits tell long texts apart no more.
LONG_MARKS = 128
#: Counters of shingles by which the rare ones are told from the frequent; they order shingles and never change a result.
CELL_BITS = 18
#: The cells are added up in runs of so many.
RUN = 4096
#: Texts of a tile whose sets a task holds together.
PARTS = 512
#: Shingles that the sets of a tile hold, about.
HELD = 4_000_000
#: Rows of a few longs each that are sent to every task; more are joined by a shuffle.
SMALL = 300_000
ROOM = 1e-9
#: An odd factor by which the places of words in a shingle are told apart.
PLACE = 0xC2B2AE3D27D4EB4F


def _shingles(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the word shingles of a text (A-Z lower-cased, words of non-blank bytes), repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= shingle:
        return np.array([digest(b" ".join(parts), 42)], np.uint64)
    return np.array([digest(b" ".join(x), 42) for x in zip(*(parts[i:] for i in range(shingle)), strict=False)], np.uint64)


def _stirred(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: pa.LargeStringArray) -> np.ndarray:
    """64-bit hashes of words of a byte or more: the sum, over a word's bytes, of a random number of the byte times one of its place."""
    if not len(words):
        return np.empty(0, np.uint64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    letters, size, starts = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], np.diff(ends), ends[:-1] - ends[0]
    of_byte = _stirred(np.arange(1, 257, dtype=np.uint64) * np.uint64(PLACE))
    of_place = _stirred(np.arange(257, 257 + size.max(), dtype=np.uint64) * np.uint64(PLACE))
    total = of_byte[letters] * of_place[np.arange(len(letters)) - np.repeat(starts, size)]
    return _stirred(np.add.reduceat(total, starts) + size.astype(np.uint64))


def _combined(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of several texts one after the other, repeats included, and how many each text has.

    Words are those of ``_shingles``; each is hashed once, and the hashes are combined by their places.
    """
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())  # a copy: ascii_lower misreads casts of slices
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    size, flat = pc.list_value_length(parts).to_numpy().astype(np.int64), pc.list_flatten(parts)
    bare = pc.equal(pc.binary_length(flat), 0)
    if pc.any(bare).as_py():  # what a blank text is split into
        size -= np.bincount(pc.list_parent_indices(parts).filter(bare).to_numpy(), minlength=len(size))
        flat = flat.filter(pc.invert(bare))
    words = _word_hashes(flat)
    begin, n = np.cumsum(size) - size, np.where(size >= shingle, size - shingle + 1, np.minimum(size, 1))

    def placed(words: np.ndarray, width: int) -> np.ndarray:
        total = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            total = total * np.uint64(PLACE) + words[k : k + len(total)]
        return total

    at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
    total = placed(np.concatenate([words, np.zeros(shingle - 1, np.uint64)]), shingle)[at]
    for k in np.flatnonzero((size > 0) & (size < shingle)).tolist():  # shorter than a shingle
        total[n[:k].sum()] = placed(words[begin[k] : begin[k] + size[k]], int(size[k]))[0]
    x = (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32)), n


def _majorities(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``_majority`` of each run of ``n`` hashes; zero where there are none."""
    out, size = np.zeros(len(n), np.uint64), n[n > 0]
    if len(size):
        blocks = -(-size // 255)  # a byte counts the hashes of a block that have a bit
        first = np.cumsum(blocks) - blocks
        starts = np.repeat(np.cumsum(size) - size, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
        counts = np.empty((len(starts), 8, 8), np.int64)
        for k in range(8):
            held = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), starts)
            counts[:, :, k] = held.astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(counts.reshape(-1, BITS), first) * 2 > size[:, None]
        out[n > 0] = np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 255):
        block = hashes[at : at + 255].view(np.uint8)
        total += np.unpackbits(block, bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.uint8)
    ones = np.packbits(total * 2 > len(hashes), bitorder="little")
    return int(ones.view("<u8")[0])


def _again(hashes: np.ndarray) -> np.ndarray:
    """The hashes hashed anew."""
    x = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def simhash_text(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of one text; zero without words."""
    return _majority(_shingles(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)``, one row for each row of ``docs``; ``fp`` holds the 64 bits as a signed long. Null text: no words."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = np.array([simhash_text(x, shingle) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return plain(docs, id=id_col, text=text_col).mapInArrow(batches, f"id {kind}, fp bigint")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, over all of them, how often each two bits are both set (64 by 64)."""

    def partial(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, gram = 0, np.zeros((BITS, BITS))
        for batch in rows:
            for at in range(0, len(batch), 8192):
                x = _bits(batch.column(0).to_numpy(zero_copy_only=False)[at : at + 8192]).astype(np.float64)
                n, gram = n + len(x), gram + x.T @ x
        if n:
            i, j = np.indices((BITS, BITS))
            cells = [np.append(i, BITS), np.append(j, BITS), np.append(gram, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cells], names=["i", "j", "n"])

    cells = prints.select("fp").mapInArrow(partial, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 64 * 64 + 1 rows
    gram, n = np.zeros((BITS, BITS)), 0
    for i, j, count in cells:
        if i == BITS:
            n = count
        else:
            gram[i, j] = count
    return n, gram


def group_bits(n: int, gram: np.ndarray, partitions: int) -> list[list[int]]:
    """Partitions of equal width; each starts at a free bit and takes the bits most correlated with those it has."""
    p = np.diag(gram) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((gram / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for k in range(partitions):
        width = len(free) // (partitions - k)
        own = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < width:
            best = max(free, key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def estimated_candidates(n: int, gram: np.ndarray, bits: list[int], threshold: int) -> float:
    """Estimated work of one partition: pairs within ``threshold`` on its bits, plus the keys that are stored."""
    if threshold < 0:
        return 0.0
    if threshold > len(bits):
        return float("inf")
    p = np.diag(gram)[bits] / max(n, 1)
    within = np.array([1.0])
    for agree in p**2 + (1 - p) ** 2:
        within = np.convolve(within, [agree, 1 - agree])
    # A pair that differs in k of the bits meets at the keys that blank those and any others.
    meets = sum(comb(len(bits) - k, threshold - k) * within[k] for k in range(threshold + 1))
    return n * n / 2 * meets + float(KEY_WORK) * n * comb(len(bits), threshold)


def allocate(n: int, gram: np.ndarray, groups: list[list[int]], tau: int) -> list[int]:
    """Thresholds, one a partition (-1: never probed), that sum to ``tau - partitions + 1`` at the least estimated work."""
    n = max(n, 2)  # of no fingerprints the least probing is the best, too
    goal = tau - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in groups:
        work = {t: estimated_candidates(n, gram, bits, t) for t in range(-1, tau + 1)}
        nxt: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, taken) in best.items():
            for t, own in work.items():
                value = (cost + own, [*taken, t])
                if total + t not in nxt or value < nxt[total + t]:
                    nxt[total + t] = value
        best = nxt
    return best[goal][1]


def _extract(bits: list[int], column: str = "fp") -> str:
    """SQL for the chosen bits of a fingerprint as a long."""
    return " | ".join(f"shiftleft(shiftrightunsigned({column}, {b}) & 1L, {k})" for k, b in enumerate(bits)) or "0L"


def _probes(groups: list[list[int]], thresholds: list[int]) -> list[tuple[int, list[int]]]:
    """All keys ``(tag, kept bits)`` under which a fingerprint is stored: one exact value, or its probes.

    With threshold t both sides are stored under the values with t bits blanked out, so that two values that differ in
    up to t bits meet at a key that blanks those.
    """
    out = []
    for bits, t in zip(groups, thresholds, strict=True):
        if t >= 0:
            for blank in combinations(bits, t):
                out.append((len(out), [b for b in bits if b not in blank]))
    return out


def _stored(probes: list[tuple[int, list[int]]]):
    def stored(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                bits = _bits(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.int64)
                values = [bits[:, kept] @ (1 << np.arange(len(kept), dtype=np.int64)) for _, kept in probes]
                tags = np.repeat(np.array([tag for tag, _ in probes], np.int32), len(batch))
                every = pa.array(np.tile(np.arange(len(batch)), len(probes)))
                yield pa.RecordBatch.from_arrays([pa.array(tags), pa.array(np.concatenate(values)), *(c.take(every) for c in batch.columns)], names=["part", "value", *batch.schema.names])

    return stored


_ROW = ("node", "fp", "n", "further", "root")
_AT = ("part", "value", "a", "b", "side")


def _bucket_links(tau: int, least: float):
    """Task side of the verification of distances, over rows sorted by bucket.

    The distance is that of ``fp`` and ``further`` together. Rows of one ``root`` are linked already and not compared. Out go
    links ``(u, v)``: all of a bucket, or, where they are many, a forest of them and each node that has others as ``(u, u)``.
    """

    def near(left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        other = left if right is None else right
        x, y, z, w = (side[:, c].copy().view(np.uint64) for c in (6, 8) for side in (left, other))
        for i in range(0, len(x), 64):
            for j in range(i // 4096 * 4096 if right is None else 0, len(y), 4096):
                far = np.bitwise_count(x[i : i + 64, None] ^ y[None, j : j + 4096]) + np.bitwise_count(z[i : i + 64, None] ^ w[None, j : j + 4096])
                a, b = np.nonzero(far <= tau)
                a, b = a + i, b + j
                if right is None:
                    a, b = a[a < b], b[a < b]
                n, m = left[a, 7], other[b, 7]
                keep = np.minimum(n, m) >= least * np.maximum(n, m) - ROOM
                keep &= left[a, 9] != other[b, 9]
                yield a[keep], b[keep]

    def bucket(left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nodes, roots = (left[:, c] if right is None else np.concatenate([left[:, c], right[:, c]]) for c in (5, 9))
        root, held, spare = np.unique(roots, return_inverse=True)[1], 0, np.zeros(len(nodes), bool)
        for a, b in near(left, right):
            b = b if right is None else b + len(left)
            while len(a):
                open_ = root[a] != root[b]
                more = ~open_
                if more.any():  # links inside what is linked already
                    if held + np.count_nonzero(more) <= len(nodes) // 16:
                        held += np.count_nonzero(more)
                        yield nodes[a[more]], nodes[b[more]]
                    else:
                        spare[a[more]] = spare[b[more]] = True
                a, b = a[open_], b[open_]
                if len(a):  # one link of each part at the least
                    pick = np.unique(np.concatenate([np.unique(root[a], return_index=True)[1], np.unique(root[b], return_index=True)[1]]))
                    yield nodes[a[pick]], nodes[b[pick]]
                    root = local_forest(root[a[pick]], root[b[pick]], len(root))[root]
                    rest = np.ones(len(a), bool)
                    rest[pick] = False
                    a, b = a[rest], b[rest]
        yield nodes[spare], nodes[spare]

    def links(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(block: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero((block[1:, :4] != block[:-1, :4]).any(axis=1)) + 1
            us, vs, size = [], [], 0
            for part in np.split(block, cuts):
                if len(part) < 2:
                    continue
                second = part[:, 4] == 1
                pairs = bucket(part, None) if part[0, 2] == part[0, 3] else bucket(part[~second], part[second])
                for u, v in pairs:
                    us.append(u)
                    vs.append(v)
                    size += len(u)
                    if size > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])
                        us, vs, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

        rest: list[np.ndarray] = []
        for batch in rows:
            if not len(batch):
                continue
            block = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            block = np.concatenate([*rest, block]) if rest else block
            changes = np.flatnonzero((block[1:, :4] != block[:-1, :4]).any(axis=1))
            cut = changes[-1] + 1 if len(changes) else 0
            if cut:
                yield from flush(block[:cut])
            rest = [block[cut:]]
        if rest:
            yield from flush(rest[0])

    return links


def _tiled(rows: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Rows of large buckets once for each pair of tiles that theirs is in."""
    tiles = rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1").select(*keys, F.ceil(F.col("n_rows") / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int")
    dealt = rows.join(tiles, keys).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.select(*keys, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), *_ROW)


def _compared(spark, small: DataFrame, large: DataFrame, keys: list[str], tile: int, tau: int, least: float) -> DataFrame:
    """The links inside the buckets; ``large`` ones are dealt out in pairs of tiles."""
    whole = small.select(*keys, F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), *_ROW)
    rows = whole.unionByName(_tiled(large.select(*keys, *_ROW), keys, tile))
    rows = rows.repartition(shuffle_width(spark), "part", "value", "a", "b").sortWithinPartitions("part", "value", "a", "b", "node")
    return rows.select(*_AT, *_ROW).mapInArrow(_bucket_links(tau, least), "u bigint, v bigint").distinct()


def near_links(prints: DataFrame, tau: int = 3, partitions: int = 4, tile: int = TILE, least: float = 0.0) -> DataFrame:
    """``(u, v)``: links at distance ``tau`` or less between rows whose sizes ``n`` are within ``least`` of each other.

    ``prints``: ``(node, fp, n)`` without nulls, ``node`` unique; of distinct fingerprints ``fp`` alone will do. The sets that
    the links reach are those of all links; where links are left out, their nodes come as ``(u, u)``. Buckets of more than
    ``tile`` rows are split once more by a second pigeonhole over all bits where that helps, and what is still larger is
    dealt out in pairs of tiles.
    """
    spark = prints.sparkSession
    given = {"node": F.col("fp"), "n": F.lit(0), "further": F.lit(0).cast("long")}
    prints = prints.select(*(F.col(c) if c in prints.columns and c != "further" else given[c].alias(c) for c in ("node", "fp", "n", "further")))
    n, gram = bit_statistics(prints)
    groups = group_bits(n, gram, partitions)
    thresholds = allocate(n, gram, groups, tau)
    kind = "part int, value bigint, node bigint, fp bigint, n int, further bigint"
    keyed = prints.select("node", "fp", F.col("n").cast("int").alias("n"), "further").mapInArrow(_stored(_probes(groups, thresholds)), kind)
    counts = keyed.groupBy("part", "value").agg(F.count("*").alias("held")).where("held > 1")
    sized = durable(keyed.join(counts, ["part", "value"])).withColumn("root", F.col("node"))
    large = sized.where(F.col("held") > tile)
    if tau < 8:
        # Distance tau over all 64 bits, cut in tau + 1 pieces, leaves one piece equal.
        pieces = [list(range(k, BITS, tau + 1)) for k in range(tau + 1)]
        large = large.select("part", "value", *_ROW, F.posexplode(F.expr(f"array({', '.join(map(_extract, pieces))})")).alias("piece", "sub"))
        large = large.select((F.col("part") * 8 + F.col("piece") + 1_000_000).alias("part"), F.xxhash64("value", "sub").alias("value"), *_ROW)
    return _compared(spark, sized.where(F.col("held") <= tile), large, ["part", "value"], tile, tau, least)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tau: int = 3) -> DataFrame:
    """``(id, fp, component_id)``, one row for each row of ``docs``.

    ``component_id`` is the smallest id among all rows reachable by links; rows with equal fingerprints are linked.
    Null texts have no words and get fingerprint zero, linked like any other; rows whose id is null take part and get
    the smallest id that is not null of their component (null if there is none). An empty table gives an empty result.
    Only distinct fingerprints are compared, so copies cost one row however many there are.
    """
    prints = durable(fingerprints(docs, id_col, text_col, shingle))
    classes = durable(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(near_links(classes.select("fp"), tau))
    placed = classes.join(roots, classes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("id", "fp", "component_id")


def text_class(text: Column) -> Column:
    """A hash of the text; texts without a word are one class."""
    return F.when(has_word(text), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in rows:
        yield from (whole.slice(at, 256) for at in range(0, len(whole), 256))


def shingle_counts(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles of all texts (one column) fall into each of ``2 ** CELL_BITS`` cells."""

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, any_ = np.zeros(1 << CELL_BITS, np.int64), False
        for batch in _blocks(rows):
            cells += np.bincount(_cell(_combined(batch.column(0), shingle)[0]), minlength=len(cells))
            any_ = True
        if any_:
            runs = len(cells) // RUN
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(runs, dtype=np.int32)), _lists(list(cells.reshape(runs, RUN)))], names=["run", "n"])

    def added(key, table):
        values = table.column("n").combine_chunks().flatten().to_numpy().reshape(-1, RUN).sum(axis=0)
        return pa.table({"run": pa.array([key[0].as_py()], pa.int32()), "n": _lists([values])})

    counts = np.zeros(1 << CELL_BITS, np.int64)
    for run, n in texts.mapInArrow(counted, "run int, n array<bigint>").groupBy("run").applyInArrow(added, "run int, n array<bigint>").collect():  # 2 ** CELL_BITS numbers
        counts[run * RUN : (run + 1) * RUN] = n
    return counts


def prefix(hashes: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The rarest of sorted distinct shingles, so many that sets at Jaccard similarity ``least`` share one of them.

    Such sets share at least ``least`` of the shingles of either, so in any order that is the same for all sets the first
    that they share is not further back than the others leave room for.
    """
    kept = len(hashes) - int(np.ceil(least * len(hashes) - ROOM)) + 1
    return hashes[np.argsort(counts[_cell(hashes)], kind="stable")[:kept]]


def _distinct(hashes: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each run of ``n``."""
    ends, out = np.cumsum(n), []
    for lo, hi in zip((ends - n).tolist(), ends.tolist(), strict=True):
        x = np.sort(hashes[lo:hi])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
    return out


def _marks(distinct: list[np.ndarray], words: int = MARKS) -> np.ndarray:
    """A row of ``words`` words for each set: a bit is the parity of how many of its hashes fall there."""
    bits = 64 * words
    hashes, n = np.concatenate([np.empty(0, np.uint64), *distinct]), [len(x) for x in distinct]
    at = np.repeat(np.arange(len(n)) * bits, n) + (_stirred(hashes) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(at, minlength=len(n) * bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.uint64).reshape(len(n), words)


def _may_be_alike(fp, further, marks, n, x, y, tau: int, least: float) -> np.ndarray:
    """Whether rows ``x`` and ``y`` differ in up to ``tau`` bits of both fingerprints and can be alike by sizes and marks.

    Marks differ in a bit only where an odd number of the shingles that one set alone has fall, and sets at ``least`` or more
    have at most ``(1 - least) / (1 + least)`` of both sizes of those: what the marks rule out is not alike.
    """
    fits = np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y]) - ROOM
    if tau < 2 * BITS:
        fits &= np.bitwise_count(fp[x] ^ fp[y]) + np.bitwise_count(further[x] ^ further[y]) <= tau
    at = np.flatnonzero(fits)
    xs, ys = (np.broadcast_to(z, fits.shape).ravel()[at] for z in (x, y))
    most, apart = (1 - least) / (1 + least) * (n[xs].astype(np.int64) + n[ys]) + ROOM, np.zeros(len(at), np.int64)
    for k in range(0, marks.shape[1], MARKS):
        apart += np.bitwise_count(marks[xs, k : k + MARKS] ^ marks[ys, k : k + MARKS]).sum(axis=1, dtype=np.int64)
        left = apart <= most
        at, xs, ys, most, apart = at[left], xs[left], ys[left], most[left], apart[left]
    out = np.zeros(fits.size, bool)
    out[at] = True
    return out.reshape(fits.shape)


def _marked(table: pa.Table) -> np.ndarray:
    return table.column("marks").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(table), -1)


def _with_marks(rows: DataFrame) -> DataFrame:
    return rows if "marks" in rows.columns else rows.withColumn("marks", F.array().cast("array<bigint>"))


def _sketched(shingle: int, counts: np.ndarray, least: float, prints: bool = True):
    """``(node, fp, n, further, marks, keys)`` of ``(node, text)``: the fingerprint, the number of distinct shingles, 64 further
    bits of a fingerprint over the same shingles hashed anew (both zero without ``prints``), the marks and the prefix of the
    shingles."""
    rank = np.unique(counts, return_inverse=True)[1].astype(np.int64)
    rank = (rank * 65535 // max(1, rank.max())).astype(np.uint16)  # short numbers sort faster

    def sketched(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(rows):
            hashes, n = _combined(batch.column(1), shingle)
            fps, further = (_majorities(hashes, n), _majorities(_again(hashes), n)) if prints else np.zeros((2, len(n)), np.uint64)
            distinct = _distinct(hashes, n)
            sizes = np.array([len(h) for h in distinct], np.int32)
            lists = [_lists(list(_marks(distinct))), _lists([prefix(h, rank, least) for h in distinct])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), pa.array(sizes), pa.array(further.view(np.int64)), *lists], names=["node", "fp", "n", "further", "marks", "keys"])

    return sketched


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate([*arrays, np.empty(0, np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _long_marks(shingle: int):
    """The long ``marks`` in place of the last column, the text."""

    def marked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(rows):
            found = _distinct(*_combined(batch.column(batch.num_columns - 1), shingle))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(list(_marks(found, LONG_MARKS)))], names=[*batch.schema.names[:-1], "marks"])

    return marked


def _sets(shingle: int):
    """The ``marks`` and the sorted distinct shingle hashes (``els``) in place of the last column, the text."""

    def sets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(rows):
            found = _distinct(*_combined(batch.column(batch.num_columns - 1), shingle))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(list(_marks(found))), _lists(found)], names=[*batch.schema.names[:-1], "marks", "els"])

    return sets


def _small(rows: DataFrame) -> DataFrame:
    """A broadcast where the rows (a few longs each) are few enough; otherwise they are joined by shuffling."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def _shared(mine: np.ndarray, values: np.ndarray, start: np.ndarray, size: np.ndarray, others: np.ndarray) -> tuple[list, list]:
    """How many members of the sorted set ``mine`` each of the sets ``others`` has, in blocks of sets."""
    blocks, counts = [], []
    ends = np.cumsum(size[others])
    cuts = np.flatnonzero(np.diff(ends // 500_000)) + 1
    for y in np.split(others, cuts):
        if len(y):
            before = np.cumsum(size[y]) - size[y]
            theirs = values[np.repeat(start[y] - before, size[y]) + np.arange(size[y].sum())]
            hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            blocks.append(y)
            counts.append(np.add.reduceat(hit.astype(np.int64), before))
    return blocks, counts


def _runs(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Where rows of another key begin in a table sorted by keys, its own beginning left out."""
    changes = [x[1:] != x[:-1] for x in (table.column(c).to_numpy() for c in keys)]
    return np.flatnonzero(np.logical_or.reduce(changes)) + 1


def _by_runs(work, keys: tuple[str, ...], rows_at_once: int = 1):
    """``work(table, starts)`` over sorted rows, so that no run of equal keys is cut; ``starts`` holds its beginnings and end."""

    def by_runs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, wanted = [], 0, rows_at_once
        for batch in rows:
            if len(batch):
                held.append(batch)
                size += len(batch)
            if size >= wanted and held:
                table = pa.Table.from_batches(held)
                cuts = _runs(table, keys)
                if len(cuts):
                    yield from work(table.slice(0, cuts[-1]), np.concatenate([[0], cuts]))
                    held = table.slice(cuts[-1]).to_batches()
                    size, wanted = sum(map(len, held)), rows_at_once
                else:
                    wanted = 2 * size  # a run that is longer
        if held:
            table = pa.Table.from_batches(held)
            yield from work(table, np.concatenate([[0], _runs(table, keys), [len(table)]]))

    return by_runs


def _pairs(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
    none = np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x])) for x in (us, vs)], names=["u", "v"])


def _tiles(sizes: DataFrame) -> DataFrame:
    """``(grp, tiles)``: groups that are more than one tile."""
    return sizes.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / PARTS), F.ceil(F.sum("n") / HELD)).cast("int").alias("tiles")).where("tiles > 1")


def _between_parts(rows: DataFrame, tau: int, least: float, sizes: DataFrame | None = None) -> DataFrame:
    """Links ``(u, v)`` that connect roots of one group: rows ``(grp, node, fp, n, further, root, els)``, with ``marks`` or without.

    A group is dealt out in pairs of tiles, and a task holds the sets of its two tiles: pairs are verified where they are
    found and never become rows. Inside a task pairs that are connected by then are left out. ``sizes``: the same rows without
    the sets, if they are at hand.
    """
    sizes = rows if sizes is None else sizes
    tiles = _tiles(sizes)
    dealt = _with_marks(rows).join(_small(tiles), "grp", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.col("tiles")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("grp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "fp", "n", "further", "marks", "root", "els")

    def links(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b, own, node, n, root = (table.column(c).to_numpy() for c in ("a", "b", "own", "node", "n", "root"))
        fp, further = (table.column(c).to_numpy().view(np.uint64) for c in ("fp", "further"))
        marks = _marked(table)
        els = table.column("els").combine_chunks()
        ends = els.offsets.to_numpy().astype(np.int64)
        values, start, size = els.values.to_numpy().view(np.uint64), ends[:-1], np.diff(ends)
        us, vs = [], []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            part, alone = np.unique(root[lo:hi], return_inverse=True)[1], a[lo] == b[lo]
            first, second = lo + np.flatnonzero(own[lo:hi] == a[lo]), lo + np.flatnonzero(own[lo:hi] == b[lo])
            for x in first.tolist():
                fits = (part[second - lo] != part[x - lo]) & _may_be_alike(fp, further, marks, n, x, second, tau, least)
                if alone:
                    fits &= node[second] > node[x]
                if not fits.any():
                    continue
                mine = values[start[x] : start[x] + size[x]]
                for y, shared in zip(*_shared(mine, values, start, size, second[fits]), strict=True):
                    alike = y[(shared >= least * (size[x] + size[y] - shared) - ROOM)]
                    for z in alike[np.unique(part[alike - lo], return_index=True)[1]].tolist():  # a link of each part
                        if part[z - lo] != part[x - lo]:
                            part[part == part[z - lo]] = part[x - lo]
                            us.append(x)
                            vs.append(z)
        if us:
            yield _pairs([node[us]], [node[vs]])

    keys = ("grp", "a", "b")
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_by_runs(links, keys), "u bigint, v bigint")


def _buckets(classes: DataFrame) -> DataFrame:
    """``(m1, m2, held, node)``: sets of classes that share a key, each once however many keys they share; two hashes and the
    number of classes tell which these are. A key and a class move once, and only keys that several classes have go on."""

    def shared(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, size = table.column("node").to_numpy(), np.diff(starts)
        some = np.repeat(size > 1, size)
        node, size = node[some], size[size > 1]
        if len(node):
            own, first = node.view(np.uint64), np.cumsum(size) - size
            marks = [np.repeat(np.bitwise_xor.reduceat(x, first), size).view(np.int64) for x in (_again(own), _again(own ^ np.uint64(PLACE)))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, marks), pa.array(np.repeat(size, size).astype(np.int32)), pa.array(node)], names=["m1", "m2", "held", "node"])

    keyed = classes.select(F.explode("keys").alias("value"), "node").repartition("value").sortWithinPartitions("value")
    return keyed.mapInArrow(_by_runs(shared, ("value",), 50_000), "m1 bigint, m2 bigint, held int, node bigint").distinct()


def _forest(tau: int, least: float):
    """Task side of ``_candidates``, over the rows of buckets: a forest ``(u, v)`` of the pairs that may be alike in each."""

    def forest(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, n = (table.column(c).to_numpy() for c in ("node", "n"))
        fp, further = (table.column(c).to_numpy().view(np.uint64) for c in ("fp", "further"))
        near = lambda x, y: _may_be_alike(fp, further, marks, n, x, y, tau, least)
        marks, size = _marked(table), np.diff(starts)
        two = starts[:-1][size == 2]
        two = two[near(two, two + 1)]
        us, vs = [node[two]], [node[two + 1]]
        for lo, hi in zip(starts[:-1][size > 2].tolist(), starts[1:][size > 2].tolist(), strict=True):
            # A row that is reached is compared with those that are not: dense buckets are done after a few rows.
            front, left = np.array([lo]), np.arange(lo + 1, hi)
            while len(left):
                if not len(front):
                    front, left = left[:1], left[1:]
                    continue
                some, front = front[:64], front[64:]
                met = near(some[:, None], left[None, :])
                hit = met.any(axis=0)
                if hit.any():
                    us.append(node[some[met[:, hit].argmax(axis=0)]])
                    vs.append(node[left[hit]])
                    front, left = np.concatenate([front, left[hit]]), left[~hit]
        yield _pairs(us, vs)

    return forest


def _candidates(buckets: DataFrame, classes: DataFrame, tile: int, tau: int, least: float) -> DataFrame:
    """Pairs ``(u, v)`` that connect what shares a key, differs in up to ``tau`` bits and may be alike by sizes and ``marks``.

    Buckets of more than ``tile`` rows are dealt out in pairs of tiles.
    """
    rows = buckets.withColumn("tiles", F.ceil(F.col("held") / tile).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int"))
    rows = rows.join(_with_marks(classes).select("node", "fp", "n", "further", "marks"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("m1", "m2", "held", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "fp", "n", "further", "marks")
    keys = ("m1", "m2", "held", "a", "b")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_by_runs(_forest(tau, least), keys, 50_000), "u bigint, v bigint")


def _split(texts: DataFrame, info: DataFrame, shingle: int, far: int, least: float, tile: int) -> DataFrame:
    """``info`` (``grp``, ``node``, ``fp``, ``n``, ``further``) with large groups split by long marks; nodes that stand alone then go.

    What connects a large group are mostly long texts with a passage in common. Marks are small against sets, so they are
    compared in pairs of tiles before the sets are.
    """
    large = durable(_tiles(info).select("grp"))
    if large.isEmpty():
        return info
    inside = durable(info.join(_small(large), "grp", "left_semi"))
    held = texts.join(_small(inside), "node").groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "n", "further", "text")))
    classes = held.mapInArrow(_long_marks(shingle), "node bigint, fp bigint, n int, further bigint, marks array<bigint>")
    sized = inside.join(_small(inside.groupBy("grp").agg(F.count("*").cast("int").alias("held"))), "grp")
    groups = connected_components(_candidates(sized.select(F.col("grp").alias("m1"), F.lit(0).cast("long").alias("m2"), "held", "node"), classes, tile, far, least))
    parts = groups.withColumnRenamed("root", "grp").join(_small(inside.drop("grp")), "node").select(*info.columns)
    return durable(info.join(_small(large), "grp", "left_anti").select(*info.columns).unionByName(parts))


def near_components(docs: DataFrame, text_col: str = "text", shingle: int = 5, tau: int | None = None, least: float = ALIKE, far: int = 2 * BITS, tile: int = TILE) -> DataFrame:
    """``(node, root)``: text classes (``text_class``) linked to others, and the smallest class of their component.

    Two texts are linked if their distinct ``shingle``-word shingles have a Jaccard similarity of ``least`` or more. Classes that
    are not listed stand alone. Equal texts are one class, so copies cost one row however many there are. Every text is stored
    under its rarest shingles, so many that no pair is missed; pairs that meet there and can be alike by sizes and marks connect
    texts to groups, of which a forest is enough. Large groups are split by longer marks. Inside a group the shingle sets decide. ``far``: pairs that differ in more
    bits of 128 of their fingerprints are left out, none by default. ``tau``: fingerprints at so many differing bits are put
    into groups as well, which changes no link.
    """
    texts = plain(docs, text=text_col).where(has_word(F.col("text"))).select(text_class(F.col("text")).alias("node"), "text")
    counts = shingle_counts(texts.select("text"), shingle)
    sketched = _sketched(shingle, counts, least, tau is not None or far < 2 * BITS)
    prints = texts.mapInArrow(sketched, "node bigint, fp bigint, n int, further bigint, marks array<bigint>, keys array<bigint>")
    classes = durable(prints.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "n", "further", "marks", "keys"))))
    found = _candidates(_buckets(classes), classes, tile, far, least)
    if tau is not None:
        found = found.unionByName(near_links(classes.select("node", "fp", "n"), tau, least=least))
    groups = connected_components(found).withColumnRenamed("root", "grp")
    info = durable(groups.join(classes.select("node", "fp", "n", "further"), "node").select("grp", "node", "fp", "n", "further"))
    info = _split(texts, info, shingle, far, least, tile)
    held = texts.join(_small(info), "node").groupBy("node").agg(*(F.first(c).alias(c) for c in ("grp", "fp", "n", "further", "text")))
    sets = held.select("grp", "node", "fp", "n", "further", F.col("node").alias("root"), "text")
    sets = sets.mapInArrow(_sets(shingle), "grp bigint, node bigint, fp bigint, n int, further bigint, root bigint, marks array<bigint>, els array<bigint>")
    return connected_components(_between_parts(sets, far, least, info))


def clustered(docs: DataFrame, text_col: str = "text", cluster_col: str = "cluster") -> DataFrame:
    """The rows with the component of each row's text (``near_components``) as a further column, a long."""
    roots = near_components(docs, text_col, tau=None)
    node = text_class(F.col(f"`{text_col}`"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != cluster_col)).alias("row"), node.alias("node"))
    out = rows.join(_small(roots), "node", "left")
    return out.select("row.*", F.coalesce("root", "node").alias(cluster_col))


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
