"""Hard negatives by bit-sliced integer products.

Components are integers, and a product of an anchor with a row is the sum over the row's bit-planes of the anchor's
product with each plane. Planes come most significant first; what the planes left can still add or take away is known
from the anchor alone, so every plane halves the interval in which a score lies. A candidate whose interval can no
longer qualify is dropped, and the rest of its planes are never looked at.

Anchors and rows meet in blocks: a task holds one block of anchors and one tile of rows, and only its best rows of each
anchor leave it. Two passes: positives first, since their scores bound those of the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.common import durable, plain, small_side

SCALE = 256
#: Positives of an anchor, negatives of a positive, and the percentages of the positive's score that bound a negative's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Anchors of a block and rows of a tile.
BLOCK, TILE = 1024, 16384
#: Anchors and rows of one product inside a task; the first ones are small, as no score is known by then.
ACROSS, STEPS = 256, (128, 512, 2048)
#: Pairs of which fewer than one in so many is left are taken one by one.
SPARSE = 16


#: Stands for no bound; sums with a product still fit in a long.
NO_BOUND = 1 << 62


def _exact(bound: float) -> type:
    """The narrowest numbers that hold all integers up to four times ``bound``: a product, and a bound less what is left."""
    return np.float32 if bound < 1 << 22 else np.float64 if bound < 1 << 51 else np.int64


def _width(rows: np.ndarray) -> int:
    """Bits of the components in two's complement."""
    return int(max(int(rows.max(initial=0)).bit_length(), int(-1 - rows.min(initial=0)).bit_length())) + 1


def sliced(anchors: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, row, score)`` of the pairs whose products lie from ``low`` to ``high``, both a long for each anchor.

    ``anchors`` and ``rows`` are integer matrices; the planes of ``rows`` go most significant first. As long as many pairs
    are left a plane is one product of matrices, and afterwards only the pairs left are looked at.
    """
    n, width = len(anchors), _width(rows)
    bound = float(np.abs(anchors).sum(axis=1).max(initial=0)) * 2.0**width
    if bound >= NO_BOUND:
        raise ValueError("a product of these vectors does not fit in a long")
    kind = _exact(bound)
    least, most = np.minimum(anchors, 0).sum(axis=1), np.maximum(anchors, 0).sum(axis=1)  # of one plane
    wide = anchors.astype(kind)
    part = np.zeros((n, len(rows)), kind)
    a = b = total = None
    for k in range(width - 1, -1, -1):
        weight = -(1 << k) if k == width - 1 else 1 << k
        plane, left = ((rows >> k) & 1), (1 << k) - 1
        if a is None:
            part += wide @ (plane.T.astype(kind) * kind(weight))
            alive = (part >= (low - left * most).astype(kind)[:, None]) & (part <= (high - left * least).astype(kind)[:, None])
            if np.count_nonzero(alive) * SPARSE < alive.size or k == 0:
                a, b = np.nonzero(alive)
                total = part[a, b].astype(np.int64)
        else:
            total = total + weight * np.einsum("ij,ij->i", anchors[a], plane[b])
            alive = (total >= low[a] - left * most[a]) & (total <= high[a] - left * least[a])
            a, b, total = a[alive], b[alive], total[alive]
    return a, b, total


class _Best:
    """The best rows of each of several lists: by score, greatest first, then by id."""

    def __init__(self, lists: int, keep: int):
        self.keep, self.floor = keep, np.full(lists, -NO_BOUND)
        self.held = [np.empty(0, np.int64) for _ in range(4)]  # list, score, id, payload

    def add(self, *rows: np.ndarray) -> None:
        at, score, ident, more = (np.concatenate([x, y]) for x, y in zip(self.held, rows, strict=True))
        order = np.lexsort((more, ident, -score, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        stay = rank < self.keep
        full = at[rank == self.keep - 1]
        self.floor[full] = score[order][rank == self.keep - 1]
        self.held = [at[stay], *(x[order][stay] for x in (score, ident, more))]


def _matrix(table: pa.Table, name: str, dim: int) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), dim)


def _cut(n: int) -> Iterator[slice]:
    at, k = 0, 0
    while at < n:
        yield slice(at, at + STEPS[min(k, len(STEPS) - 1)])
        at, k = at + STEPS[min(k, len(STEPS) - 1)], k + 1


def _sides(table: pa.Table, dim: int) -> tuple[pa.Table, np.ndarray, pa.Table, np.ndarray]:
    anchors, rows = (table.filter(pc.equal(table.column("anchor"), x)) for x in (True, False))
    return anchors, _matrix(anchors, "vector", dim), rows, _matrix(rows, "vector", dim)


def _best_positives(keep: int):
    """Task side: of the rows of one tile those of an anchor's label that score best, itself left out."""

    def best(key, table):
        anchors, x, rows, y = _sides(table, key[0].as_py())
        mine, idx, ids = (c.to_numpy() for c in (anchors.column("idx"), rows.column("idx"), rows.column("id")))
        out = _Best(len(x), keep)
        for cut in _cut(len(y)):
            for i in range(0, len(x), ACROSS):
                low = out.floor[i : i + ACROSS]
                a, b, score = sliced(x[i : i + ACROSS], y[cut], low, np.full(len(low), NO_BOUND))
                a, b = a + i, b + cut.start
                other = mine[a] != idx[b]
                out.add(a[other], score[other], ids[b[other]], idx[b[other]])
        at, score, ident, other = out.held
        return pa.table({"idx": mine[at], "other": other, "id": ident, "score": score})

    return best


def _best_negatives(keep: int, low_share: int, high_share: int):
    """Task side: of the rows of one tile and other labels than an anchor's the best within the bounds of each positive."""

    def best(key, table):
        anchors, x, rows, y = _sides(table, key[0].as_py())
        mine, label = anchors.column("idx").to_numpy(), anchors.column("label").to_numpy()
        labels, ids, idx = (rows.column(c).to_numpy() for c in ("label", "id", "idx"))
        scores = anchors.column("scores").combine_chunks()
        owner = np.repeat(np.arange(len(x)), pc.list_value_length(scores).to_numpy(zero_copy_only=False))
        top = scores.flatten().to_numpy(zero_copy_only=False)
        # low_share * top <= 100 * score <= high_share * top, in whole scores
        bottom, top = -((-low_share * top) // 100), high_share * top // 100
        out = _Best(len(top), keep)
        for cut in _cut(len(y)):
            for i in range(0, len(x), ACROSS):
                own = np.flatnonzero((owner >= i) & (owner < i + ACROSS))
                n = min(ACROSS, len(x) - i)
                low, high = np.full(n, NO_BOUND), np.full(n, -NO_BOUND)
                np.minimum.at(low, owner[own] - i, np.maximum(bottom[own], out.floor[own]))
                np.maximum.at(high, owner[own] - i, top[own])
                a, b, score = sliced(x[i : i + n], y[cut], low, high)
                a, b = a + i, b + cut.start
                other = label[a] != labels[b]
                a, b, score = a[other], b[other], score[other]
                # Each pair once for each positive of its anchor.
                first, last = np.searchsorted(owner, a), np.searchsorted(owner, a, side="right")
                each = np.repeat(np.arange(len(a)), last - first)
                place = np.arange(len(each)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[each]
                fits = (score[each] >= np.maximum(bottom, out.floor)[place]) & (score[each] <= top[place])
                each, place = each[fits], place[fits]
                out.add(place, score[each], ids[b[each]], idx[b[each]])
        at, score, ident, other = out.held
        nth = at - np.searchsorted(owner, owner[at])
        return pa.table({"idx": mine[owner[at]], "nth": nth.astype(np.int32), "other": other, "id": ident, "score": score})

    return best


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, and no component null, NaN or infinite."""
    bad = F.exists(vector, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return F.coalesce(~bad, F.lit(False))


def _dealt(anchors: DataFrame, rows: DataFrame, keys: list[str], block: int, tile: int) -> DataFrame:
    """Both sides once for each pair of a block of anchors and a tile of rows that agree on ``keys``.

    Blocks and tiles are dealt by hash, so that no key, however frequent, comes to one task.
    """
    counted = lambda df, n, size: df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(n))
    plan = small_side(durable(counted(anchors, "blocks", block).join(counted(rows, "tiles", tile), keys)))
    part = lambda n, salt: F.pmod(F.xxhash64("idx", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.join(plan, keys).withColumn("block", part("blocks", 1)).withColumn("tile", every("tiles"))
    right = rows.join(plan, keys).withColumn("tile", part("tiles", 2)).withColumn("block", every("blocks"))
    names = ["size", "label", "block", "tile", "idx", "id", "vector"]
    more = [c for c in anchors.columns if c == "scores"]
    left, right = left.select(*names, *more, F.lit(True).alias("anchor")), right.select(*names, F.lit(False).alias("anchor"))
    return left.unionByName(right, allowMissingColumns=True)


def _ranked(found: DataFrame, keys: list[str], keep: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, tile: int = TILE,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    A component becomes ``floor(scale * x)`` and a score is the integer product with the anchor; higher scores come
    first, equal ones by the smaller id. Anchors are the rows for which ``is_anchor`` (an expression over ``id``) holds.
    The positives of an anchor are the first ``positives`` other rows of its label; for each of them its negatives are
    the first ``negatives`` rows of other labels whose score is from ``low`` to ``high`` percent of the positive's.
    Rows with a null id, label or vector, or a null, NaN or infinite component take no part; rows meet rows with as many
    components only. Rows that repeat an id are rows of their own, and each is an anchor if the id is. Anchors without a
    positive or negative have no row; an empty table gives an empty result. Labels are compared as longs; other columns
    are not read. A product that no long holds raises an error.
    """
    rows = plain(vectors, id=id_col, vector=vector_col, label=label_col)
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.select(F.col("id").cast("long"), F.col("vector").cast("array<double>").alias("vector"), F.col("label").cast("long").alias("label"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    rows = rows.withColumn("idx", F.monotonically_increasing_id())
    rows = durable(rows.select("idx", "id", "label", F.size("vector").alias("size"), F.transform("vector", lambda x: F.floor(x * scale)).alias("vector")))
    anchors = rows.where(is_anchor)

    shared = _dealt(anchors, rows, ["label", "size"], block, tile)
    found = shared.groupBy("size", "label", "block", "tile").applyInArrow(_best_positives(positives), "idx bigint, other bigint, id bigint, score bigint")
    chosen = _ranked(found, ["idx"], positives).join(anchors.select("idx", F.col("id").alias("anchor_id")), "idx")
    nth = (F.col("rank") - 1).alias("nth")
    chosen = durable(chosen.select("idx", "anchor_id", nth, F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    scores = chosen.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))).alias("held"))  # ``positives`` at most
    ready = anchors.join(scores, "idx").select(*anchors.columns, F.col("held.positive_score").alias("scores"))
    dealt = _dealt(ready, rows, ["size"], block, tile)
    schema = "idx bigint, nth int, other bigint, id bigint, score bigint"
    mined = dealt.groupBy("size", "block", "tile").applyInArrow(_best_negatives(negatives, low, high), schema)
    mined = _ranked(mined, ["idx", "nth"], negatives).join(chosen, ["idx", "nth"])
    as_id = lambda c: F.col(c).cast(kind)
    return mined.select(
        as_id("anchor_id").alias("anchor_id"), as_id("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), as_id("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
