"""Near-duplicate vectors by cosine: PCA-ordered, tiled comparison with suffix-norm bounds.

Unit vectors are rotated onto the principal axes of all rows, strongest first. Cells of a tree over the leading axes are
cut into tiles; two tiles accumulate the products of the leading axes, and the rest of a product is at most the product
of the suffix norms, so a pair whose sum and bound stay below the threshold is dropped, and the accumulation stops when
no pair of a block is left. Every survivor is compared in double precision over the original components. Tiles whose
boxes over the leading axes are too far apart for the threshold never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import durable, plain
from stepweave.llm.components import connected_components, local_forest

#: A bound is compared with this much room, far above the rounding of 64 products and far below any use.
ROOM = 1e-9
#: The longest vectors that are rotated.
WIDEST = 1024
#: Rows from which the tree of cells is cut, and the leading axes that it and the boxes of the cells use.
SAMPLE, BOX = 8192, 16
#: Rows and columns of a block of products.
HIGH, WIDE = 512, 2048


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch by the length of its last column."""
    sizes = pc.list_value_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        yield int(dim), batch if (sizes == dim).all() else batch.filter(pa.array(sizes == dim))


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(id, idx, vector)`` with the vector at length one; null where it can link with nothing.

    Scaled by the largest component first: squares of very large or small components neither overflow nor vanish.
    """
    for batch in batches:
        vectors = batch.column(2)
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        good = sizes > 0
        good[row[~np.isfinite(values)]] = False
        top = np.zeros(len(sizes))
        np.maximum.at(top, row, np.where(np.isfinite(values), np.abs(values), 0))
        good &= top > 0
        values, row = values[good[row]], row[good[row]]
        values = values / top[row]
        values /= np.sqrt(np.bincount(row, values * values, minlength=len(sizes)))[row]
        ends = np.concatenate([[0], np.cumsum(np.where(good, sizes, 0))]).astype(np.int32)
        units = pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(~good))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), units], names=["id", "idx", "unit"])


def principal_axes(units: DataFrame, dims: list[int]) -> dict[int, np.ndarray]:
    """For each length orthogonal axes, strongest first, of the second moments over all its rows (summed by Spark)."""
    if not dims:
        return {}

    def partial(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[int, np.ndarray] = {}
        for batch in rows:
            for dim, part in _by_length(batch):
                x = _matrix(part.column(0), dim)
                grams[dim] = grams.get(dim, 0) + x.T @ x
        for dim, gram in grams.items():
            i, j = np.indices((dim, dim))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim * dim, dim)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(gram.ravel())], names=["dim", "i", "j", "s"])

    moments = units.where(F.size("unit").isin(dims)).select("unit").mapInArrow(partial, "dim bigint, i bigint, j bigint, s double")
    grams = {dim: np.zeros((dim, dim)) for dim in dims}
    for dim, i, j, s in moments.groupBy("dim", "i", "j").agg(F.sum("s")).collect():
        grams[dim][i, j] = s
    out = {}
    for dim, gram in grams.items():
        values, axes = np.linalg.eigh((gram + gram.T) / 2)
        out[dim] = np.ascontiguousarray(axes[:, np.argsort(-values)])
    return out


def _tree(points: np.ndarray, leaves: int, depth: int = 0) -> tuple | None:
    """Median cuts of a sample over its widest axes, ``(axis, value, left, right)``; None is a leaf."""
    if leaves < 2 or len(points) < 2:
        return None
    axis = int(np.argmax(np.var(points, axis=0)))
    cut = float(np.median(points[:, axis]))
    low = points[:, axis] < cut
    if not low.any():
        return None
    return axis, cut, _tree(points[low], leaves // 2, depth + 1), _tree(points[~low], leaves - leaves // 2, depth + 1)


def _cells(tree: tuple | None, points: np.ndarray) -> np.ndarray:
    """The leaf of each point, numbered along the path from the root."""
    out = np.zeros(len(points), np.int64)
    stack = [(tree, np.arange(len(points)), 1)]
    while stack:
        node, rows, name = stack.pop()
        if node is None or not len(rows):
            out[rows] = name
            continue
        axis, cut, left, right = node
        low = points[rows, axis] < cut
        stack += [(left, rows[low], 2 * name), (right, rows[~low], 2 * name + 1)]
    return out


def _steps(dim: int, lead: int) -> list[int]:
    """Axes that are accumulated before a bound is looked at: doubled each time, and all of them in the end."""
    steps = [min(lead, dim)]
    while steps[-1] < dim:
        steps.append(min(2 * steps[-1], dim))
    return steps


class _Links:
    """Link counts and the forest of the links of one pair of tiles, never the links themselves."""

    def __init__(self, n: int):
        self.count, self.root = np.zeros(n, np.int64), np.arange(n)

    def add(self, rows: np.ndarray, cols: np.ndarray) -> None:
        n = len(self.root)
        self.count += np.bincount(rows, minlength=n) + np.bincount(cols, minlength=n)
        a, b = self.root[rows], self.root[cols]
        apart = a != b
        if apart.any():
            self.root = local_forest(a[apart], b[apart], n)[self.root]


def _tile_pairs(axes: dict[int, np.ndarray], threshold: float, lead: int):
    """Task side: one pair of tiles at a time, emitting link counts a row and the forest of its links, never its pairs."""

    def pairs(key, table):
        table = table.take(pa.array(np.lexsort((table.column("idx").to_numpy(), table.column("own").to_numpy()))))
        dim = key[0].as_py()
        x = _matrix(table.column("unit").combine_chunks(), dim)
        idx, own = table.column("idx").to_numpy(), table.column("own").to_numpy()
        same = key[1].as_py() == key[2].as_py()
        cut = 0 if same else int(np.searchsorted(own, own[0], side="right"))
        steps = _steps(dim, lead)
        p = x @ axes[dim] if dim in axes else x
        tails = np.sqrt(np.maximum(0, np.stack([(p[:, s:] ** 2).sum(axis=1) for s in steps])))
        # Leading products and the bound of the rest are one product of vectors that have their suffix norm as a further component.
        first = np.column_stack([p[:, : steps[0]], tails[0]]).astype(np.float32)
        least = np.float32(threshold - ROOM - 2e-7 * (steps[0] + 8))
        links = _Links(len(x))
        left, right = (np.arange(len(x)),) * 2 if same else (np.arange(cut), np.arange(cut, len(x)))
        for i in range(0, len(left), HIGH):
            r = left[i : i + HIGH]
            for j in range(i // WIDE * WIDE if same else 0, len(right), WIDE):
                c = right[j : j + WIDE]
                bound = first[r[0] : r[-1] + 1] @ first[c[0] : c[-1] + 1].T
                if bound.max() < least:
                    continue
                a, b = np.nonzero(bound >= least)
                a, b = r[a], c[b]
                if same:
                    a, b = a[a < b], b[a < b]
                done, total = 0, np.zeros(len(a))
                for k, upto in enumerate(steps):
                    if len(a) * 8 > bound.size:  # a dense group: whole products cost less than pair by pair
                        break
                    total = total + np.einsum("ij,ij->i", p[a, done:upto], p[b, done:upto])
                    alive = total + tails[k, a] * tails[k, b] >= threshold - ROOM
                    a, b, total, done = a[alive], b[alive], total[alive], upto
                    if not len(a):
                        break
                if not len(a):
                    continue
                if len(a) * 8 > bound.size:
                    near = (x[r] @ x[c].T)[a - r[0], b - c[0]] >= threshold
                else:
                    near = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 8192]], x[b[k : k + 8192]]) >= threshold for k in range(0, len(a), 8192)])
                links.add(a[near], b[near])
        hit = links.count > 0
        return pa.table({"idx": idx[hit], "root": idx[links.root[hit]], "n": links.count[hit]})

    return pairs


def _far(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Squared distance of one box ``(low, high)`` to each of several."""
    gap = np.maximum(0, np.maximum(boxes[:, 0] - box[1], box[0] - boxes[:, 1]))
    return (gap**2).sum(axis=1)


def _deal(units: DataFrame, counts: dict[int, int], axes: dict[int, np.ndarray], threshold: float, tile: int) -> DataFrame:
    """``(size, a, b, own, idx, unit)``: each row once for each tile that its own has to meet.

    A tree over a bounded sample names the cell of every row; its box spans the leading axes of all its rows. Cells of
    more than ``tile`` rows are cut by hash, so equal vectors fill several tiles.
    """
    trees = {}
    for dim, n in counts.items():
        some = units.where(F.size("unit") == dim).where(F.pmod(F.xxhash64("idx"), F.lit(n)) < SAMPLE).select("unit").collect() if n > tile else []  # about SAMPLE rows
        points = np.array([r.unit for r in some], float).reshape(-1, dim)
        trees[dim] = _tree((points @ axes[dim] if dim in axes else points)[:, :BOX], -(-n // tile))

    def lead(part: pa.RecordBatch, dim: int) -> np.ndarray:
        x = _matrix(part.column(part.num_columns - 1), dim)
        return x @ axes[dim][:, :BOX] if dim in axes else x[:, :BOX]

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in rows:
            for dim, part in _by_length(batch):
                points = lead(part, dim)
                cells = _cells(trees[dim], points)
                for cell in np.unique(cells):
                    own = points[cells == cell]
                    n, low, high = held.get((dim, cell), (0, np.inf, -np.inf))
                    held[dim, cell] = n + len(own), np.minimum(low, own.min(axis=0)), np.maximum(high, own.max(axis=0))
        for (dim, cell), (n, low, high) in held.items():
            k = len(low)
            yield pa.RecordBatch.from_arrays([pa.array([dim] * k, pa.int32()), pa.array([cell] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([n] * k, pa.int64()), pa.array(low), pa.array(high)], names=["size", "cell", "axis", "n", "low", "high"])

    found = units.select("unit").mapInArrow(place, "size int, cell bigint, axis int, n bigint, low double, high double")
    found = found.groupBy("size", "cell", "axis").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    cells: dict[int, dict[int, dict]] = {}
    for r in found.collect():  # a cell has some tile / 2 rows or more: 16 rows for each of them
        cells.setdefault(r.size, {}).setdefault(r.cell, {})[r.axis] = (r.n, r.low, r.high)
    plan = {}
    for dim, own in cells.items():
        names = np.array(sorted(own))
        boxes = np.array([[[own[c][a][k] for a in sorted(own[c])] for k in (1, 2)] for c in names])
        parts = np.array([-(-own[c][0][0] // tile) for c in names])
        plan[dim] = names, boxes, parts, np.cumsum(parts) - parts
    limit = 2 - 2 * threshold + ROOM

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], np.ndarray] = {}
        for whole in rows:
            for at in range(0, len(whole), 1024):
                for dim, part in _by_length(whole.slice(at, 1024)):
                    names, boxes, parts, start = plan[dim]
                    cell = np.searchsorted(names, _cells(trees[dim], lead(part, dim)))
                    for c in np.unique(cell):
                        if (dim, c) not in met:
                            near = np.flatnonzero(_far(boxes[c], boxes) <= limit)
                            met[dim, c] = np.concatenate([np.arange(start[k], start[k] + parts[k]) for k in near])
                    h = part.column(1).to_numpy(zero_copy_only=False)
                    own = start[cell] + h % parts[cell]
                    each = np.array([len(met[dim, c]) for c in cell])
                    row, other = np.repeat(np.arange(len(cell)), each), np.concatenate([met[dim, c] for c in cell])
                    mine = own[row]
                    cols = [np.full(len(row), dim, np.int32), np.minimum(mine, other).astype(np.int32), np.maximum(mine, other).astype(np.int32), mine.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), part.column(0).take(pa.array(row)), part.column(2).take(pa.array(row))], names=["size", "a", "b", "own", "idx", "unit"])

    hashed = units.select("idx", F.pmod(F.xxhash64("idx", F.lit(1)), F.lit(1 << 30)).alias("h"), "unit")
    return hashed.mapInArrow(deal, "size int, a int, b int, own int, idx bigint, unit array<double>")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tile: int = 16384, lead: int = 24) -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row for each row of ``vectors``.

    Rows at cosine ``threshold`` or more are linked (``threshold`` above 0). Null, empty or zero vectors, those with a
    null or non-finite component link with nothing: no link, a component of their own. Vectors are compared with all
    others of their length. Rows that repeat an id are vectors of their own and count each other when they are near;
    null ids take part, and a component of null ids only has a null ``component_id``. An empty table gives an empty
    result. Rows of a length are compared in tiles of about ``tile`` rows, each pair of tiles in one task; where the
    vectors spread evenly over all axes no pair of tiles is ruled out, and the work is that of all pairs of rows.
    """
    rows = plain(vectors, id=id_col, vector=vector_col).withColumn("idx", F.monotonically_increasing_id())
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.select("id", "idx", F.col("vector").cast("array<double>").alias("vector"))
    rows = durable(rows.mapInArrow(_unit_rows, f"id {kind}, idx bigint, unit array<double>"))
    units = rows.where("unit IS NOT NULL").select("idx", "unit")
    counts = {r["size"]: r.n for r in units.groupBy(F.size("unit").alias("size")).agg(F.count("*").alias("n")).where("n > 1").collect()}  # one row a length
    units = units.where(F.size("unit").isin(list(counts)))
    # The rotation only saves work: short of rows, or where its squared length is too much for the driver, there is none.
    axes = principal_axes(units, [dim for dim, n in counts.items() if n > dim and dim <= WIDEST])
    dealt = _deal(units, counts, axes, threshold, tile)
    found = durable(dealt.groupBy("size", "a", "b").applyInArrow(_tile_pairs(axes, threshold, lead), "idx bigint, root bigint, n bigint"))
    roots = connected_components(found.select(F.col("idx").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("idx").agg(F.sum("n").alias("n_links"))
    placed = rows.select("id", "idx").join(links, "idx", "left").join(roots.withColumnRenamed("node", "idx"), "idx", "left")
    placed = placed.select("id", "idx", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "idx").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    out = placed.join(lowest, "root").select("id", "n_links", "component_id")
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
