"""Removal of passages that repeat anywhere in the corpus, with a count-min prefilter.

First pass: every partition sketches how often its window anchors occur; the partition sketches are merged segment by
segment in a tree, some partitions at a time. An anchor of a window is its sub-window of half the length with the least hash, so equal windows have
equal anchors and a window's count is never above its anchor's, nor above the merged sketch. Second pass: only windows
whose estimate is two or more are grouped, by a 96-bit key over the whole window; none that repeats is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import shuffle_width

#: Odd multipliers of the two rolling hashes (3 or 5 modulo 8, so that powers keep their order modulo 2 ** 64).
BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4D)
SEGMENT_BITS = 20
#: Characters that a task turns into words at one time.
BLOCK_CHARS = 1_000_000
#: Sketches of one segment that a task merges.
FAN = 16
#: Cells of one sketch row, at most (64 MB as bits). Past that more windows reach the exact pass; the result is the same.
MAX_WIDTH_BITS = 29


class _Words(dict):
    """128-bit values of words, as bytes; refilled when it gets large."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 100_000:
            self.clear()
        self[word] = value = xxhash.xxh3_128_digest(word)
        return value


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list]]:
    """Runs of texts of bounded size, with the place of the first; a long text is a block of its own."""
    start, chars, block = 0, 0, []
    for k in range(len(texts)):
        text = texts[k].as_py() or ""
        if chars + len(text) > BLOCK_CHARS and block:
            yield start, block
            start, chars, block = k, 0, []
        block.append(text)
        chars += len(text)
    if block:
        yield start, block


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _rolling(values: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of each run of ``length`` values, modulo 2 ** 64."""
    n = len(values)
    power = np.multiply.accumulate(np.full(n, base, np.uint64)) if n else np.empty(0, np.uint64)
    back = np.multiply.accumulate(np.full(n, pow(base, -1, 2**64), np.uint64)) if n else power
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power, dtype=np.uint64)])
    return _mix((sums[length:] - sums[:-length]) * back[: n - length + 1]) if n >= length else np.empty(0, np.uint64)


def _slide(x: np.ndarray, width: int, fold) -> np.ndarray:
    """``fold`` (minimum or maximum) over each run of ``width`` values."""
    out, have = x, 1
    while have * 2 <= width:
        out = fold(out[:-have], out[have:])
        have *= 2
    return fold(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def _windows(cache: _Words, texts: list, window: int):
    """Of a block: words a text, the starts of whole windows, their anchors' hashes, anchor places, keys (on demand)."""
    parts = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    joined = b"".join([cache[w] for p in parts for w in p])
    values = np.frombuffer(joined, dtype="<u8").reshape(-1, 2)
    half = window // 2 + 1
    span = window - half + 1
    n = len(values)
    ends = np.repeat(np.cumsum(counts), counts)
    place = np.arange(n)
    if n < window:
        return counts, np.empty(0, int), None, np.empty(0, np.uint64), values
    small = _rolling(np.ascontiguousarray(values[:, 0]), half, BASES[0])
    inside = place[: len(small)] + half <= ends[: len(small)]
    low = _slide(np.where(inside, small, np.uint64(2**64 - 1)), span, np.minimum)
    starts = np.flatnonzero(place[: n - window + 1] + window <= ends[: n - window + 1])
    valid = np.zeros(len(low), bool)
    valid[starts] = True
    # A place is an anchor if it is the least of some whole window.
    reach = np.concatenate([np.zeros(span - 1, np.uint64), np.where(valid, low, np.uint64(0)), np.zeros(span - 1, np.uint64)])
    anchors = small[(_slide(reach, span, np.maximum) == small) & inside]
    return counts, starts, low, anchors, values


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (_mix(hashes + np.uint64(row * 0x632BE59BD9B4E019 % 2**64)) >> np.uint64(64 - bits)).astype(np.int64)


def _pack(offsets: np.ndarray) -> bytes:
    """Sorted offsets as gaps of one byte; 255 stands for a gap that goes on."""
    gaps = np.diff(offsets, prepend=0)
    last = np.cumsum(gaps // 255 + 1) - 1
    out = np.full(last[-1] + 1, 255, np.uint8)
    out[last] = gaps % 255
    return out.tobytes()


def _unpack(payload: bytes) -> np.ndarray:
    raw = np.frombuffer(payload, np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != 255]


def _sketch_rows(window: int, bits: int, depth: int):
    shift = min(bits, SEGMENT_BITS)

    def sketch(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, kept, part = _Words(), [], TaskContext.get().partitionId()
        for batch in rows:
            for _, texts in _blocks(batch.column(0)):
                kept.append(_windows(cache, texts, window)[3])
        anchors = np.concatenate(kept) if kept else np.empty(0, np.uint64)
        for row in range(depth):
            cells = np.sort(_cells(anchors, row, bits))
            if not len(cells):
                continue
            third = np.concatenate([np.zeros(min(2, len(cells)), bool), cells[2:] == cells[:-2]])
            cells = cells[~third]  # a counter stops at two
            segments = cells >> shift
            cuts = np.flatnonzero(np.diff(segments)) + 1
            firsts = np.concatenate([[0], cuts])
            packed = [_pack(part & ((1 << shift) - 1)) for part in np.split(cells, cuts)]
            whole = [np.full(len(firsts), v, np.int32) for v in (part // FAN, row)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, whole), pa.array(segments[firsts].astype(np.int32)), pa.array(packed, pa.binary())], names=["part", "row", "segment", "cells"])

    return sketch


def _merge_rows(shift: int, last: bool):
    """The sketches of one segment added up; counters stop at two. The last round gives a bit for each counter of two."""

    def merge(key, table):
        count = np.zeros(1 << shift, np.uint8)
        for payload in table.column("cells").to_pylist():
            cells = _unpack(payload)
            repeat = np.concatenate([[False], cells[1:] == cells[:-1]])
            once = cells[~repeat]
            count[once] = np.minimum(count[once] + 1, 2)
            count[cells[repeat]] = 2
        part, row, segment = (k.as_py() for k in key)
        seen = np.flatnonzero(count)
        out = np.packbits(count >= 2).tobytes() if last else _pack(np.repeat(seen, count[seen]))
        return pa.table({"part": [part // FAN], "row": [row], "segment": [segment], "cells": [out]}, schema=_SKETCH)

    return merge


_SKETCH = pa.schema([("part", pa.int32()), ("row", pa.int32()), ("segment", pa.int32()), ("cells", pa.binary())])
_SKETCH_SQL = "part int, row int, segment int, cells binary"


def repeated_sketch(docs: DataFrame, window: int, depth: int = 2) -> tuple[int, np.ndarray]:
    """``(bits, sketch)``: the merged sketch of all partitions, as one bit a cell for a count of two or more."""
    sizes = docs.select(F.octet_length("text").alias("size"), F.spark_partition_id().alias("part"))
    size, parts = sizes.agg(F.sum("size"), F.max("part") + 1).first()
    bits = min(MAX_WIDTH_BITS, max(12, int((size or 0) / 7).bit_length()))  # about eight cells an anchor
    shift = min(bits, SEGMENT_BITS)
    merged = docs.select("text").mapInArrow(_sketch_rows(window, bits, depth), _SKETCH_SQL)
    left = -(-(parts or 1) // FAN)
    while left > 1:
        merged = merged.groupBy("part", "row", "segment").applyInArrow(_merge_rows(shift, False), _SKETCH_SQL)
        left = -(-left // FAN)
    merged = merged.groupBy("part", "row", "segment").applyInArrow(_merge_rows(shift, True), _SKETCH_SQL)
    out = np.zeros((depth, (1 << bits) // 8), np.uint8)
    step = (1 << shift) // 8
    for _, row, segment, twice in merged.toLocalIterator():  # at most depth * 2 ** MAX_WIDTH_BITS bits
        out[row, segment * step : (segment + 1) * step] = np.frombuffer(bytes(twice), np.uint8)
    return bits, out


_KEYED = "k1 bigint, k2 int, id {id}, th bigint, start int, stop int"


def _candidate_rows(window: int, bits: int, depth: int, sketch):
    """Windows that may repeat. Those seen twice in a block are known already: they go out as runs, with one key for the others."""

    def candidates(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, twice = _Words(), sketch.value
        for batch in rows:
            ids, th = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for first, texts in _blocks(batch.column(2)):
                counts, starts, low, _, values = _windows(cache, texts, window)
                if not len(starts):
                    continue
                maybe = np.ones(len(starts), bool)
                for row in range(depth):
                    cells = _cells(low[starts], row, bits)
                    maybe &= (twice[row][cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
                starts = starts[maybe]
                if not len(starts):
                    continue
                k1 = _rolling(np.ascontiguousarray(values[:, 0]), window, BASES[0])[starts]
                k2 = _rolling(np.ascontiguousarray(values[:, 1]), window, BASES[1])[starts] >> np.uint64(32)
                begin = np.cumsum(counts) - counts
                doc = np.searchsorted(begin + counts, starts, side="right")
                place = starts - begin[doc]
                order = np.lexsort((k2, k1))
                same = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])
                known = np.zeros(len(starts), bool)
                known[order[1:][same]] = True
                known[order[:-1][same]] = True
                head = np.zeros(len(starts), bool)  # one of each known key
                head[order[np.concatenate([[True], ~same])]] = True
                head &= known
                alone = np.flatnonzero(~known)
                at = np.flatnonzero(known)
                cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(doc[at]) != 0) | (np.diff(place[at]) != 1)) if len(at) else np.empty(0, int)
                run_first = at[np.concatenate([[0], cut + 1])] if len(at) else at
                run_last = at[np.concatenate([cut, [len(at) - 1]])] if len(at) else at
                heads = np.flatnonzero(head)
                pick = np.concatenate([alone, run_first]).astype(np.int64)
                stops = np.concatenate([place[alone], place[run_last]]) + window
                own1 = np.concatenate([k1[alone].view(np.int64), th[first + doc[run_first]]])
                own2 = np.concatenate([k2[alone].astype(np.uint32).view(np.int32), place[run_first].astype(np.int32)])
                n = len(heads)
                tag = np.concatenate([place[alone], -place[run_first] - 1, np.zeros(n, np.int64)])  # below zero: a run that is known
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([own1, k1[heads].view(np.int64)])),
                        pa.array(np.concatenate([own2, k2[heads].astype(np.uint32).view(np.int32)])),
                        pa.concat_arrays([ids.take(pa.array(first + doc[pick])), pa.nulls(n, ids.type)]),
                        pa.array(np.concatenate([th[first + doc[pick]], np.zeros(n, np.int64)])),
                        pa.array(tag.astype(np.int32)),
                        pa.array(np.concatenate([stops, np.zeros(n, np.int64)]).astype(np.int32)),  # 0: a key seen twice elsewhere
                    ],
                    names=["k1", "k2", "id", "th", "start", "stop"],
                )

    return candidates


def _repeated_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key in, spans of repeated windows out. Of a key only its last row is held."""

    def spans(batch: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
        out = batch.filter(pa.array(keep))
        start = out.column(4).to_numpy(zero_copy_only=False)
        start = np.where(start < 0, -start - 1, start).astype(np.int64)
        return pa.RecordBatch.from_arrays([out.column(2), out.column(3), pa.array(start << 32 | out.column(5).to_numpy(zero_copy_only=False))], names=["id", "th", "span"])

    held, held_key, held_done = None, None, False
    for batch in rows:
        if not len(batch):
            continue
        k1, k2, start, stop = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4, 5))
        run = start < 0
        plain = np.flatnonzero(~run)
        keep = run.copy()
        if len(plain):
            a, b, elsewhere = k1[plain], k2[plain], stop[plain] == 0
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            repeated = np.zeros(len(plain), bool)
            repeated[1:] |= same
            repeated[:-1] |= same
            again = held_key == (a[0], b[0])
            if again:
                first = np.flatnonzero(np.concatenate([[True], ~same]))
                upto = first[1] if len(first) > 1 else len(plain)
                repeated[:upto] = True
                if not held_done:
                    yield spans(held, np.array([True]))
            keep[plain] = repeated & ~elsewhere
            last = int(plain[-1])
            held, held_key = batch.slice(last, 1), (a[-1], b[-1])
            held_done = bool(repeated[-1] or elsewhere[-1])
        if keep.any():
            yield spans(batch, keep)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, depth: int = 2) -> DataFrame:
    """``(row, kept, n_words, n_removed)``, one row for each row of ``docs``; ``row`` is the input row as a struct.

    Every word that lies in a window of ``window`` consecutive words of one text whose words also start at another place
    of any text, the same one included, is removed; windows are judged on the input. ``kept`` has the other words joined
    by one space. Null texts have no words; texts shorter than a window keep all. Rows that repeat id and text repeat
    each other; ids may be null or shared. An empty table gives an empty result. Any columns of ``docs`` are kept as
    they are inside ``row``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("row", F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text"))
    rows = rows.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    bits, sketch = repeated_sketch(rows.select("text"), window, depth)
    shared = spark.sparkContext.broadcast(sketch)
    schema = _KEYED.format(id=rows.schema["id"].dataType.simpleString())
    found = rows.select("id", "th", "text").mapInArrow(_candidate_rows(window, bits, depth, shared), schema)
    found = found.repartition(shuffle_width(spark), "k1", "k2").sortWithinPartitions("k1", "k2")
    spans = found.mapInArrow(_repeated_rows, f"id {rows.schema['id'].dataType.simpleString()}, th bigint, span bigint")
    spans = spans.groupBy("id", "th").agg(F.collect_set("span").alias("spans")).select(F.col("id").alias("span_id"), F.col("th").alias("span_th"), "spans")
    both = rows.join(spans, F.col("id").eqNullSafe(F.col("span_id")) & (F.col("th") == F.col("span_th")), "left")

    @F.pandas_udf("kept string, n_words long, n_removed long")
    def cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, found in zip(text, spans, strict=True):
            parts = (t or "").encode("utf-8", "surrogatepass").split()
            gone = np.zeros(len(parts) + 1, np.int32)
            if found is not None:
                np.add.at(gone, np.asarray(found, np.int64) >> 32, 1)
                np.subtract.at(gone, np.asarray(found, np.int64) & 0xFFFFFFFF, 1)
            left = np.flatnonzero(np.cumsum(gone[:-1]) == 0) if len(parts) else ()
            kept = parts if len(left) == len(parts) else [parts[i] for i in left]
            out.append((b" ".join(kept).decode("utf-8", "surrogatepass"), len(parts), len(parts) - len(kept)))
        return pd.DataFrame(out, columns=["kept", "n_words", "n_removed"])

    return both.select("row", cut("text", "spans").alias("c")).select("row", "c.kept", "c.n_words", "c.n_removed")
