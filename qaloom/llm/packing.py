"""Best-fit packing of token sequences by their length histogram.

Lengths are whole numbers up to the capacity, so a histogram of at most `capacity` counts says all
that packing needs, however many documents there are.  The plan is made on it alone:

1. pieces over a third of the capacity: at most two share a bin, so they are matched greedily, the
   longest with the longest that still fits beside it;
2. shorter pieces, longest first, go where the gap that is left is least (best fit), new bins last.

Bins of equal content are one group with a multiplicity.  A step splits at most one group in three,
so there are under 4 x capacity groups, each with under sqrt(2 x capacity) different lengths: the
plan is bounded by the capacity alone.  Pieces get their places by their rank among the pieces of
their length, which is a running count over the chunks that hold them; no window runs over a length.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from qaloom.llm import common, pretoken, vocabulary


def _match_large(left: dict[int, int], capacity: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Groups (gap, bins, [(length, copies)]) of one or two long pieces a bin."""
    groups, sizes = [], sorted(left)
    while sizes:
        a = sizes.pop()
        n = left[a]
        while n:
            fits = bisect_right(sizes, capacity - a)
            if 2 * a <= capacity and n > 1 and fits == len(sizes):  # its like is the longest that fits
                groups.append((capacity - 2 * a, n // 2, [(a, 2)]))
                n %= 2
            elif fits:
                b = sizes[fits - 1]
                m = min(n, left[b])
                groups.append((capacity - a - b, m, [(a, 1), (b, 1)]))
                n, left[b] = n - m, left[b] - m
                if not left[b]:
                    del sizes[fits - 1]
            else:
                groups.append((capacity - a, n, [(a, 1)]))
                n = 0
    return groups


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal bins: (bins, [(length, copies a bin)]), covering each length's count exactly."""
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(gap, bins, items):
        if bins:
            gaps.setdefault(gap, []).append((bins, items))

    for gap, bins, items in _match_large({x: n for x, n in histogram.items() if n and 3 * x > capacity}, capacity):
        put(gap, bins, items)
    for s in sorted((x for x, n in histogram.items() if n and 3 * x <= capacity), reverse=True):
        left = histogram[s]
        for gap in sorted(g for g in gaps if g >= s):
            if not left:
                break
            each, waiting = gap // s, gaps.pop(gap)
            for bins, items in waiting:
                full = min(bins, left // each)
                put(gap - each * s, full, [*items, (s, each)])
                left -= full * each
                part = left if full < bins else 0
                if part:
                    put(gap - part * s, 1, [*items, (s, part)])
                    left = 0
                put(gap, bins - full - bool(part), items)
        each = capacity // s
        put(capacity - each * s, left // each, [(s, each)])
        if left % each:
            put(capacity - left % each * s, 1, [(s, left % each)])
    return [group for gap in sorted(gaps) for group in gaps[gap]]


def placements(groups: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: which bins and which offset in them."""
    taken: dict[int, int] = {}
    rows, first_bin = [], 0
    for bins, items in groups:
        offset = 0
        for length, copies in items:
            rank = taken.get(length, 0)
            rows.append((length, rank, bins, first_bin, offset))
            taken[length] = rank + bins * copies
            offset += length * copies
        first_bin += bins
    rows.sort()
    names = ("length", "rank", "bins", "first_bin", "offset")
    return {n: np.array(c, np.int64) for n, c in zip(names, zip(*rows, strict=True) if rows else [[]] * 5, strict=True)}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full, but for the first if n isn't a multiple."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))] if n > capacity else [(0, n)]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The documents' pieces: k, piece, start, length, ids_crc32, chunk (the task that made it), nth (of its length in the
    chunk) and, if asked for, ids."""
    vocabulary.check_byte_level(path)
    common.ready(docs.sparkSession)
    runs, specials, end = pretoken.class_runs("tokenizers"), tuple(vocabulary.json_specials(path)), struct.pack("<I", end_id)
    slim = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    names = ["piece", "start", "length", "ids_crc32", "nth", *["ids"] * with_ids]

    def make():
        splitter, words, seen, chunk = pretoken.Splitter(runs, specials), vocabulary.json_words(path), [0] * (capacity + 1), TaskContext.get().partitionId()

        def each(batch: pa.RecordBatch):
            keys, texts = batch.columns
            for first, block in pretoken.text_blocks(texts, common.BLOCK_BYTES):
                found, at, bounds = splitter.words(block)
                data, offsets = vocabulary.gathered(words.ids(found), at)
                edges = offsets[bounds].tolist()
                rows, owner = [], []
                for i in range(len(block)):
                    ids = data[edges[i] : edges[i + 1]].tobytes() + end
                    for p, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + length)]
                        rows.append((p, start, length, zlib.crc32(part), seen[length], *[part] * with_ids))
                        owner.append(i)
                        seen[length] += 1
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                columns[0] = columns[0].cast(pa.int32())
                yield pa.RecordBatch.from_arrays([keys.slice(first, len(block)).take(pa.array(owner)), pa.array([chunk] * len(rows), pa.int64()), *columns], ["k", "chunk", *names])

        return each

    kind = slim.schema["k"].dataType.simpleString()
    return common.arrow_map(slim, make, f"k {kind}, chunk long, piece int, start long, length long, ids_crc32 long, nth long" + ", ids binary" * with_ids)


def best_fit_packing(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Places every document, cut into pieces of at most `capacity` tokens, in sequences of at most `capacity`.

    Returns a row a piece: `key`, piece, start, length, ids_crc32, sequence_id, offset (and ids if `with_ids`).  A null or
    empty text is the end id alone; repeated rows and null keys are documents of their own; an empty table gives no rows.
    """
    spark = common.ready(docs.sparkSession)
    cut_up = common.written(pieces(docs, path, capacity, end_id, key, text, with_ids), "pieces")
    counts = cut_up.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = placements(pack_histogram(histogram, capacity))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut_up.join(base, ["chunk", "length"]).withColumn("rank", F.col("before") + F.col("nth")).drop("chunk", "before", "nth")
    step = np.int64(1) << 48
    order = plan["length"] * step + plan["rank"]
    out = [*(c for c in ranked.columns if c != "rank")]

    def make():
        def each(batch: pa.RecordBatch):
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = np.searchsorted(order, length * step + rank, "right") - 1
            nth = rank - plan["rank"][run]
            bins = plan["bins"][run]
            where = [pa.array(plan["first_bin"][run] + nth % bins), pa.array(plan["offset"][run] + nth // bins * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), *where], [*out, "sequence_id", "offset"])

        return each

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    placed = common.arrow_map(ranked, make, f"{kinds}, sequence_id long, offset long")
    return placed.select(F.col("k").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
