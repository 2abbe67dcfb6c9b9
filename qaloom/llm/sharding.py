"""Shards of near equal bytes by sampled splitters.

Records are ordered by (hash of the text, hash of the record), so equal texts are neighbours.

1. A sample of keys, each drawn with a chance in proportion to its size, is small whatever the table;
   its quantiles are splitters of many fine ranges.
2. The ranges' exact bytes and rows are counted.  An overfull range - a group of copies, a run of
   small rows or bad luck - is subdivided by a sample of its own, inside the group if need be.
3. Running sums over the ranges, and within each, place every record on the scale from 0 to all
   bytes; equal parts of that scale are the shards.  Equal texts go where the first of them goes,
   unless their group was cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from qaloom.llm import common

#: Fine ranges a shard, and sampled keys a range.
RANGES, SAMPLES = 64, 16
#: A range is overfull with so many times the mean bytes or rows.
OVERFULL_BYTES, OVERFULL_ROWS, ROUNDS = 2.0, 3.0, 4


def _composite(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """(h, d) as 16 bytes that compare as the pair does."""
    flip = np.uint64(1 << 63)
    pair = np.stack([h.view(np.uint64) ^ flip, d.view(np.uint64) ^ flip], axis=1).astype(">u8")
    return np.ascontiguousarray(pair).view("S16").ravel()


def _in_ranges(slim: DataFrame, splitters: np.ndarray, carry: list[str]) -> DataFrame:
    """Adds `range`: how many splitters are at or before a row's key."""

    def make():
        def each(batch: pa.RecordBatch):
            h, d = (batch.column(c).to_numpy() for c in ("h", "d"))
            at = np.searchsorted(splitters, _composite(h, d), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(at)], [*carry, "range"])

        return each

    kinds = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in carry)
    return common.arrow_map(slim.select(*carry), make, kinds + ", range int")


def _drawn(rows: DataFrame, rate, salt: int) -> DataFrame:
    """A draw of each row with the chance `rate` x size, by a hash of its key."""
    u = F.shiftrightunsigned(F.xxhash64("h", "d", F.lit(salt)), 11) / F.lit(float(1 << 53))
    return rows.where(u < rate * F.col("size"))


def _quantiles(h: np.ndarray, d: np.ndarray, weight: np.ndarray, parts: int, whole_groups: bool) -> np.ndarray:
    keys = _composite(h, np.full_like(d, np.iinfo(np.int64).min) if whole_groups else d)
    order = np.argsort(keys, kind="stable")
    upto = np.cumsum(weight[order])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)
    return np.unique(keys[order][np.minimum(at, len(keys) - 1)])


def _sample_splitters(slim: DataFrame, total: int, shards: int) -> np.ndarray:
    wanted = shards * RANGES * SAMPLES
    rate = wanted / total
    drawn = _drawn(slim, F.lit(rate), 0).select("h", "d", "size").toPandas()  # `wanted` rows on average, a fixed number
    if not len(drawn):
        return np.zeros(0, "S16")
    weight = np.maximum(drawn["size"].to_numpy(), 1 / rate)
    return _quantiles(drawn["h"].to_numpy(), drawn["d"].to_numpy(), weight, shards * RANGES, True)


def _subdivided(slim: DataFrame, splitters: np.ndarray, shards: int) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """The splitters with overfull ranges cut, and each range's exact (bytes, rows)."""
    wanted = shards * RANGES
    for turn in range(ROUNDS + 1):
        found = _in_ranges(slim, splitters, ["h", "d", "size"])
        counts = {r["range"]: (r["bytes"], r["rows"]) for r in found.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()}  # a row a range
        size, rows = (sum(x) for x in zip(*counts.values(), strict=True))
        parts = {k: int(max(b * wanted / size, n * wanted / rows)) for k, (b, n) in counts.items() if n > 1 and (b * wanted > OVERFULL_BYTES * size or n * wanted > OVERFULL_ROWS * rows and n > 1000)}
        if not parts or turn == ROUNDS:
            return splitters, counts
        rate = F.element_at(F.create_map(*(F.lit(x) for k, p in parts.items() for x in (k, float((p + 1) * SAMPLES / counts[k][0])))), F.col("range"))
        drawn = _drawn(found.where(F.col("range").isin([*parts])), rate, turn + 1).toPandas()  # bounded as the first sample is
        more = []
        for k, g in drawn.groupby("range"):
            weight = np.maximum(g["size"].to_numpy(), counts[k][0] / ((parts[k] + 1) * SAMPLES))
            more.append(_quantiles(g["h"].to_numpy(), g["d"].to_numpy(), weight, parts[k] + 1, False))
        grown = np.unique(np.concatenate([splitters, *more]))
        if len(grown) == len(splitters):
            return splitters, counts
        splitters = grown
    raise AssertionError


def shard_by_bytes(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """One row a document: `key`, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    size: UTF-8 bytes of the text (null: none) plus `overhead`.  text_crc32 of a null text is that of an empty one.
    Shards have near equal sums of sizes; slots count from 0 without gaps.  Equal texts share a shard unless their group
    alone is larger than a fine range.  Repeated rows and null keys keep a row each; an empty table gives no rows.
    """
    spark = common.ready(docs.sparkSession)
    plain = F.coalesce(docs[text], F.lit(""))
    slim = docs.select(
        docs[key].alias("k"), (F.octet_length(plain) + F.lit(overhead)).cast("long").alias("size"), F.crc32(plain).alias("crc"),
        F.xxhash64(plain).alias("h"), F.xxhash64(docs[key], F.monotonically_increasing_id()).alias("d"),
    )
    slim = common.written(slim, "shard-keys")
    total = slim.agg(F.sum("size")).first()[0] or 0
    if not total:
        empty = slim.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
        return empty
    splitters, counts = _subdivided(slim, _sample_splitters(slim, total, shards), shards)
    n = len(splitters) + 1
    size, rows = (np.array([counts.get(i, (0, 0))[j] for i in range(n)], np.int64) for j in (0, 1))
    bytes_before, rows_before = np.cumsum(size) - size, np.cumsum(rows) - rows
    cut = np.zeros(n, bool)  # ranges that begin or end inside a group of equal texts
    if n > 1:
        inside = np.array([s[8:].ljust(8, b"\0") != bytes(8) for s in splitters.tolist()])
        cut[1:] |= inside
        cut[:-1] |= inside
    bounds = spark.createDataFrame(list(zip(range(n), bytes_before.tolist(), rows_before.tolist(), cut.tolist(), strict=True)), "range int, bytes_before long, rows_before long, cut boolean")
    found = _in_ranges(slim, splitters, ["k", "size", "crc", "h", "d"]).join(F.broadcast(bounds), "range")  # a few thousand ranges
    order = Window.partitionBy("range").orderBy("h", "d")
    group = Window.partitionBy("range", "h")
    upto = F.col("bytes_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = found.withColumn("at", upto).withColumn("rank", F.col("rows_before") + F.row_number().over(order) - 1)
    placed = placed.withColumn("at", F.when(F.col("cut"), F.col("at")).otherwise(F.min("at").over(group)))
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("at") * shards / F.lit(total))).cast("int"))
    placed = common.written(placed.select("k", "size", "crc", "shard", "rank"), "shards")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # `shards` rows
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
