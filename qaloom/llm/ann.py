"""Approximate nearest neighbours by inverted lists with an adaptive scan of dimensions.

1. A bounded sample fits the centroids.  Every vector goes to the list of its nearest centroid, and is
   also kept rotated at random, in column blocks, so that the distance over the first blocks
   estimates the whole distance.
2. A query probes the lists of its nearest centroids; how many is calibrated on the sample, so that
   the probed lists hold nearly all of the true neighbours there.
3. In a probed list, distances grow block by block.  After each block a hypothesis test abandons the
   candidates whose partial distance is too large for one of the nearest: scaled to all dimensions, it
   exceeds the bound by more than the estimate's error allows.  The bound is the distance of the
   query's 2k-th neighbour among the sampled vectors of its probed lists, so k surely lie within it.  What is left is measured exactly.
4. A query that the tests leave with fewer than k is scanned again without them.

Lists are cut into chunks and their queries into blocks, so no task holds a whole list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from qaloom.llm import common

#: Sampled vectors, most lists, sampled queries of the calibration and the share of true neighbours it must reach.
SAMPLE, MOST_LISTS, CALIBRATION, SHARE = 16_384, 1_024, 256, 0.98
#: Dimensions a column block, and how many standard errors of the estimate a candidate may exceed the bound by.
COLUMNS, ERRORS = 16, 2.1
#: Most vectors and queries of a list that meet in one group.
CHUNK, QUERIES = 8_192, 1_024
#: Rounding of a squared distance, as a share of the squared norms.
ROUNDING = 1e-12
#: Pairs whose differences are held at a time.
PAIRS = 1 << 16


def takes_part(v: Column) -> Column:
    inf = F.lit(float("inf"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 7, turns: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(turns):
        own = _distances(sample, centroids).argmin(1)
        total, n = np.zeros_like(centroids), np.bincount(own, minlength=len(centroids))
        np.add.at(total, own, sample)
        centroids[n > 0] = total[n > 0] / n[n > 0, None]
    return centroids


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def calibrated_probes(sample: np.ndarray, centroids: np.ndarray, k: int) -> int:
    """Lists a query must probe so that SHARE of its k nearest in the sample are in them."""
    if len(sample) < 2:
        return len(centroids)
    asked = np.random.default_rng(5).permutation(len(sample))[:CALIBRATION]  # not the first, as tables may be in order
    queries = sample[asked]
    own = _distances(sample, centroids).argmin(1)
    near = _distances(queries, sample)
    near[np.arange(len(queries)), asked] = np.inf
    k = min(k, len(sample) - 1)
    true = np.argpartition(near, k - 1, axis=1)[:, :k]
    place = _distances(queries, centroids).argsort(1).argsort(1)
    needed = np.sort(np.take_along_axis(place, own[true], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(SHARE * len(needed))))]) + 1


def _squares(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of rows i of a and j of b."""
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        s = slice(at, at + PAIRS)
        out[s] = ((a[i[s]] - b[j[s]]) ** 2).sum(1)
    return out


def scan(queries: np.ndarray, rotated_queries: np.ndarray, bound: np.ndarray, blocks: list[np.ndarray], vectors: np.ndarray, dim: int):
    """(query, vector, exact distance) of the candidates that no test abandons and the bound allows."""
    q, v = np.repeat(np.arange(len(queries)), len(vectors)), np.tile(np.arange(len(vectors)), len(queries))
    partial, seen = np.zeros(len(q)), 0
    slack = bound * (1 + 1e-6) + 1e-12
    own, other = ROUNDING * (queries * queries).sum(1), ROUNDING * (vectors * vectors).sum(1)
    for block in blocks:
        a = rotated_queries[:, seen : seen + block.shape[1]]
        if seen == 0:
            partial = (np.maximum((a * a).sum(1)[:, None] + (block * block).sum(1)[None] - 2 * a @ block.T, 0)).ravel()
        else:
            partial = partial + _squares(a, block, q, v)
        seen += block.shape[1]
        if seen < dim:
            alive = partial * (dim / seen) <= (slack[q] * (1 + ERRORS / np.sqrt(seen))) ** 2 + own[q] + other[v]
            q, v, partial = q[alive], v[alive], partial[alive]
    near = partial <= (slack[q] * (1 + 1e-4)) ** 2 + own[q] + other[v]
    q, v = q[near], v[near]
    exact = _squares(queries, vectors, q, v)
    keep = exact <= slack[q] ** 2 + own[q] + other[v]
    return q[keep], v[keep], np.sqrt(exact[keep])


def nearest(rows: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that `is_query` holds for, among all other rows.

    Vectors that are null, zero, of another than the commonest length, or hold null or non-finite components take no part.
    A query's own row is no candidate, though a repeated row is.  Equal distances go by vec_id.  Null keys take no part.
    An empty table, or one without queries, gives no rows; other columns are not looked at, whatever their names.
    """
    spark = common.ready(rows.sparkSession)
    used = rows.select(rows[key].cast("long").alias("id"), rows[vector].cast("array<double>").alias("v"), is_query.alias("is_query")).where(F.col("id").isNotNull() & takes_part(F.col("v")))
    used = common.written(used.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    common_length = used.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    out = "query_id long, rank int, vec_id long, score double"
    if common_length is None:
        return spark.createDataFrame([], out)
    dim = common_length["n"]
    used = used.where(F.size("v") == dim)
    n = used.count()
    rate = min(1.0, SAMPLE / n)
    drawn = used.where(F.shiftrightunsigned(F.xxhash64("uid"), 11) < F.lit(rate * (1 << 53))).select("uid", "v").toPandas().sort_values("uid")  # SAMPLE rows on average
    sample, sample_uid = np.stack(drawn["v"].to_numpy()) if len(drawn) else np.zeros((0, dim)), drawn["uid"].to_numpy()
    lists = int(min(MOST_LISTS, max(1, round(n**0.5)), max(1, len(sample))))
    centroids = fit_centroids(sample, lists) if len(sample) else np.zeros((1, dim))
    probes, turn, spare = calibrated_probes(sample, centroids, k), rotation(dim), 2 * k
    sample_list = _distances(sample, centroids).argmin(1)
    sizes = np.bincount(sample_list, minlength=len(centroids))

    def unpack(batch):
        flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(-1, dim)

    def assign():
        def each(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("id"), part.column("v"), pa.array(_distances(unpack(part), centroids).argmin(1).astype(np.int32))], ["uid", "id", "v", "list"])

        return each

    def probe():
        def each(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                v, uid = unpack(part), part.column("uid").to_numpy()
                order = np.argsort(_distances(v, centroids), axis=1)
                held = np.cumsum(sizes[order], axis=1)  # sampled vectors in a query's first lists
                many = np.maximum(probes, np.minimum((held < spare + 1).sum(1) + 1, len(centroids)))
                near = _distances(v, sample)
                near[uid[:, None] == sample_uid[None]] = np.inf
                place = order.argsort(1)
                near[place[:, sample_list] >= many[:, None]] = np.inf
                bound = np.partition(near, spare - 1, axis=1)[:, spare - 1] if len(sample) >= spare else np.full(len(v), np.inf)
                for q, m in enumerate(many.tolist()):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, uid[q])), part.column("id").take(pa.array(np.full(m, q))), part.column("v").take(pa.array(np.full(m, q))), pa.array(np.full(m, bound[q])), pa.array(order[q, :m].astype(np.int32))], ["uid", "id", "v", "bound", "list"])

        return each

    indexed = common.written(common.arrow_map(used.select("uid", "id", "v"), assign, "uid long, id long, v array<double>, list int"), "index")
    probing = common.written(common.arrow_map(used.where("is_query").select("uid", "id", "v"), probe, "uid long, id long, v array<double>, bound double, list int"), "probes")
    count = lambda df, most, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias(name))
    cells = count(indexed, CHUNK, "chunks").join(count(probing, QUERIES, "blocks"), "list")  # a row a list: MOST_LISTS at most
    deal = lambda c: F.pmod(F.xxhash64("uid"), F.col(c)).cast("int")
    each_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    vectors = indexed.join(F.broadcast(cells), "list").withColumn("chunk", deal("chunks")).withColumn("block", each_of("blocks")).select("list", "chunk", "block", "uid", "id", "v")
    asked = probing.join(F.broadcast(cells), "list").withColumn("block", deal("blocks")).withColumn("chunk", each_of("chunks")).select("list", "chunk", "block", "uid", "id", "v", "bound")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], t) for c, t in (("quid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        if not left.num_rows or not right.num_rows:
            return empty
        lay = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        v, q = lay(left), lay(right)
        rotated, bound = v @ turn, right["bound"].to_numpy()
        blocks = [np.ascontiguousarray(rotated[:, a : a + COLUMNS]) for a in range(0, dim, COLUMNS)]
        uid, vid, quid, qid = left["uid"].to_numpy(), left["id"].to_numpy(), right["uid"].to_numpy(), right["id"].to_numpy()
        found = []
        step = max(1, ((4 << 20) if np.isfinite(bound).all() else (1 << 19)) // max(1, len(v)))
        for at in range(0, len(q), step):
            s = slice(at, at + step)
            i, j, d = scan(q[s], q[s] @ turn, bound[s], blocks, v, dim)
            other = quid[s][i] != uid[j]
            f = pd.DataFrame({"quid": quid[s][i][other], "query_id": qid[s][i][other], "vec_id": vid[j][other], "score": d[other]})
            found.append(f.sort_values(["quid", "score", "vec_id"], kind="stable").groupby("quid", sort=False).head(k))
        return pa.Table.from_pandas(pd.concat(found), schema=empty.schema, preserve_index=False) if found else empty

    key3 = ["list", "chunk", "block"]
    order = Window.partitionBy("quid").orderBy("score", "vec_id")

    def best(asked: DataFrame) -> DataFrame:
        partial = vectors.groupBy(*key3).cogroup(asked.groupBy(*key3)).applyInArrow(meet, "quid long, query_id long, vec_id long, score double")
        return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = common.written(best(asked), "neighbours")
    whole = found.where(F.col("rank") == min(k, n - 1)).select("quid")
    short = asked.join(whole, asked["uid"] == whole["quid"], "left_anti").withColumn("bound", F.lit(float("inf")))
    if short.take(1):
        found = found.join(whole, "quid", "left_semi").unionByName(best(short).select(*found.columns))
    return found.select("query_id", "rank", "vec_id", "score")
