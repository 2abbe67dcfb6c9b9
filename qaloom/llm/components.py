"""Connected components by alternating stars (Kiveris et al., Connected Components in MapReduce and Beyond, 2014).

Every step is a minimum over neighbours and a join on the node, so nothing is gathered: a hub with a
third of all edges is a partial minimum and a split join.  Each round's edges are a table in the
shared folder.  Before the first round each task replaces the edges that it happens to read by stars
of what they connect, which spares most rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm import common

#: Most edges that a task contracts at a time.
CONTRACTED = 1_000_000


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that these edges connect it to), for every node but the least ones themselves."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(node))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(node))
    return node[moved], node[label[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CONTRACTED:
                yield stars(held)
                held, n = [], 0
        if held:
            yield stars(held)

    def stars(held):
        a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in star_edges(a, b)], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written, so that the join's sides are plain exchanges, which Spark splits at a hub
    least = common.written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = common.written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long).  Returns node, label: the least node that links reach, for every node of an edge.  Rows with a null
    end or equal ends are no edges; repeated ones count once; without edges there is no row.  Other columns are ignored."""
    few = 4 * edges.sparkSession.sparkContext.defaultParallelism
    used = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    now = common.written(_contracted(used.coalesce(few)).coalesce(few), "edges")
    while True:
        # done when every node hangs on one node that hangs on none
        ends = now.select("a", F.lit(1).alias("low"), F.lit(0).alias("high")).union(now.select(F.col("b").alias("a"), F.lit(0).alias("low"), F.lit(1).alias("high")))
        if not ends.groupBy("a").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or (low > 0 and high > 0)").take(1):
            break
        with common.scratch():
            now = common.keep(common.written(_contracted(_small_star(_large_star(now)).coalesce(few)), "edges"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
