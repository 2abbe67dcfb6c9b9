"""Joins, set operations and windows of corpus relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qaloom.operators.guards import RelationError, drop_header_rows, require, require_same_columns, require_same_count, require_unique
from qaloom.tables import written


def join_one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", lose_none: bool = False) -> DataFrame:
    """A join whose keys must be unique on both sides; lose_none: every left row must find its partner."""
    require_unique(left, on)
    require_unique(right, on)
    if lose_none and (lost := left.join(right, list(on), "left_anti").take(1)):
        raise RelationError(f"no partner for {lost[0].asDict()}")
    return left.join(right, list(on), how)


def join_or_default(left: DataFrame, right: DataFrame, on: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """A left join in which what is missing takes the given values."""
    return left.join(right, list(on), "left").fillna(defaults)


def anti_both_ways(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of one side only; side says which."""
    a = left.select(*on).distinct().join(right, list(on), "left_anti").withColumn("side", F.lit("left"))
    return a.unionByName(right.select(*on).distinct().join(left, list(on), "left_anti").withColumn("side", F.lit("right")))


def positions(df: DataFrame, order: Sequence[str], name: str = "row_idx") -> DataFrame:
    """Gapless positions from 0 in the order of unique `order` columns, without one task that sees all rows: ranges are
    numbered apart and their counts are added up (a row a range comes to the driver and goes back as a table).  The ranges
    are written, as drawing them again would move their bounds."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = sorted((r[0], r[1]) for r in ranged.groupBy("_part").count().collect())
    before = [(p, sum(n for _, n in counts[:k])) for k, (p, _) in enumerate(counts)]
    base = spark.createDataFrame(before, "_part int, _base long")
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_n", local).join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_n")).drop("_part", "_base", "_n")


def positional_join(left: DataFrame, right: DataFrame, text_left: str, text_right: str, by: str = "row_idx", strict: bool = False) -> DataFrame:
    """Rows at equal positions; `aligned` says whether their texts agree as well.  strict: both sides must have as many rows, and
    a row whose texts differ stops the job."""
    out = left.join(right, by).withColumn("aligned", F.col(text_left).eqNullSafe(F.col(text_right)))
    if strict:
        require_same_count(left, right)
        out = require(out, F.col("aligned"), "texts differ at a position")
    return out


def unambiguous_lookup(rows: DataFrame, table: DataFrame, on: str, value: str) -> DataFrame:
    """Looks `value` up by a text that is no key: texts with more than one value find nothing."""
    sure = table.groupBy(on).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")
    return rows.join(sure, on, "left")


def first_of(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """DISTINCT ON: the first row of each key in the given order, as an aggregate (so hot keys are combined early)."""
    rest = [c for c in df.columns if c not in key]
    ordered = F.struct(*order) if len(order) > 1 else F.col(order[0]) if isinstance(order[0], str) else order[0]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), ordered).alias("r")).select(*key, "r.*")


def last_of(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    ordered = F.struct(*order) if len(order) > 1 else F.col(order[0]) if isinstance(order[0], str) else order[0]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), ordered).alias("r")).select(*key, "r.*")


def union_checked(*frames: DataFrame) -> DataFrame:
    """UNION ALL of relations with equal column lists."""
    require_same_columns(*frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def except_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (with multiplicity) of one side only."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether a written relation reads back as it was."""
    return left.columns == right.columns and not except_both(left, right).take(1)


def shard_round_robin(df: DataFrame, shards: int, position: str = "row_idx") -> DataFrame:
    return df.withColumn("shard", F.pmod(F.col(position), F.lit(shards)).cast("int"))


def shard_contiguous(df: DataFrame, shards: int, total: int, position: str = "row_idx") -> DataFrame:
    """Balanced runs of positions: the first total % shards of them are one longer, as ntile does."""
    size, more = divmod(total, shards)
    p, edge = F.col(position), more * (size + 1)
    shard = F.when(p < edge, F.floor(p / F.lit(size + 1))).otherwise(more + F.floor((p - edge) / F.lit(max(size, 1))))
    return df.withColumn("shard", shard.cast("int"))


def merge_renumber(shards: DataFrame, roots: DataFrame, mode: str = "perroot") -> DataFrame:
    """Merged shards with dense new roots in the original order, and questions numbered anew.

    shards: shard, Root_ID (restarts in each shard), Question_No, key; roots: key, original (unknown keys sort last).
    mode: "global", "perroot" or "keep".  Roots number as many as questions at most; their ranking is over roots alone.
    """
    known = shards.join(roots, "key", "left").withColumn("original", F.coalesce("original", F.lit(10**9)))
    per = known.groupBy("shard", "Root_ID").agg(F.min("original").alias("original"))
    new = positions(per, ["original", "shard", "Root_ID"], "pos").select("shard", "Root_ID", (F.col("pos") + 1).alias("New_Root"))
    merged = known.join(new, ["shard", "Root_ID"])
    if mode == "perroot":
        return merged.withColumn("New_Question", F.row_number().over(W.partitionBy("New_Root").orderBy("Question_No")).cast("long"))
    if mode == "global":
        return positions(merged, ["New_Root", "Question_No"], "New_Question").withColumn("New_Question", F.col("New_Question") + 1)
    return merged.withColumn("New_Question", F.col("Question_No").cast("long"))


def pending(work: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Resume: what is not done yet."""
    return work.join(done.select(*key).distinct(), list(key), "left_anti")


def remapped(rows: DataFrame, table: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Rows with the value that a table gives their key; a key that it lacks stops the job."""
    return require(rows.join(table.select(*on, value), list(on), "left"), F.col(value).isNotNull(), f"a key without {value}")


def matched_and_not(rows: DataFrame, table: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(joined rows, rows that the table lacks)."""
    return rows.join(table, list(on)), rows.join(table, list(on), "left_anti")


def first_match(rows: DataFrame, table: DataFrame, on: Sequence[str], order: str, value: str) -> DataFrame:
    """Looks a value up by a key that may repeat: the first by order counts; a key that the table lacks stops the job."""
    first = table.groupBy(*on).agg(F.min_by(F.struct(value), order).alias("_v"))
    found = require(rows.join(first, list(on), "left"), F.col("_v").isNotNull(), "a key without a match")
    return found.withColumn(value, F.col("_v")[value]).drop("_v")


def all_referenced(rows: DataFrame, key: str, referenced: str, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """key, found (known rows), missing: of each row's array of structs `referenced`; rows without references have none missing."""
    each = rows.select(key, F.explode_outer(referenced).alias("r")).select(key, "r.*", F.col("r").isNotNull().alias("_some"))
    hit = each.join(known.select(*on).distinct().withColumn("_hit", F.lit(True)), list(on), "left")
    return hit.groupBy(key).agg(F.count_if(F.col("_hit")).alias("found"), F.count_if(F.col("_some") & F.col("_hit").isNull()).alias("missing"))


def disagreements(left: DataFrame, right: DataFrame, on: Sequence[str], column: str) -> DataFrame:
    """Rows on which two relations disagree about a column: both values."""
    both = left.select(*on, F.col(column).alias(f"{column}_left")).join(right.select(*on, F.col(column).alias(f"{column}_right")), list(on))
    return both.where(~F.col(f"{column}_left").eqNullSafe(F.col(f"{column}_right")))


def conflicts(rows: DataFrame, key: Sequence[str], order: str, value: Column) -> DataFrame:
    """key, n, first, last, conflicting: what keeping the last instead of the first row of a key would change."""
    got = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.min(value).alias("_a"), F.max(value).alias("_b"))
    return got.withColumn("conflicting", F.col("_a") != F.col("_b")).drop("_a", "_b")


def conflict_rows(rows: DataFrame, key: Sequence[str], value: Column, most: int) -> DataFrame:
    """All rows of the first `most` keys, in order, that hold different values: a report for people."""
    bad = rows.groupBy(*key).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).where("_a <> _b").orderBy(*key).limit(most)
    return rows.join(F.broadcast(bad.select(*key)), list(key), "left_semi")


def merged_judgments(shards: Sequence[DataFrame], corpus: DataFrame, key: Sequence[str], vote: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(judgments, corpus questions without any): headers within the logs go, of repeated votes the last stays.  Judgments of
    questions that the corpus lacks are an error."""
    every = drop_header_rows(union_checked(*shards), key[0])
    kept = last_of(every, vote, [order])
    if orphan := kept.join(corpus, list(key), "left_anti").take(1):
        raise RelationError(f"judgments of a question that the corpus lacks: {orphan[0].asDict()}")
    return kept, corpus.select(*key).distinct().join(kept, list(key), "left_anti")


def merged_shards(frames: dict[int, DataFrame | None], started: set[int], strict: bool = True) -> DataFrame:
    """Shards' rows with their shard's number; None is a shard without output.  One that never started is left out; one that
    started and has none is an error where strict."""
    if strict and (lost := sorted(s for s, f in frames.items() if f is None and s in started)):
        raise RelationError(f"shards without output: {lost}")
    there = [f.withColumn("shard", F.lit(s)) for s, f in sorted(frames.items()) if f is not None]
    if not there:
        raise RelationError("no shard has output")
    return union_checked(*there)


def emitted(rows: DataFrame, seeds: DataFrame, on: Sequence[str], scope: str = "all") -> DataFrame:
    """All rows, or (scope "new") those that are no seeds."""
    return rows if scope == "all" else rows.join(seeds, list(on), "left_anti")


def stage_counts(stages: dict[str, dict[str, DataFrame | None]]) -> tuple[DataFrame, list[str]]:
    """(stage, n, shards) of every stage's shards that are there, and the names of those that are lacking."""
    there = [f.select(F.lit(stage).alias("stage"), F.lit(name).alias("shard")) for stage, shards in stages.items() for name, f in shards.items() if f is not None]
    lacking = [f"{stage}/{name}" for stage, shards in stages.items() for name, f in shards.items() if f is None]
    if not there:
        raise RelationError("no stage has output")
    return union_checked(*there).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shard").alias("shards")), lacking


def cumulative_until(counts: DataFrame, order: str, value: str, target: int) -> DataFrame:
    """Batches up to and including the one whose running total reaches the target.  A row a batch."""
    upto = F.sum(value).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return counts.withColumn("running", upto).where(F.col("running") - F.col(value) < target)
