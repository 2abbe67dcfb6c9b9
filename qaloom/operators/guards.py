"""Run-time checks of relations: they raise, or count what they find."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RelationError(ValueError):
    """A relation breaks its contract."""


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if lacking := [n for n in names if n not in df.columns]:
        raise RelationError(f"columns are lacking: {lacking}")
    return df


def without_scratch(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if not c.startswith("_")))


def require_same_columns(*frames: DataFrame) -> None:
    first = frames[0].columns
    for k, f in enumerate(frames[1:], 1):
        if f.columns != first:
            raise RelationError(f"relation {k} has columns {f.columns}, the first has {first}")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    if bad := duplicate_keys(df, key).take(1):
        raise RelationError(f"key {list(key)} repeats: {bad[0].asDict()}")
    return df


def require_no_nulls(df: DataFrame, names: Sequence[str]) -> DataFrame:
    counts = df.agg(*(F.count_if(F.col(n).isNull()).alias(n) for n in names)).first().asDict()
    if bad := {n: c for n, c in counts.items() if c}:
        raise RelationError(f"nulls in key columns: {bad}")
    return df


def outside_domain(df: DataFrame, name: str, allowed: Sequence[str]) -> DataFrame:
    """Values (null included) that are not allowed, with their counts."""
    return df.where(F.col(name).isNull() | ~F.col(name).isin(*allowed)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def require_domain(df: DataFrame, name: str, allowed: Sequence[str]) -> DataFrame:
    if bad := outside_domain(df, name, allowed).take(3):
        raise RelationError(f"{name} holds {[r[0] for r in bad]}")
    return df


def drop_header_rows(df: DataFrame, name: str) -> DataFrame:
    """An append log repeats its header; those rows hold the column's own name."""
    return df.where(F.col(name).isNull() | (F.col(name) != name))


def require(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """Every row must satisfy `holds`; the first that doesn't stops the job when it is read."""
    return df.withColumn("_ok", F.when(holds, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))).where("_ok").drop("_ok")


def with_support(df: DataFrame, key: Sequence[str], least: int) -> DataFrame:
    """Rows whose key has at least `least` rows; null keys count as a key."""
    enough = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    same = [df[k].eqNullSafe(enough[k]) for k in key]
    return df.join(enough, same, "left_semi")


def track_rows(df: DataFrame, track: str, seed_type: str = "Seed_Type") -> DataFrame:
    """Rows of a track and its dynamic form; "all" keeps every row.  A track without rows is an error."""
    kept = df if track == "all" else df.where(F.col(seed_type).isin(track, f"dynamic_{track}"))
    if not kept.take(1):
        raise RelationError(f"no row of track {track}")
    return kept


def require_same_count(left: DataFrame, right: DataFrame) -> int:
    a, b = left.count(), right.count()
    if a != b:
        raise RelationError(f"{a} rows against {b}")
    return a
