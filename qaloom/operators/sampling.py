"""Samples drawn by hash, so any engine and any order of rows draws alike; allocation; blinding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qaloom.operators.guards import RelationError
from qaloom.operators.relations import positions
from qaloom.tables import written


def draw(key: str, seed: int) -> Column:
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def stratified(rows: DataFrame, stratum: str, key: str, size: int, seed: int) -> DataFrame:
    """`size` rows of each stratum (all, if fewer) with their place nth in the draw.  Spark keeps the first `size` of each
    task before the exchange, so large strata don't travel."""
    nth = F.row_number().over(W.partitionBy(stratum).orderBy(draw(key, seed)))
    return rows.withColumn("nth", nth).where(F.col("nth") <= size)


def require_sample(rows: DataFrame, stratum: str, wanted: dict[str, int]) -> None:
    have = {r[0]: r[1] for r in rows.where(F.col(stratum).isin([*wanted])).groupBy(stratum).count().collect()}
    if short := {s: have.get(s, 0) for s, n in wanted.items() if have.get(s, 0) < n}:
        raise RelationError(f"strata too small: {short}, wanted {wanted}")


def largest_remainder(counts: DataFrame, wanted: int, stratum: str = "stratum", n: str = "n") -> DataFrame:
    """allocated: `wanted` places in proportion to n; floors first, then the largest remainders, ties by stratum.

    counts: a row a stratum; they are ranked in one window, so strata must be few beside rows, as places to draw are."""
    all_ = W.partitionBy()
    exact = F.lit(float(wanted)) * F.col(n) / F.sum(n).over(all_)
    shared = counts.withColumn("_e", exact).withColumn("_b", F.floor("_e"))
    left = F.lit(wanted) - F.sum("_b").over(all_)
    r = F.row_number().over(W.orderBy(F.round(F.col("_e") - F.col("_b"), 9).desc(), stratum))
    return shared.withColumn("_l", left).withColumn("_r", r).withColumn("allocated", F.col("_b") + F.when(F.col("_r") <= F.col("_l"), 1).otherwise(0)).drop("_e", "_b", "_l", "_r")


def proportional(rows: DataFrame, allocation: DataFrame, stratum: str, key: str, seed: int) -> DataFrame:
    most = allocation.agg(F.max("allocated")).first()[0] or 0
    drawn = stratified(rows, stratum, key, most, seed)
    return drawn.join(F.broadcast(allocation.select(stratum, "allocated")), stratum).where("nth <= allocated")


def item_ids(sample: DataFrame, key: str, seed: int) -> DataFrame:
    """Shuffled and numbered I001...; a thousand and more have as many digits as they need."""
    placed = positions(sample.withColumn("_draw", draw(key, seed)), ["_draw"], "_pos")
    number = (F.col("_pos") + 1).cast("string")
    return placed.withColumn("Item_ID", F.concat(F.lit("I"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0")))).drop("_draw", "_pos")


def blinded(rows: DataFrame, shown: Sequence[str]) -> DataFrame:
    return rows.select(*shown)


def reallocated(types: DataFrame, threshold: float, shift: float, floor: float) -> DataFrame:
    """types: t, acc, w (a few rows).  Types at the threshold shed up to `shift`, never below `floor`, to the weakest of
    the others; nothing moves if all or none are saturated."""
    sat = F.col("acc") >= threshold
    all_ = W.partitionBy()
    shed = F.when(sat, F.least(F.lit(shift), F.greatest(F.lit(0.0), F.col("w") - floor))).otherwise(0.0)
    marked = types.withColumn("_shed", shed)
    moves = F.bool_or(sat).over(all_) & ~F.bool_and(sat).over(all_)
    recipient = F.min_by("t", F.when(~sat, F.struct("acc", "t"))).over(all_)
    total = F.sum("_shed").over(all_)
    return marked.withColumn("w", F.when(moves, F.col("w") - F.col("_shed") + F.when(F.col("t") == recipient, total).otherwise(0.0)).otherwise(F.col("w"))).drop("_shed")


def allocation_rounds(types: DataFrame, threshold: float, shift: float, floor: float, rounds: int) -> DataFrame:
    """round (from 0), t, acc, w: the rule applied again and again to a few types whose accuracy stays."""
    now = written(types.select("t", "acc", "w"), "weights")
    out = now.select(F.lit(0).alias("round"), "t", "acc", "w")
    for r in range(1, rounds + 1):
        now = written(reallocated(now, threshold, shift, floor).select("t", "acc", "w"), "weights")
        out = out.union(now.select(F.lit(r), "t", "acc", "w"))
    return out


def exemplars(scenarios: DataFrame, clauses: DataFrame, key: str, wanted: int, seed: int) -> DataFrame:
    """`wanted` drawn scenarios as three marked lines each.  Generic ones have the area GENERIC, others that whose clause is their
    Reg_Text (the least id, if several); scenarios without an area are passed over.

    scenarios: key, Persona, Environment, Reg_Text, Seed_Type; clauses: id, clause."""
    areas = clauses.where(F.trim("clause") != "").groupBy(F.trim("clause").alias("_c")).agg(F.min("id").alias("_id"))
    known = scenarios.join(areas, F.trim("Reg_Text") == F.col("_c"), "left")
    area = F.when(F.col("Seed_Type").isin("generic", "dynamic_generic"), "GENERIC").otherwise(F.col("_id"))
    drawn = known.withColumn("Area", area).where("Area is not null").orderBy(draw(key, seed)).limit(wanted)
    text = F.concat(F.lit("USER_PERSONA: "), F.col("Persona"), F.lit("\nCOLLECTION_OF_DOCS: "), F.col("Environment"), F.lit("\nREGULATORY_AREA_ID: "), F.col("Area"))
    return drawn.select(key, text.alias("exemplar"))


#: Most names that a round of context_draws deals to its problems.
ROUND_NAMES = 1 << 16


def context_draws(prompts: DataFrame, pool: DataFrame, similar: DataFrame | Callable[[DataFrame], DataFrame], each: int, seed: int) -> DataFrame:
    """problem, nth, name: for every prompt function (problem, nth from 0) the next `each` functions of the pool in the order of the
    draw, none twice, none that is similar to a prompt function of the problem.

    pool: name and any columns that tell likeness; similar: problem, name, or what takes rows (problem and the pool's columns) and
    leaves those that are not similar.  Problems look at the drawn functions round by round, twice as many each time, until they
    have theirs, so only pairs that are drawn are looked at.  Where fewer than `each` are left, every later function gets those."""
    places = written(positions(pool.withColumn("_d", F.sha1(F.concat_ws("|", F.lit(str(seed)), "name"))), ["_d", "name"], "_p").drop("_d"), "places")
    size = places.count()
    unlike = similar if callable(similar) else lambda seen: seen.join(similar, ["problem", "name"], "left_anti")
    still = written(prompts.groupBy("problem").agg((F.count(F.lit(1)) * each).alias("_want")).withColumn("_have", F.lit(0).cast("long")), "problems")
    order = W.partitionBy("problem").orderBy("_p")
    at, width, parts = 0, 2 * (still.agg(F.max("_want")).first()[0] or 0), []
    while at < size and still.take(1):
        width = min(width, ROUND_NAMES)
        seen = still.crossJoin(F.broadcast(places.where(F.col("_p").between(at, at + width - 1))))
        ranked = unlike(seen).withColumn("_r", F.col("_have") + F.row_number().over(order) - 1).where("_r < _want")
        parts.append(written(ranked.select("problem", "name", "_r"), "drawn"))
        more = parts[-1].groupBy("problem").agg(F.count(F.lit(1)).alias("_n"))
        had = still.join(more.hint("merge"), "problem", "left").withColumn("_have", F.col("_have") + F.coalesce("_n", F.lit(0))).drop("_n")
        still = written(had.where("_have < _want"), "problems")
        at, width = at + width, width * 2
    if not parts:
        return prompts.join(places.select("name"), F.lit(False)).select("problem", "nth", "name")
    drawn = parts[0]
    for p in parts[1:]:
        drawn = drawn.union(p)
    full = drawn.groupBy("problem").agg(F.floor((F.max("_r") + 1) / each).cast("long").alias("_full"))
    asked = prompts.join(full.hint("merge"), "problem").withColumn("_slot", F.least(F.col("nth").cast("long"), F.col("_full")))
    return asked.join(drawn.withColumn("_slot", F.floor(F.col("_r") / each).cast("long")).select("problem", "name", "_slot").hint("merge"), ["problem", "_slot"]).select("problem", "nth", "name")
