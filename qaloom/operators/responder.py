"""The model boundary: prompts in, recorded replies out.  Nothing here calls a model or a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replay(prompts: DataFrame, recorded: DataFrame, prompt: str = "prompt", reply: str = "reply") -> DataFrame:
    """Joins replies by the prompt's digest; a prompt recorded more than once gets the least reply, an unknown one null."""
    known = recorded if "_h" in recorded.columns else known_replies(recorded, prompt, reply)
    return prompts.withColumn("_h", F.sha2(F.col(prompt), 256)).join(known.hint("merge"), "_h", "left").drop("_h")


def known_replies(recorded: DataFrame, prompt: str = "prompt", reply: str = "reply") -> DataFrame:
    """One reply a prompt's digest.  The join with them is a sorted one: how large replies are can't be estimated, and a broadcast would
    hold all of them on the driver."""
    return recorded.groupBy(F.sha2(F.col(prompt), 256).alias("_h")).agg(F.min(reply).alias(reply))


def first_success(attempts: DataFrame, key: list[str], attempt: str, ok: Column, most: int) -> DataFrame:
    """Bounded retries as rows: each key's first successful attempt among the first `most`; keys without one are absent."""
    rest = [c for c in attempts.columns if c not in key]
    good = attempts.where((F.col(attempt) <= most) & ok)
    return good.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(attempt)).alias("r")).select(*key, "r.*")


def hit_points(points: DataFrame, replies: DataFrame, key: list[str], hit: Column) -> DataFrame:
    """Cross-checks: a point goes if any other question's reply hits it.  Adds `removed` to points."""
    found = replies.groupBy(*key).agg(F.bool_or(hit).alias("removed"))
    return points.join(found, key, "left").withColumn("removed", F.coalesce("removed", F.lit(False)))


def all_agree(solutions: DataFrame, key: list[str], number: str, truth: str) -> DataFrame:
    """Several solvers' numbers: accepted if every one of them meets the truth."""
    return solutions.groupBy(*key).agg(F.bool_and(F.coalesce(F.abs(F.col(number) - F.col(truth)) < 1e-5, F.lit(False))).alias("accepted"), F.count(F.lit(1)).alias("n_solvers"))


#: Errors after which a call is worth another attempt.
RETRIED = ("rate_limit", "timeout", "connection", "server")


def with_retries(attempts: DataFrame, key: list[str], most: int = 6) -> DataFrame:
    """key, reply, error, n_attempts of recorded calls (key, attempt from 1, error, reply).

    The first attempt without an error worth a retry decides, with its reply or its error; if the first `most` all have
    one, the last of them stands as the error."""
    tried = attempts.where(F.col("attempt") <= most)
    decides = F.col("error").isNull() | ~F.col("error").isin(*RETRIED)
    row = F.struct("attempt", "error", "reply")
    got = tried.groupBy(*key).agg(F.min_by(row, F.when(decides, F.col("attempt"))).alias("_d"), F.max_by(row, "attempt").alias("_l"))
    x = F.coalesce("_d", "_l")
    return got.select(*key, F.when(x["error"].isNull(), x["reply"]).alias("reply"), x["error"].alias("error"), x["attempt"].alias("n_attempts"))


def granted_tokens(asked: Column, limit: Column, step: int = 2_000) -> Column:
    """The first of asked, asked - step, ... that a model takes (limit: the most it does, null: any); null if none above 0 does."""
    fewer = F.when(limit.isNull() | (asked <= limit), asked).otherwise(asked - step * F.ceil((asked - limit) / step))
    return F.when(fewer > 0, fewer.cast("long"))


def backed_off(reply: Column, asked: Column, limit: Column, step: int = 2_000) -> Column:
    """A reply, or "error" where no number of tokens is taken."""
    return F.when(granted_tokens(asked, limit, step).isNotNull(), reply).otherwise("error")


def all_passed(output: Column) -> Column:
    """Whether a recorded execution ended with its last line "All-Pass"."""
    return F.coalesce(F.substring_index(F.regexp_replace(output, r"\s+$", ""), "\n", -1) == "All-Pass", F.lit(False))


def running_accuracy(results: Column, failed: Column) -> Column:
    """Mean of 0/1 results over the rows that didn't fail; an aggregate."""
    return F.avg(F.when(~F.coalesce(failed, F.lit(False)), results.cast("double")))
