"""Preference formatting: one prompt, two completions.

Chosen and rejected conversations of a pair meet turn by turn; the first turn in which they differ
ends their longest common prefix.  The prefix is rendered once as the prompt, what follows it in
either is rendered as the pair's completions, and a mask says which characters to learn from: the
words of the assistant and the mark that ends them, in completions only.

Turns are the rows throughout.  A conversation is never gathered in one place: its prefix is a
minimum over turns, and a turn's place in the rendered text is a running sum over blocks of turns and
within one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from qaloom.llm import common

# Fixed values of the public ChatML layout.
OPEN, END, CLOSE = "<|im_start|>", "<|im_end|>", "\n"
#: Turns a block of the running sums.
BLOCK = 1_024


def _turns(rows: DataFrame, name: str) -> DataFrame:
    """pair, turn, nth, `name` (role, text): equal rows of a turn once; different ones of one turn in order of role and text."""
    own = rows.select("pair_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("pair_id is not null and turn is not null").distinct()
    nth = F.row_number().over(Window.partitionBy("pair_id", "turn").orderBy("role", "text"))
    return own.withColumn("nth", nth).select("pair_id", "turn", "nth", F.struct("role", "text").alias(name))


def _head(m: Column) -> Column:
    return F.concat(F.lit(OPEN), m["role"], F.lit("\n"))


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both: pair_id, turn, role, text.  Returns a row a rendered turn: pair_id, part, turn, nth, role, rendered, start,
    loss_start, loss_end.

    part: "prompt" (common turns, once), "chosen" or "rejected".  start: characters of the same part before it, so a part
    is its rows' texts by start.  loss_start, loss_end: the characters of the part to learn from; equal if there are none.
    Pairs that only one side has, or of equal conversations, have no common end: the first keep one completion, the
    latter only a prompt.  Rows without a pair_id or turn are of no conversation; a null role or text is empty.
    """
    both = _turns(chosen, "c").join(_turns(rejected, "r"), ["pair_id", "turn", "nth"], "full")
    both = common.written(both, "turns")
    at = F.struct("turn", "nth")
    differ = both.where(~F.col("c").eqNullSafe(F.col("r"))).groupBy("pair_id").agg(F.min(at).alias("first"))
    split = both.join(differ, "pair_id", "left")
    common_turn = F.col("first").isNull() | (at < F.col("first"))
    part = lambda name, m: F.struct(F.lit(name).alias("part"), m.alias("m"))
    parts = F.when(common_turn, F.array(part("prompt", F.col("c")))).otherwise(F.filter(F.array(part("chosen", F.col("c")), part("rejected", F.col("r"))), lambda x: x["m"].isNotNull()))
    rows = split.select("pair_id", "turn", "nth", F.explode(parts).alias("p")).select("pair_id", "turn", "nth", "p.part", "p.m")
    rows = rows.withColumn("rendered", F.concat(_head(F.col("m")), F.col("m.text"), F.lit(END + CLOSE))).withColumn("size", F.length("rendered").cast("long"))
    rows = common.written(rows.withColumn("block", F.floor(F.col("turn") / BLOCK)), "segments")
    before = Window.partitionBy("pair_id", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("pair_id", "part", "block").agg(F.sum("size").alias("size")).select("pair_id", "part", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("pair_id", "part", "block").orderBy("turn", "nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(base, ["pair_id", "part", "block"]).withColumn("start", F.col("base") + F.col("inner"))
    learn = (F.col("part") != "prompt") & (F.col("m.role") == "assistant")
    text_at = F.col("start") + F.length(_head(F.col("m")))
    text_end = F.col("start") + F.col("size") - len(CLOSE)
    return placed.select(
        "pair_id", "part", "turn", "nth", "m.role", "rendered", "start",
        F.when(learn, text_at).otherwise(F.col("start")).alias("loss_start"), F.when(learn, text_end).otherwise(F.col("start")).alias("loss_end"),
    )


def cut_reply_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected of a table without preferences: each conversation up to its last reply, and the same with
    that reply broken off halfway.  Conversations without a reply make no pair."""
    own = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = own.where("role = 'assistant' and pair_id is not null").groupBy("pair_id").agg(F.max("turn").alias("last"))
    chosen = own.join(last, "pair_id").where("turn <= last")
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    cut = F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), half).otherwise(F.col("text"))
    return chosen.drop("last"), chosen.withColumn("text", cut).drop("last")


def preference_query(conversations: DataFrame) -> DataFrame:
    return preference_segments(*cut_reply_pairs(conversations))


PREFERENCE_SQL = """
WITH own AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (SELECT pair_id, max(turn) AS last FROM own WHERE role = 'assistant' GROUP BY pair_id),
c0 AS (SELECT o.*, last FROM own o JOIN last USING (pair_id) WHERE turn <= last),
r0 AS (SELECT pair_id, turn, role, CASE WHEN turn = last AND role = 'assistant' THEN substr(text, 1, CAST(floor(length(text) / 2) AS BIGINT)) ELSE text END AS text FROM c0),
c AS (SELECT *, row_number() OVER (PARTITION BY pair_id, turn ORDER BY role, text) AS nth FROM (SELECT DISTINCT pair_id, turn, role, text FROM c0)),
r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, turn ORDER BY role, text) AS nth FROM (SELECT DISTINCT pair_id, turn, role, text FROM r0)),
j AS (SELECT pair_id, turn, nth, c.role AS cr, c.text AS ct, r.role AS rr, r.text AS rt FROM c FULL JOIN r USING (pair_id, turn, nth)),
d AS (SELECT pair_id, min(turn * 1000000 + nth) AS f FROM j WHERE cr IS DISTINCT FROM rr OR ct IS DISTINCT FROM rt GROUP BY pair_id),
s AS (SELECT j.*, f IS NULL OR turn * 1000000 + nth < f AS shared FROM j LEFT JOIN d USING (pair_id)),
p AS (SELECT pair_id, turn, nth, 'prompt' AS part, cr AS role, ct AS text FROM s WHERE shared
      UNION ALL SELECT pair_id, turn, nth, 'chosen', cr, ct FROM s WHERE NOT shared AND cr IS NOT NULL
      UNION ALL SELECT pair_id, turn, nth, 'rejected', rr, rt FROM s WHERE NOT shared AND rr IS NOT NULL),
w AS (SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered FROM p),
o AS (SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM w)
SELECT pair_id, part, turn, nth, role, rendered, start,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + 13 + length(role) ELSE start END AS loss_start,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(rendered) - 1 ELSE start END AS loss_end
FROM o
"""
