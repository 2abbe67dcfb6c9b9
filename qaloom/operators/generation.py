"""Generation with recorded replies: retried questions, problems that are extended step by step, checked code problems.

Each attempt or depth is a pass over all rows that are still open; the number of passes is an argument.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions import code as C
from qaloom.functions import responses as R
from qaloom.functions import sections as S
from qaloom.functions.keys import py_strip
from qaloom.functions.prompts import filled
from qaloom.functions.python_checks import numeric_grounding
from qaloom.operators.guards import RelationError
from qaloom.operators.relations import all_referenced
from qaloom.operators.responder import all_agree, all_passed, first_success, replay
from qaloom.tables import written


def regenerated(attempts: DataFrame, key: str, numeric: Column, most: int = 3) -> DataFrame:
    """key, attempt, question, answer, documents of the first of `most` recorded replies (key, attempt, reply) that parses in whole
    and, where `numeric` holds, whose calculation holds.  Keys without one are absent."""
    parsed = attempts.withColumn("x", R.qa_reply(F.col("reply"))).withColumn("g", numeric_grounding(F.col("reply")))
    whole = F.col("x.question").isNotNull() & F.col("x.answer").isNotNull() & F.col("x.documents").isNotNull()
    rows = parsed.withColumn("ok", whole & (~numeric | F.col("g.ok"))).select(key, "attempt", "ok", "x.*")
    return first_success(rows, [key], "attempt", F.col("ok"), most).drop("ok")


def naive(replies: DataFrame, key: str, reply: str = "reply") -> DataFrame:
    """key, documents, question, answer of replies that hold all three sections."""
    x = replies.select(key, S.sections(F.col(reply), S.NAIVE).alias("x")).select(key, "x.*")
    return x.where("documents is not null and question is not null and answer is not null")


def _plain(number: Column) -> Column:
    """A number as texts write it: without a fraction of nothing."""
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))


def extended(seeds: DataFrame, recorded: DataFrame, solved: DataFrame, key: str, most: int) -> DataFrame:
    """key, depth, context, question, answer of each seed problem (key, context, question, answer), extended as often as it goes.

    A step asks on from the answer.  Its reply must hold all sections, its reasoning the answer so far, and every recorded
    solution (solved: prompt, number) of the new problem its answer.  Known numbers are taken out of the new context.  recorded:
    prompt, reply."""
    state = written(seeds.select(key, F.lit(0).alias("depth"), "context", "question", F.col("answer").cast("double").alias("answer")), "depth")
    done = state.limit(0)
    for depth in range(1, most + 1):
        asked = state.withColumn("prompt", filled("math", "extend", context=F.col("context"), question=F.col("question"), answer=_plain(F.col("answer"))))
        got = replay(asked, recorded).withColumn("x", S.sections(F.col("reply"), S.EXTEND)).withColumn("number", S.plain_number(F.col("x.answer")))
        parts = [F.col(f"x.{n}") for n in ("previous_answer", "new_context", "new_question", "reasoning")]
        whole = F.col("number").isNotNull() & F.contains("x.reasoning", _plain(F.col("answer")))
        for p in parts:
            whole &= p.isNotNull()
        told = py_strip(S.numbers_removed(F.replace("x.new_context", F.col("x.new_question"), F.lit("")), F.array("answer")))
        new = got.where(whole).select(key, "context", told.alias("told"), F.col("x.previous_answer").alias("said"), F.col("x.new_question").alias("asked"), "number")
        new = written(new.withColumn("prompt", filled("math", "solve_plain", question=F.concat_ws(" ", "said", "told", "asked"))), "asked")
        agreed = all_agree(new.join(solved.withColumnRenamed("number", "theirs"), "prompt").select(key, "theirs", "number"), [key], "theirs", "number").where("accepted").select(key)
        step = new.join(agreed, key, "left_semi").select(key, F.lit(depth).alias("depth"), F.concat_ws(" ", "context", "said", "told").alias("context"), F.col("asked").alias("question"), F.col("number").alias("answer"))
        step = written(step, "depth")
        done = written(done.union(state.join(step, key, "left_anti")), "done")
        state = step
    return done.union(state)


def code_problems(replies: DataFrame, functions: DataFrame, tests: DataFrame, key: str, runs: int = 2) -> DataFrame:
    """key, function_name, reason of each recorded reply: null if the problem stands.

    functions: function_name, file_name of the prompt's helpers; tests: key, test, run, output, the recorded executions.  Reasons, in
    order: "unparsed"; "unknown_function" (it refers to a helper that isn't there); "signature" (the definition takes or returns
    another number of values than described); "test" (no assert on the result at the test's end, or a helper imported in
    it); "failed" (one of the `runs` executions didn't pass)."""
    parsed = written(replies.select(key, C.problem_in(F.col("reply")).alias("p")), "problems")
    named = F.flatten(F.transform("p.referenced", lambda r: F.transform(F.split(r["names"], ","), lambda n: F.struct(py_strip(n).alias("function_name"), F.concat(r["module"], F.lit(".py")).alias("file_name")))))
    known = all_referenced(parsed.select(key, named.alias("refs")), key, "refs", functions, ["function_name", "file_name"]).select(key, "missing")
    ran = tests.groupBy(key).agg(F.max("test").alias("test"), F.count_if(all_passed(F.col("output"))).alias("passed"))
    helpers = F.transform(named, lambda f: f["function_name"])
    rows = parsed.withColumn("helpers", helpers).join(known, key, "left").join(ran, key, "left")
    fair = F.coalesce(C.asserts_at_end(F.col("test")) & ~C.imports_helper(F.col("test"), F.col("helpers")), F.lit(False))
    reason = F.when(F.col("p.function_name").isNull(), "unparsed").when(F.coalesce("missing", F.lit(0)) > 0, "unknown_function").when(~C.signature_agrees(F.col("p.function_def"), F.col("p.statement")), "signature")
    reason = reason.when(~fair, "test").when(F.coalesce("passed", F.lit(0)) < runs, "failed")
    return rows.select(key, F.col("p.function_name").alias("function_name"), reason.alias("reason"))


def run_stages(stages: Sequence[tuple[str, Callable[[], object]]], first: str, last: str) -> dict[str, object]:
    """What the stages from `first` to `last` give, in their order."""
    names = [n for n, _ in stages]
    if first not in names or last not in names or names.index(first) > names.index(last):
        raise RelationError(f"no stages from {first} to {last} in {names}")
    return {n: f() for n, f in stages[names.index(first) : names.index(last) + 1]}


def batches_until(run: Callable[[int], DataFrame], passed: Callable[[DataFrame], int], target: int, most: int, done: dict[int, DataFrame] | None = None) -> list[tuple[int, int]]:
    """(batch, passed so far) of batches 1, 2, ... until the target is met or `most` have run.  Batches in `done` aren't run again."""
    out, total = [], 0
    for batch in range(1, most + 1):
        rows = (done or {}).get(batch)
        total += passed(run(batch) if rows is None else rows)
        out.append((batch, total))
        if total >= target:
            break
    return out
