"""Generation passes over recorded replies that are made of the driver's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaloom.functions.prompts import TEMPLATES, filled
from qaloom.operators import generation as G
from qaloom.plans.code_domain import parts
from qaloom.plans.registry import query
from qaloom.plans.replies import K, cat, customers
from qaloom.tables import load

_C = "c AS (SELECT c_custkey AS k, c_name AS name FROM customer)"


@query(f"""WITH {_C}, a AS (SELECT k, unnest([1, 2, 3, 4]) AS a FROM c), ok AS (SELECT k, a FROM a WHERE a <= 3 AND (k + a) % 4 <> 0 AND (k % 2 = 0 OR a = 2 OR a = 3 AND k % 3 = 0)) SELECT k, CAST(min(a) AS INTEGER) AS attempt, 'q' || min(a) || ' ' || k AS question FROM ok GROUP BY k""")
def regenerated_questions(spark, sf_dir):
    """Four recorded attempts, of which three count: malformed at (k + attempt) % 4 = 0; where figures matter (odd k) the second
    attempt's calculation holds, and the third's at k % 3 = 0."""
    a = F.col("attempt")
    holds = (a == 2) | ((a == 3) & (K() % 3 == 0))
    sums = cat("Calculation:\nStep 1: a = ", K(), " + 1 = ", K() + 1, "\nStep 2: b = ", K() + 1, " * 2 = ", 2 * K() + 2, "\nStep 3: c = 2 * 3 = ", F.when(holds, 6).otherwise(7), "\n")
    reply = F.concat(sums, cat("Question: q", a, " ", K(), "\nAnswer: - x\n"), F.when((K() + a) % 4 == 0, "Document 1: no title").otherwise("Document 1 Title: T\n- x"))
    attempts = customers(spark, sf_dir).select("k", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("attempt")).withColumn("reply", reply)
    return G.regenerated(attempts, "k", K() % 2 == 1).select("k", "attempt", "question")


@query(f"""WITH {_C} SELECT k, 'd ' || name AS documents, 'q' || k AS question, 'a' AS answer FROM c WHERE k % 5 <> 0""")
def naive_generation(spark, sf_dir):
    reply = cat("Documents: d ", F.col("name"), "\n**Question:** <q", K(), ">\n", F.when(K() % 5 == 0, "").otherwise("Answer: a"))
    return G.naive(customers(spark, sf_dir).select("k", reply.alias("reply")), "k")


_S = "s AS (SELECT s_suppkey AS k FROM supplier)"


@query(f"""WITH {_S}, d AS (SELECT k, CASE WHEN k % 7 = 0 THEN 0 WHEN k % 5 = 0 THEN 1 WHEN k % 3 = 0 THEN 2 ELSE 3 END AS depth FROM s) SELECT k, CAST(depth AS INTEGER) AS depth, CASE depth WHEN 0 THEN 'q0' ELSE 'how many at ' || depth END AS question, CAST(k + depth AS DOUBLE) AS answer,
 'start' || CASE WHEN depth >= 1 THEN ' it is ' || k || ' some more than of step a' ELSE '' END || CASE WHEN depth >= 2 THEN ' it is ' || (k + 1) || ' some more than of step b' ELSE '' END || CASE WHEN depth >= 3 THEN ' it is ' || (k + 2) || ' some more than of step c' ELSE '' END AS context FROM d""")
def problem_extension(spark, sf_dir):
    """Problems extended three times at most: the first step's reply breaks off (k % 7 = 0), the second step's solvers disagree (k % 5 = 0),
    the third step's reasoning forgets the answer (k % 3 = 0)."""
    k = F.col("k")
    seeds = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).select("k", F.lit("start").alias("context"), F.lit("q0").alias("question"), k.cast("double").alias("answer"))
    recorded, solved = None, None
    context, question = F.lit("start"), F.lit("q0")
    for d in (1, 2, 3):
        now, step = k + d - 1, "abc"[d - 1]
        asked = filled("math", "extend", context=context, question=question, answer=now.cast("string"))
        reasoning = F.when((F.lit(d) == 3) & (k % 3 == 0), "from before").otherwise(cat("from ", now, " on"))
        body = cat("Original context: x\nQuestion statement: y\nOriginal answer statement: it is ", now, "\nNew operation over original answer: add\nNew context: ", cat("some more than ", now, f" of step {step}"), "\nNew question statement: how many at ", F.lit(d), "\nNew answer reasoning: ", reasoning)
        reply = F.when((F.lit(d) == 1) & (k % 7 == 0), body).otherwise(cat(body, "\nNew answer: ", now + 1))
        solve = filled("math", "solve_plain", question=cat("it is ", now, " ", f"some more than  of step {step} how many at ", F.lit(d)))
        off = F.when((F.lit(d) == 2) & (k % 5 == 0), 0.5).otherwise(0.0)
        one, two = seeds.select(asked.alias("prompt"), reply.alias("reply")), seeds.select(solve.alias("prompt"), F.explode(F.array((now + 1).cast("double"), now + 1 + off)).alias("number"))
        recorded, solved = (one, two) if recorded is None else (recorded.union(one), solved.union(two))
        context, question = F.concat_ws(" ", context, cat("it is ", now), F.lit(f"some more than  of step {step}")), cat("how many at ", F.lit(d))
    got = G.extended(seeds, recorded, solved, "k", 3)
    return got.select("k", "depth", "question", "answer", F.regexp_replace("context", " +", " ").alias("context"))


@query("""WITH p AS (SELECT p_partkey AS k FROM part) SELECT k, CASE WHEN k % 11 = 0 THEN NULL ELSE 'main' || k END AS function_name, CASE WHEN k % 11 = 0 THEN 'unparsed' WHEN k % 7 = 0 THEN 'unknown_function' WHEN k % 5 = 0 THEN 'signature' WHEN k % 3 = 0 THEN 'test' WHEN k % 2 = 0 THEN 'failed' END AS reason FROM p""")
def code_pipeline(spark, sf_dir):
    """Generated code problems with their recorded tests and executions, some failing at each check."""
    helper = F.when(K() % 7 == 0, "nowhere").otherwise("help")
    reply = cat("Parameters:\n- a: one\nObjectives:\n- aim\nReturn Values:\n- r: out\n\nFunction main", K(), " in main.py:\n\nfrom helpers import ", helper, ", more\n", F.when(K() % 11 == 0, "no definition").otherwise(cat("def main", K(), "(a", F.when(K() % 5 == 0, ", b").otherwise(""), "):\n    r = help(a)\n    return r")))
    test = F.when(K() % 6 == 0, "from helpers import help\nassert r == 2").when(K() % 3 == 0, "assert r is not None").otherwise("from main import main\nr = main(1)\nassert r == 2")
    p = parts(spark, sf_dir)
    runs = p.select("k", test.alias("test"), F.explode(F.array(F.lit(1), F.lit(2))).alias("run")).withColumn("output", F.when((K() % 2 == 0) & (F.col("run") == 2), "All-Pass\nError:\nx").otherwise("All-Pass"))
    functions = spark.createDataFrame([("help", "helpers.py"), ("more", "helpers.py"), ("help", "other.py")], "function_name string, file_name string")
    return G.code_problems(p.select("k", reply.alias("reply")), functions, runs, "k")


def _quoted(name: str) -> str:
    return TEMPLATES["solve"][name].replace("'", "''")


_FILLED = " UNION ALL ".join(f"SELECT item_id, '{name}' AS name, md5(replace(replace('{_quoted(name)}', '{{docs}}', text), '{{question}}', 'q' || item_id)) AS prompt FROM benchmark" for name in TEMPLATES["solve"])


@query(_FILLED)
def solver_prompts(spark, sf_dir):
    """The solvers' prompts over every text."""
    b = load(spark, sf_dir, "benchmark")
    each = [F.struct(F.lit(name).alias("name"), F.md5(filled("solve", name, docs=F.col("text"), question=cat("q", F.col("item_id")))).alias("prompt")) for name in TEMPLATES["solve"]]
    return b.select("item_id", F.explode(F.array(*each)).alias("x")).select("item_id", "x.*")
