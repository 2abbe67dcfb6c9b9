"""Validated joins, merges of shards, duplicate reports, rates by bucket: what stands between the stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaloom.functions import text as X
from qaloom.functions.keys import qid, qid_or
from qaloom.operators import guards as G
from qaloom.operators import panel
from qaloom.operators import relations as R
from qaloom.operators.responder import running_accuracy
from qaloom.plans.derived import votes
from qaloom.plans.panels import WITH
from qaloom.plans.registry import query
from qaloom.tables import load


@query("SELECT doc_id, lang, source, quality, toxic FROM labels JOIN documents USING (doc_id)")
def join_validated(spark, sf_dir):
    """Labels and documents one to one, no label lost."""
    return R.join_one_to_one(load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["doc_id"], lose_none=True)


@query("SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def remap_join(spark, sf_dir):
    """Every nation's region; a key without one would stop the job."""
    return R.remapped(load(spark, sf_dir, "nation"), load(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"], "r_name").select("n_nationkey", "n_name", "n_regionkey", "r_name")


@query("SELECT o_orderkey, o_custkey % 3 <> 0 AS matched FROM orders")
def judge_input_join(spark, sf_dir):
    """Orders with and without an entry in a table that lacks a third of the keys."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    table = load(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    hit, missed = R.matched_and_not(o, table, ["o_custkey"])
    return hit.select("o_orderkey", F.lit(True).alias("matched")).union(missed.select("o_orderkey", F.lit(False)))


@query("SELECT l_orderkey AS k, arg_min(l_partkey, (l_linenumber, l_partkey)) AS part FROM lineitem GROUP BY l_orderkey")
def first_match(spark, sf_dir):
    """The first line of every order that has lines."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_partkey").alias("at"), F.col("l_partkey").alias("part"))
    return R.first_match(li.select("k").distinct(), li, ["k"], "at", "part")


@query("SELECT o_orderkey AS k, o_orderstatus AS status_left, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS status_right FROM orders WHERE o_orderkey % 9 = 0")
def seed_type_disagreements(spark, sf_dir):
    """Rows on which two relations disagree."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    return R.disagreements(o, o.withColumn("status", F.when(F.col("k") % 9 == 0, "X").otherwise(F.col("status"))), ["k"], "status")


_PTS = "len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\\s\\x{a0}]+', '', 'g') <> ''))"


@query(f"""SELECT source, count(*) AS n, CAST(sum(pre - post) AS BIGINT) AS lost, count(*) FILTER (pre > post) AS losing FROM (SELECT source, {_PTS} AS pre, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\\s\\x{{a0}}]+', '', 'g') <> '' AND length(x) <= 80)) AS post FROM documents) GROUP BY source""")
def lost_points(spark, sf_dir):
    """Points before and after a stage that drops long lines, joined by key."""
    d = load(spark, sf_dir, "documents")
    post = F.array_join(F.filter(X.lines(F.col("text")), lambda t: F.length(t) <= 80), "\n")
    count = lambda c: F.size(X.bullet_points(c))
    both = R.join_one_to_one(d.select("doc_id", "source", count(F.col("text")).alias("pre")), d.select("doc_id", count(post).alias("post")), ["doc_id"], lose_none=True)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pre") - F.col("post")).alias("lost"), F.count_if(F.col("pre") > F.col("post")).alias("losing"))


@query(WITH + """, u AS (SELECT QA_Type, Batch, Root_ID, count(*) FILTER (Verdict = 'Yes') / count(*) AS pf, count(*) FILTER (Verdict = 'Unsure') / count(*) AS nm FROM votes WHERE Judge = 'j1' GROUP BY ALL), s AS (SELECT *, CASE WHEN nm > 0.34 THEN 'DISAGREE' WHEN pf >= 0.75 THEN 'PASS' ELSE 'FAIL' END AS single FROM u)
 SELECT poll.Verdict AS panel, single, count(*) AS n FROM poll JOIN s USING (QA_Type, Batch, Root_ID) GROUP BY ALL""")
def two_verdicts(spark, sf_dir):
    """The panel's verdict beside one judge's, question by question; a question that one lacks would stop the job."""
    v = votes(spark, sf_dir)
    both = panel.question_scores(panel.consensus(v)).select(*panel.QUESTION, F.col("Verdict").alias("panel"))
    own = v.where("Judge = 'j1'").withColumn("Label", F.when(F.col("Verdict") == "Unsure", "Undecided").otherwise(F.col("Verdict")))
    one = panel.question_scores(own, label="Label").select(*panel.QUESTION, F.col("Verdict").alias("single"))
    joined = G.require(both.join(one, panel.QUESTION, "full"), F.col("panel").isNotNull() & F.col("single").isNotNull(), "a question that one panel lacks")
    return joined.groupBy("panel", "single").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS c, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS b, (l_partkey, l_suppkey, l_quantity, l_extendedprice) AS o FROM lineitem), g AS (SELECT k, c, count(*) AS n, arg_min(b, o) AS first, arg_max(b, o) AS last FROM r GROUP BY k, c HAVING min(b) <> max(b))
 SELECT count(*) AS n_keys, count(*) FILTER (first = 1 AND last = 0) AS accept_to_reject, count(*) FILTER (first = 0 AND last = 1) AS reject_to_accept FROM g""")
def conflict_flips(spark, sf_dir):
    """Keys with conflicting votes, and which way keeping the last instead of the first would turn them."""
    li = load(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    c = R.conflicts(li, ["l_orderkey", "l_linenumber"], "o", F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).where("conflicting")
    return c.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if((F.col("first") == 1) & (F.col("last") == 0)).alias("accept_to_reject"), F.count_if((F.col("first") == 0) & (F.col("last") == 1)).alias("reject_to_accept"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING min(l_returnflag) <> max(l_returnflag) ORDER BY ALL LIMIT 15) SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey, l_suppkey FROM lineitem JOIN g USING (l_orderkey, l_linenumber)""")
def conflict_rows(spark, sf_dir):
    """The rows of the first fifteen keys in conflict (a report)."""
    return R.conflict_rows(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_returnflag"), 15).select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey")


@query("""WITH s AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 3 AS shard FROM orders), r AS (SELECT *, dense_rank() OVER (ORDER BY c % 100, shard, c) AS root FROM s) SELECT k, root AS New_Root, row_number() OVER (ORDER BY root, k) AS in_all, k AS kept FROM r""")
def renumber_modes(spark, sf_dir):
    """Merged shards numbered over all questions, and with their own numbers kept."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    shards = load(spark, sf_dir, "orders").select((k % 3).alias("shard"), c.alias("Root_ID"), k.alias("Question_No"), c.cast("string").alias("key"))
    roots = load(spark, sf_dir, "orders").select(c.cast("string").alias("key"), (c % 100).alias("original")).distinct()
    every = R.merge_renumber(shards, roots, "global").select(F.col("Question_No").alias("k"), "New_Root", F.col("New_Question").alias("in_all"))
    own = R.merge_renumber(shards, roots, "keep").select(F.col("Question_No").alias("k"), F.col("New_Question").alias("kept"))
    return every.join(own, "k")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 4")
def support_filter(spark, sf_dir):
    """Users with at least four events."""
    return G.with_support(load(spark, sf_dir, "events"), ["user_id"], 4).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + "SELECT Batch, count(*) AS n FROM poll WHERE Seed_Type IN ('generic', 'dynamic_generic') GROUP BY Batch")
def track_counts(spark, sf_dir):
    """Questions of a track and its dynamic form."""
    q = votes(spark, sf_dir).select(*panel.QUESTION, "Seed_Type").distinct()
    return G.track_rows(q, "generic").groupBy("Batch").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'duplicate' AS fault, CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT 'domain', event_type, count(*) FROM events WHERE event_type NOT IN ('click', 'view') OR event_type IS NULL GROUP BY event_type""")
def guard_report(spark, sf_dir):
    """What the guards find: keys that repeat, values outside a domain."""
    twice = G.duplicate_keys(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    off = G.outside_domain(load(spark, sf_dir, "events"), "event_type", ["click", "view"])
    return twice.select(F.lit("duplicate").alias("fault"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("k"), "n").union(off.select(F.lit("domain"), "event_type", "n"))


@query("""SELECT 'orders' AS stage, count(*) AS n, 2 AS shards FROM orders UNION ALL SELECT 'lines', count(*), 3 FROM lineitem""")
def stage_counts(spark, sf_dir):
    """Rows of every stage over its shards; one shard of a stage is lacking."""
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    n, _ = R.stage_counts({"orders": {f"s{i}": o.where(F.col("o_orderkey") % 2 == i) for i in (0, 1)} | {"s2": None}, "lines": {f"s{i}": li.where(F.col("l_orderkey") % 3 == i) for i in (0, 1, 2)}})
    return n


@query("""SELECT row_number() OVER (ORDER BY doc_id % 4, doc_id) AS ID, doc_id, quality AS Result, round(sum(quality) OVER () / count(*) OVER (), 6) AS accuracy FROM labels""")
def merged_results(spark, sf_dir):
    """Shards' results merged in order, numbered anew, with the accuracy of all; one shard never started."""
    own = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("Result"))
    merged = R.merged_shards({i: own.where(F.col("doc_id") % 4 == i) for i in range(4)} | {4: None}, started={0, 1, 2, 3})
    G.require_same_count(merged, own)
    total = merged.agg(F.round(F.avg("Result"), 6).alias("accuracy"))  # one row
    return R.positions(merged, ["shard", "doc_id"], "ID").select((F.col("ID") + 1).alias("ID"), "doc_id", "Result").crossJoin(F.broadcast(total))


@query("""WITH m AS (SELECT lang, unnest(['quality', 'clean']) AS model, unnest([quality, 1 - toxic]) AS r, unnest([FALSE, quality = 0]) AS failed FROM labels JOIN documents USING (doc_id)), a AS (SELECT lang, model, avg(r) AS acc, avg(r) FILTER (NOT failed) AS running FROM m GROUP BY ALL)
 SELECT lang, arg_max(model, (acc, model)) AS best, round(max(acc), 6) AS acc, round(arg_max(running, (acc, model)), 6) AS running FROM a GROUP BY lang""")
def best_models(spark, sf_dir):
    """The more accurate of two models by language, and its accuracy without failed rows."""
    d = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    both = F.array(F.struct(F.lit("quality").alias("model"), F.col("quality").alias("r"), F.lit(False).alias("failed")), F.struct(F.lit("clean").alias("model"), (1 - F.col("toxic")).alias("r"), (F.col("quality") == 0).alias("failed")))
    m = d.select("lang", F.explode(both).alias("x")).select("lang", "x.*").groupBy("lang", "model").agg(F.avg("r").alias("acc"), running_accuracy(F.col("r"), F.col("failed")).alias("running"))
    top = F.struct("acc", "model")
    return m.groupBy("lang").agg(F.max_by("model", top).alias("best"), F.round(F.max("acc"), 6).alias("acc"), F.round(F.max_by("running", top), 6).alias("running"))


@query(WITH + ", n AS (SELECT QA_Type, count(DISTINCT Judge) AS judges FROM votes GROUP BY QA_Type, Batch, Root_ID, Criterion_No) SELECT QA_Type, judges, count(*) AS n_criteria FROM n GROUP BY ALL")
def judge_uniformity(spark, sf_dir):
    """How many judges the criteria have."""
    per = votes(spark, sf_dir).groupBy(*panel.CRITERION).agg(F.count(F.lit(1)).alias("judges"))  # one vote a judge
    return per.groupBy("QA_Type", "judges").agg(F.count(F.lit(1)).alias("n_criteria"))


@query(WITH + """, t AS (SELECT l_orderkey AS Root_ID, l_linenumber AS Criterion_No, min(l_partkey) AS text FROM lineitem WHERE l_linenumber <> 7 GROUP BY ALL) SELECT QA_Type, Batch, Root_ID, Criterion_No, Consensus, text FROM cons LEFT JOIN t USING (Root_ID, Criterion_No)""")
def criterion_texts(spark, sf_dir):
    """Criterion scores beside the first of each criterion's repeated texts; some criteria have none."""
    scores = panel.consensus(votes(spark, sf_dir)).select(*panel.CRITERION, "Consensus")
    li = load(spark, sf_dir, "lineitem").where("l_linenumber <> 7").select(F.col("l_orderkey").alias("Root_ID"), F.col("l_linenumber").alias("Criterion_No"), F.col("l_partkey").alias("text"))
    return scores.join(R.first_of(li, ["Root_ID", "Criterion_No"], ["text"]), ["Root_ID", "Criterion_No"], "left").select(*panel.CRITERION, "Consensus", "text")


_BUCKET = "['fee', 'rate', 'cap'][(Criterion_No % 3 + 1)::BIGINT]"


@query(WITH + f""", f AS (SELECT QA_Type, Seed_Type, {_BUCKET} AS bucket, count(*) AS judge_rows, count(*) FILTER (Verdict = 'No') AS no_rows FROM votes GROUP BY ALL), s AS (SELECT QA_Type, Seed_Type, {_BUCKET} AS bucket, count(DISTINCT Verdict) > 1 AS split FROM votes GROUP BY QA_Type, Batch, Seed_Type, Root_ID, Criterion_No),
 d AS (SELECT QA_Type, Seed_Type, bucket, count(*) AS instances, count(*) FILTER (split) AS splits FROM s GROUP BY ALL)
 SELECT coalesce(QA_Type, 'all') AS QA_Type, coalesce(Seed_Type, 'all') AS Seed_Type, bucket, CAST(sum(judge_rows) AS BIGINT) AS judge_rows, round(sum(no_rows) / sum(judge_rows), 6) AS no_rate, CAST(sum(instances) AS BIGINT) AS instances, round(sum(splits) / sum(instances), 6) AS disagree_rate
 FROM f FULL JOIN d USING (QA_Type, Seed_Type, bucket) GROUP BY GROUPING SETS ((QA_Type, Seed_Type, bucket), (bucket))""")
def bucket_rates(spark, sf_dir):
    """Rates of refusals and of split judges by type, track and bucket, and pooled by bucket."""
    bucket = F.element_at(F.array(F.lit("fee"), F.lit("rate"), F.lit("cap")), (F.col("Criterion_No") % 3 + 1).cast("int"))
    v = votes(spark, sf_dir).withColumn("bucket", bucket).withColumn("is_no", (F.col("Verdict") == "No").cast("int"))
    key = ["QA_Type", "Seed_Type", "bucket"]
    fail = v.groupBy(*key).agg(F.count(F.lit(1)).alias("judge_rows"), F.sum("is_no").alias("no_rows"))
    marks = [F.count_if(F.col("Verdict") == w) > 0 for w in ("Yes", "No", "Unsure")]
    split = v.groupBy(*panel.CRITERION, "Seed_Type", "bucket").agg((sum(m.cast("int") for m in marks) > 1).alias("split"))
    out = fail.join(split.groupBy(*key).agg(F.count(F.lit(1)).alias("instances"), F.count_if("split").alias("splits")), key, "full")
    agg = [F.sum("judge_rows").alias("judge_rows"), F.round(F.sum("no_rows") / F.sum("judge_rows"), 6).alias("no_rate"), F.sum("instances").alias("instances"), F.round(F.sum("splits") / F.sum("instances"), 6).alias("disagree_rate")]
    sets = out.groupingSets([key, ["bucket"]], *key).agg(*agg)
    return sets.withColumn("QA_Type", F.coalesce("QA_Type", F.lit("all"))).withColumn("Seed_Type", F.coalesce("Seed_Type", F.lit("all")))


@query("""WITH t AS (SELECT quality, regexp_matches(lower(text), 'license|copyright') AS a, regexp_matches(lower(text), '[#*$%&|<>]{2,}') AS b FROM documents JOIN labels USING (doc_id)), u AS (SELECT 'license' AS tag, quality FROM t WHERE a UNION ALL SELECT 'markup', quality FROM t WHERE b UNION ALL SELECT 'untagged', quality FROM t WHERE NOT coalesce(a, FALSE) AND NOT coalesce(b, FALSE))
 SELECT tag, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(100 * (avg(quality) - (SELECT avg(quality) FROM t)), 4) END AS gap_pp FROM u GROUP BY tag""")
def untagged_rates(spark, sf_dir):
    """Rates of overlapping tags and of rows without any against all rows; too few rows have none."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    found = F.coalesce(X.all_buckets(F.col("text"), [("license", r"license|copyright"), ("markup", r"[#*$%&|<>]{2,}")]), F.array().cast("array<string>"))
    tags = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("untagged")))
    base = d.agg(F.avg("quality").alias("base"))  # one row
    rates = d.select("quality", F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("r"))
    return rates.crossJoin(F.broadcast(base)).select("tag", "n", F.when(F.col("n") >= 20, F.round(100 * (F.col("r") - F.col("base")), 4)).alias("gap_pp"))


_WORDS = "len(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+'), lambda x: x <> ''))"


@query(f"SELECT lang, max(w) AS most, round(avg(w), 6) AS mean, count(*) AS n FROM (SELECT lang, {_WORDS.format('text')} + 2 AS w FROM documents) GROUP BY lang")
def context_sizes(spark, sf_dir):
    """Sizes of contexts in words (documents and question), largest and mean."""
    size = F.size(X.py_tokens(F.col("text"))) + 2
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.max(size).alias("most"), F.round(F.avg(size), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'own' || c_custkey ELSE 'q' || substr(sha1('type1' || chr(0) || c_mktsegment || chr(0) || c_name || chr(0)), 1, 16) END AS QID FROM customer""")
def qid_back_fill(spark, sf_dir):
    """Content keys where a relation has none of its own; a blank one would stop the job."""
    k = F.col("c_custkey")
    own = F.when(k % 3 == 0, F.concat(F.lit("own"), k.cast("string")))
    filled = load(spark, sf_dir, "customer").select("c_custkey", qid_or(own, F.lit("type1"), F.col("c_mktsegment"), F.col("c_name"), F.lit("")).alias("QID"))
    return G.require(filled, F.trim("QID") != "", "a blank key")


@query("""SELECT conv_id, md5(string_agg(role || ':' || coalesce(text, ''), '|' ORDER BY turn)) AS digest, count(*) AS n FROM conversations GROUP BY conv_id""")
def json_encoded(spark, sf_dir):
    """Lists as JSON text, compared as they decode."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(rows).alias("j"))  # one conversation
    back = F.from_json("j", "array<struct<turn:long,role:string,text:string>>")
    return c.select("conv_id", F.md5(F.array_join(F.transform(back, lambda x: F.concat(x["role"], F.lit(":"), F.coalesce(x["text"], F.lit("")))), "|")).alias("digest"), F.size(back).cast("long").alias("n"))
