"""Joins, set operations, windows, sharding."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qaloom.functions.keys import qid, track
from qaloom.operators import relations as R
from qaloom.plans.registry import query
from qaloom.tables import load

_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT conv_id, turn, 'q' || substr(sha1('type1' || chr(0) || {_TRIM.format('role')} || chr(0) || CAST(conv_id AS VARCHAR) || chr(0) || {_TRIM.format('text')}), 1, 16) AS QID FROM conversations")
def qid_hash(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", qid(F.lit("type1"), F.col("role"), F.col("conv_id").cast("string"), F.col("text")).alias("QID"))


@query("""SELECT o_orderkey AS Root_ID, o_custkey, c_mktsegment AS Persona, coalesce(n_name, 'MISSING') AS Environment
 FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 1""")
def join_left_missing(spark, sf_dir):
    o, c, n = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    scen = c.join(F.broadcast(n.where("n_regionkey <> 1")), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("Persona"), F.col("n_name").alias("Environment"))
    return R.join_or_default(o.select(F.col("o_orderkey").alias("Root_ID"), "o_custkey"), scen, ["o_custkey"], {"Environment": "MISSING"})


@query("""SELECT doc_id, side FROM (SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
 UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'fr'))
 WHERE side = 'right' OR doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'fr')""")
def anti_both_ways(spark, sf_dir):
    return R.anti_both_ways(load(spark, sf_dir, "documents").where("lang <> 'fr'"), load(spark, sf_dir, "labels"), ["doc_id"])


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS row_idx, item_id, text FROM benchmark), b AS (SELECT row_number() OVER (ORDER BY text, item_id) - 1 AS row_idx, text AS text2 FROM benchmark)
 SELECT row_idx, item_id, text IS NOT DISTINCT FROM text2 AS aligned FROM a JOIN b USING (row_idx)""")
def positional_join(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark")
    left = R.positions(b.select("item_id", "text"), ["item_id"])
    right = R.positions(b.select("item_id", "text"), ["text", "item_id"]).select("row_idx", F.col("text").alias("text2"))
    return R.positional_join(left, right, "text", "text2").select("row_idx", "item_id", "aligned")


@query("""WITH t AS (SELECT p_name, min(p_size) AS size FROM part GROUP BY p_name HAVING count(DISTINCT p_size) = 1)
 SELECT p_partkey, p_name, size AS found FROM part LEFT JOIN t USING (p_name)""")
def ambiguous_lookup(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return R.unambiguous_lookup(p.select("p_partkey", "p_name"), p.select("p_name", F.col("p_size").alias("found")), "p_name", "found")


_LINE = "l_orderkey, l_linenumber"


@query(f"""SELECT {_LINE}, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY {_LINE} ORDER BY l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) WHERE r = 1""")
def dedup_keep_first(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return R.first_of(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])


@query(f"""SELECT {_LINE}, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY {_LINE} ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS r FROM lineitem) WHERE r = 1""")
def dedup_keep_last(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return R.last_of(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])


@query("SELECT o_orderkey, row_idx, CAST(row_idx % 16 AS INTEGER) AS shard FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders)")
def shard_round_robin(spark, sf_dir):
    return R.shard_round_robin(R.positions(load(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"]), 16)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, CAST(ntile(16) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS shard FROM orders")
def shard_contiguous(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    return R.shard_contiguous(R.positions(o, ["o_orderkey"]), 16, o.count())


@query("""WITH s AS (SELECT CAST(o_orderkey % 4 AS INTEGER) AS shard, o_custkey // 4 AS Root_ID, o_orderkey AS Question_No, o_custkey AS key FROM orders),
 k AS (SELECT s.*, coalesce(c.original, 1000000000) AS original FROM s LEFT JOIN (SELECT c_custkey AS key, CAST(c_nationkey AS BIGINT) AS original FROM customer WHERE c_acctbal > 0) c USING (key)),
 r AS (SELECT shard, Root_ID, row_number() OVER (ORDER BY min(original), shard, Root_ID) AS New_Root FROM k GROUP BY shard, Root_ID)
 SELECT shard, Root_ID, Question_No, New_Root, row_number() OVER (PARTITION BY New_Root ORDER BY Question_No) AS New_Question FROM k JOIN r USING (shard, Root_ID)""")
def merge_renumber(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    s = o.select(F.pmod("o_orderkey", F.lit(4)).cast("int").alias("shard"), F.floor(F.col("o_custkey") / 4).alias("Root_ID"), F.col("o_orderkey").alias("Question_No"), F.col("o_custkey").alias("key"))
    roots = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("original"))
    return R.merge_renumber(s, roots).select("shard", "Root_ID", "Question_No", "New_Root", "New_Question")


@query("SELECT item_id AS id, text FROM benchmark UNION ALL SELECT conv_id, text FROM conversations WHERE role = 'user'")
def union_checked(spark, sf_dir):
    return R.union_checked(load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), load(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("id"), "text"))


@query("""WITH a AS (SELECT l_returnflag AS x, l_linestatus AS y FROM lineitem WHERE l_quantity < 10), b AS (SELECT l_returnflag AS x, l_linestatus AS y FROM lineitem WHERE l_quantity > 42)
 SELECT x, y, side, count(*) AS n FROM (SELECT x, y, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT x, y, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY ALL""")
def except_both(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("x"), F.col("l_linestatus").alias("y"), "l_quantity")
    return R.except_both(li.where("l_quantity < 10").drop("l_quantity"), li.where("l_quantity > 42").drop("l_quantity")).groupBy("x", "y", "side").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(DISTINCT text) AS n_distinct, count(*) AS n, count(*) - count(DISTINCT text) AS n_repeats FROM documents GROUP BY lang")
def distinct_collapse(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.count_distinct("text").alias("n_distinct"), F.count(F.lit(1)).alias("n")).withColumn("n_repeats", F.col("n") - F.col("n_distinct"))


@query("""SELECT o.o_orderkey AS Root_ID, o.o_orderpriority AS Judge FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""")
def resume_pending(spark, sf_dir):
    done = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("Root_ID"))
    return R.pending(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Root_ID"), F.col("o_orderpriority").alias("Judge")), done, ["Root_ID"])


@query("""WITH b AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS batch, count(*) FILTER (o_orderstatus = 'F') AS n_pass FROM orders GROUP BY ALL), r AS (SELECT *, CAST(sum(n_pass) OVER (ORDER BY batch) AS BIGINT) AS running FROM b)
 SELECT * FROM r WHERE running - n_pass < 3000""")
def batches_until_target(spark, sf_dir):
    b = load(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("batch")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_pass"))
    return R.cumulative_until(b, "batch", "n_pass", 3000)


@query("""WITH s AS (SELECT user_id, event_type, CAST(epoch(ts) AS BIGINT) AS t, value, event_id FROM events)
 SELECT event_type, round(median(value), 6) AS p50, list_sort(list(value))[least(len(list(value)), CAST(floor(0.95 * len(list(value))) AS BIGINT) + 1)] AS p95 FROM s GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    """The median, and the value at index floor(0.95 n) of the sorted samples: an exact percentile_disc, not a gathered list."""
    e = load(spark, sf_dir, "events")
    n = e.groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.median("value"), 6).alias("p50"))
    freq = e.where("value is not null").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy("event_type").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    at = freq.withColumn("upto", upto).join(n, "event_type").where(F.col("upto") > F.least(F.col("n") - 1, F.floor(0.95 * F.col("n"))))
    return at.groupBy("event_type").agg(F.first("p50").alias("p50"), F.min("value").alias("p95"))


@query("""WITH m AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL), l AS (SELECT h, n, v, lag(n) OVER (ORDER BY h) AS pn, lag(v) OVER (ORDER BY h) AS pv FROM m)
 SELECT count(*) AS n_levels, count(*) FILTER (n >= 2 * pn AND v < 1.2 * pv) AS n_saturated, count(*) FILTER (n >= 2 * pn) AS n_doubled FROM l""")
def adjacent_levels(spark, sf_dir):
    """Load levels beside the one before: doubled load with less than a fifth more result.  A row an hour is windowed."""
    m = load(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    w = W.orderBy("h")
    level = m.withColumn("pn", F.lag("n").over(w)).withColumn("pv", F.lag("v").over(w))
    twice = F.col("n") >= 2 * F.col("pn")
    return level.agg(F.count(F.lit(1)).alias("n_levels"), F.count_if(twice & (F.col("v") < 1.2 * F.col("pv"))).alias("n_saturated"), F.count_if(twice).alias("n_doubled"))


@query("""WITH c AS (SELECT c_mktsegment AS persona, n_name AS env, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
 SELECT persona, env, n, row_number() OVER (PARTITION BY persona ORDER BY n DESC, env) AS r FROM c QUALIFY r <= 3""")
def top_n_by_group(spark, sf_dir):
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    g = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_mktsegment").alias("persona"), F.col("n_name").alias("env")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("r", F.row_number().over(W.partitionBy("persona").orderBy(F.desc("n"), "env"))).where("r <= 3")


@query("""WITH a AS (SELECT n_regionkey, n_name, avg(c_acctbal) AS acc FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
 SELECT n_regionkey, arg_min(n_name, (acc, n_name)) AS lowest, arg_max(n_name, acc) AS highest, round(max(acc) - min(acc), 4) AS spread, round(stddev_samp(acc), 4) AS sd FROM a GROUP BY n_regionkey""")
def argmin_argmax(spark, sf_dir):
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    a = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.avg("c_acctbal").alias("acc"))
    return a.groupBy("n_regionkey").agg(F.min_by("n_name", F.struct("acc", "n_name")).alias("lowest"), F.max_by("n_name", "acc").alias("highest"), F.round(F.max("acc") - F.min("acc"), 4).alias("spread"), F.round(F.stddev_samp("acc"), 4).alias("sd"))


@query("""SELECT CASE WHEN lang IN ('en', 'de') THEN 'reg' ELSE 'generic' END AS Track, source AS Batch, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY ALL""")
def track_tags(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    seed = F.when(F.col("lang") == "en", "reg").when(F.col("lang") == "de", "dynamic_reg").otherwise("generic")
    return d.groupBy(track(seed).alias("Track"), F.col("source").alias("Batch")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
