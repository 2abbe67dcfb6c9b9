"""Readers and writers: the driver's rows written in each format to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from qaloom.operators import relations as R
from qaloom.operators import sampling as P
from qaloom.plans.registry import query
from qaloom.plans.replies import cat
from qaloom.sources import files
from qaloom.tables import load, shared_folder


def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, md5(text) AS digest FROM conversations")
def tsv_round_trip(spark, sf_dir):
    """Texts with line ends, tabs and quotes through a checked TSV, ragged rows being errors."""
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "role", "text")
    back = files.write_checked(rows, path := fresh(spark, "tsv"))
    strict = files.read_tsv(spark, path, back.columns, strict=True)
    return strict.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderstatus AS status, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey AS INTEGER) END AS customer FROM orders")
def tsv_typed(spark, sf_dir):
    """Typed columns from text; NA and empty fields are null."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = o.select(k.cast("string").alias("k"), F.when(k % 10 == 0, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("price"), F.col("o_orderstatus").alias("status"), F.when(k % 7 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("customer"))
    files.write_tsv(text, path := fresh(spark, "typed"), quote_all=True)
    return files.read_typed_tsv(spark, path, "k bigint, price double, status string, customer int")


@query("SELECT conv_id, list(role ORDER BY turn) AS roles, sum(length(text)) AS chars FROM conversations GROUP BY conv_id")
def json_lines(spark, sf_dir):
    """Lists as JSON lines, appended in two halves."""
    c = load(spark, sf_dir, "conversations")
    lists = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"), F.sum(F.length("text")).alias("chars"))  # one conversation
    path = fresh(spark, "jsonl")
    for half in (0, 1):
        files.append_json_lines(lists.where(F.col("conv_id") % 2 == half), path)
    return files.read_json_lines(spark, path, "conv_id long, roles array<string>, chars long")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, n_regionkey AS region FROM nation")
def json_document(spark, sf_dir):
    """One JSON object of all nations, as its entries."""
    entry = F.struct(F.col("n_nationkey").cast("string").alias("key"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("value"))
    doc = load(spark, sf_dir, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))  # 25 rows
    doc.write.text(path := fresh(spark, "json"))
    return files.read_json_map(spark, path, "struct<name:string,region:int>").select("id", "value.*")


@query("SELECT 's' || s_suppkey AS user_persona, s_name AS collection_of_docs, CASE WHEN s_suppkey % 4 = 0 THEN 'GENERIC' ELSE CAST(s_nationkey AS VARCHAR) END AS regulatory_area_id FROM supplier WHERE s_suppkey % 5 <> 0")
def marker_blocks(spark, sf_dir):
    """Blocks of three marked lines out of text files, one a supplier; a fifth lack their second line."""
    k = F.col("s_suppkey")
    area = F.when(k % 4 == 0, "GENERIC").otherwise(F.col("s_nationkey").cast("string"))
    text = cat("noise\nUSER_PERSONA: s", k, "\n", F.when(k % 5 == 0, "").otherwise(cat("COLLECTION_OF_DOCS: ", F.col("s_name"), "\n")), "REGULATORY_AREA_ID: ", area, "\n")
    rows = load(spark, sf_dir, "supplier").select((k % 4).alias("part"), k.alias("key"), text.alias("text"))
    files.write_row_texts(rows, "key", "text", path := fresh(spark, "marked"))
    return files.read_markers(spark, f"{path}/key=*", ["USER_PERSONA", "COLLECTION_OF_DOCS", "REGULATORY_AREA_ID"]).select("user_persona", "collection_of_docs", "regulatory_area_id")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS status FROM orders")
def partitioned_files(spark, sf_dir):
    """One folder of files a status, read back by a glob; the status comes from the path."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderstatus").alias("status"))
    files.split_by(rows, "status", path := fresh(spark, "split"))
    return files.read_partitioned(spark, f"{path}/status=*", ["k"], status="/status=([^/]*)/")


@query("SELECT CAST(user_id % 4 AS VARCHAR) AS run, CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END AS value, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY ALL")
def log_verdicts(spark, sf_dir):
    """Records of logs, parted by a line of dashes; of each the first verdict counts, in whatever case.  Some have none."""
    verdict = F.when(F.col("event_id") % 5 == 0, "no verdict").otherwise(F.when(F.col("event_id") % 3 == 0, "Grounded: True").otherwise("Grounded:  FALSE\nGrounded: True"))
    text = cat("Question: e", F.col("event_id"), "\n", verdict, "\n", "-" * 57)
    logs = load(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("run"), text.alias("value"))
    logs.write.partitionBy("run").text(path := fresh(spark, "logs"))
    return files.log_counts(spark, f"{path}/run=*", "-" * 57 + "\n", r"Grounded:\s*(\w+)", run="/run=([^/]*)/")


@query("SELECT '-s' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS shard FROM nation")
def manifest(spark, sf_dir):
    names = sorted(f"-s{r[0]:02d}" for r in load(spark, sf_dir, "nation").select("n_nationkey").collect())  # 25 shards
    files.write_manifest(names, spark, path := fresh(spark, "manifest"))
    return files.read_manifest(spark, path)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS Root_ID, 'j1' AS Judge, CASE WHEN o_orderkey % 3 = 0 THEN 'No' ELSE 'Yes' END AS Verdict FROM orders WHERE o_orderkey % 4 <> 0")
def judgment_merge(spark, sf_dir):
    """Two shards' append logs: the second run repeats its header and every third vote, with another verdict; the last counts."""
    k = F.col("o_orderkey")
    own = load(spark, sf_dir, "orders").where(k % 4 != 0)
    vote = lambda v, at: own.select(k.cast("string").alias("Root_ID"), F.lit("j1").alias("Judge"), F.lit(v).alias("Verdict"), F.lit(at).alias("At"))
    header = spark.createDataFrame([("Root_ID", "Judge", "Verdict", "At")], "Root_ID string, Judge string, Verdict string, At string")
    shards = []
    for s in (0, 1):
        path = fresh(spark, "log")
        files.append_tsv(vote("Yes", "1").where(k % 2 == s), path)
        files.append_tsv(header.union(vote("No", "2").where((k % 2 == s) & (k % 3 == 0))), path)
        shards.append(files.read_tsv(spark, path, ["Root_ID", "Judge", "Verdict", "At"]))
    corpus = load(spark, sf_dir, "orders").select(k.cast("string").alias("Root_ID"))
    kept, _ = R.merged_judgments(shards, corpus, ["Root_ID"], ["Root_ID", "Judge"], "At")
    return kept.select("Root_ID", "Judge", "Verdict")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 = 0")
def unjudged_questions(spark, sf_dir):
    """Questions of a corpus that no shard judged."""
    k = F.col("o_orderkey")
    corpus = load(spark, sf_dir, "orders").select(k.alias("k"))
    votes = corpus.where("k % 4 <> 0").select(F.col("k").cast("string").alias("k"), F.lit("j1").alias("Judge"), F.lit(1).alias("At"))
    _, lacking = R.merged_judgments([votes.where("k % 2 = 0"), votes.where("k % 2 = 1")], corpus.select(F.col("k").cast("string").alias("k")), ["k"], ["k", "Judge"], "At")
    return lacking.select(F.col("k").cast("long").alias("k"))


@query("""SELECT item_id, md5('## I' || lpad(CAST(item_id AS VARCHAR), 3, '0') || chr(10) || chr(10) || '**Question.** q' || item_id || chr(10) || chr(10) || '**Answer.** ' || text || chr(10) || chr(10) || '### Document 1' || chr(10) || chr(10) || text || chr(10) || chr(10) || '### Document 2' || chr(10) || chr(10) || 'x') AS digest FROM benchmark""")
def markdown_items(spark, sf_dir):
    item = files.markdown_item(F.concat(F.lit("I"), F.lpad(F.col("item_id").cast("string"), 3, "0")), cat("q", F.col("item_id")), F.col("text"), F.array(F.col("text"), F.lit("x")))
    return load(spark, sf_dir, "benchmark").select("item_id", F.md5(item).alias("digest"))


@query(r"""SELECT unnest(['\begin{table}', '\caption{Regions}', '\begin{tabular}{ll}', 'r\_name & n \\', '\hline'] || (SELECT list(r_name || ' & ' || CAST(n AS VARCHAR) || '\% \\') FROM (SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name)) || ['\end{tabular}', '\end{table}']) AS line""")
def latex_lines(spark, sf_dir):
    """A small aggregate as the lines of a LaTeX table."""
    n = load(spark, sf_dir, "nation").join(F.broadcast(load(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit("%")).alias("n"))
    return spark.createDataFrame([(x,) for x in files.latex_table(n, "Regions").split("\n")], "line string")


_RULE = "repeat('-', 80)"


@query(f"""SELECT CAST(item_id AS VARCHAR) AS key, md5('Question No: ' || item_id || chr(10) || 'Context Size: ' || len(list_filter(regexp_split_to_array('d ' || text || ' q' || item_id, '\\s+'), lambda x: x <> '')) || chr(10) || chr(10) || 'Documents:' || chr(10) || chr(10) || 'd ' || text || chr(10) || chr(10) || {_RULE} || chr(10) || chr(10)
 || 'Question: q' || item_id || chr(10) || chr(10) || 'Answer:' || chr(10) || 'a' || chr(10) || chr(10) || {_RULE}) AS digest FROM benchmark""")
def row_files(spark, sf_dir):
    """One readable text file a row."""
    i = F.col("item_id")
    text = files.row_text(i, cat("q", i), F.lit("a"), cat("d ", F.col("text")))
    files.write_row_texts(load(spark, sf_dir, "benchmark").select(i, text.alias("text")), "item_id", "text", path := fresh(spark, "rows"))
    return files.read_row_texts(spark, path).select("key", F.md5("value").alias("digest"))


_ROUNDS = """acc AS (SELECT lang AS t, avg(quality) AS acc FROM labels JOIN documents USING (doc_id) GROUP BY lang), r0 AS (SELECT *, 25.0::DOUBLE AS w FROM acc)"""
_ROUND = """{1} AS (SELECT t, acc, w - CASE WHEN moves THEN shed ELSE 0 END + CASE WHEN moves AND t = recipient THEN total ELSE 0 END AS w FROM (SELECT *, bool_or(sat) OVER () AND NOT bool_and(sat) OVER () AS moves, sum(shed) OVER () AS total, arg_min(t, (acc, t)) FILTER (NOT sat) OVER () AS recipient
 FROM (SELECT *, acc >= 0.85 AS sat, CASE WHEN acc >= 0.85 THEN least(3.0, greatest(0.0, w - 18.0)) ELSE 0.0 END AS shed FROM {0})))"""


@query(f"WITH {_ROUNDS}, {', '.join(_ROUND.format(f'r{i}', f'r{i + 1}') for i in range(3))} SELECT CAST(n AS INTEGER) AS round, t, round(w, 6) AS w FROM (" + " UNION ALL ".join(f"SELECT {i} AS n, t, w FROM r{i}" for i in range(4)) + ")")
def allocation_rounds(spark, sf_dir):
    """Three rounds of moving weight, written as one JSON document and read back."""
    acc = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents"), "doc_id").groupBy(F.col("lang").alias("t")).agg(F.avg("quality").alias("acc"))
    rounds = P.allocation_rounds(acc.withColumn("w", F.lit(25.0)), 0.85, 3.0, 18.0, 3)
    path = fresh(spark, "weights")
    for r in range(4):
        before = rounds.where(F.col("round") == max(r - 1, 0)).select("t", F.col("w").alias("before"))
        files.weights_document(rounds.where(F.col("round") == r).join(before, "t"), f"round {r}", 0.85, 3.0, 18.0).write.mode("append").text(path)
    doc = spark.read.text(path).select(F.from_json("value", "struct<mode:string,weights_out:map<string,double>>").alias("d"))
    return doc.select(F.regexp_extract("d.mode", r"(\d+)", 1).cast("int").alias("round"), F.explode("d.weights_out").alias("t", "w")).select("round", "t", F.round("w", 6).alias("w"))
