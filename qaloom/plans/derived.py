"""The reference relations as the driver's tables give them, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.tables import load

VOTES_SQL = """votes AS (
  SELECT QA_Type, Batch, Seed_Type, Root_ID, Criterion_No, Judge, min(Verdict) AS Verdict FROM (
    SELECT 'type' || CAST(l_orderkey % 3 + 1 AS VARCHAR) AS QA_Type, 'b' || CAST(l_orderkey % 4 + 1 AS VARCHAR) AS Batch,
      CASE l_orderkey % 5 WHEN 0 THEN 'reg' WHEN 1 THEN 'dynamic_reg' WHEN 2 THEN 'generic' ELSE 'dynamic_generic' END AS Seed_Type,
      l_orderkey AS Root_ID, l_linenumber AS Criterion_No, 'j1' AS Judge,
      CASE l_returnflag WHEN 'A' THEN 'Yes' WHEN 'N' THEN 'No' ELSE 'Unsure' END AS Verdict FROM lineitem
    UNION ALL
    SELECT 'type' || CAST(l_orderkey % 3 + 1 AS VARCHAR), 'b' || CAST(l_orderkey % 4 + 1 AS VARCHAR),
      CASE l_orderkey % 5 WHEN 0 THEN 'reg' WHEN 1 THEN 'dynamic_reg' WHEN 2 THEN 'generic' ELSE 'dynamic_generic' END,
      l_orderkey, l_linenumber, 'j2', CASE WHEN l_quantity <= 30 THEN 'Yes' WHEN l_quantity <= 45 THEN 'No' ELSE 'Unsure' END FROM lineitem)
  GROUP BY ALL)"""

SCORED_SQL = """scored AS (SELECT *, CASE Verdict WHEN 'Yes' THEN 1.0::DOUBLE WHEN 'No' THEN 0.0::DOUBLE END AS s FROM votes),
crit AS (SELECT QA_Type, Batch, Seed_Type, Root_ID, Criterion_No, count(*) AS N_Judges, avg(s) AS Mean_Score,
  count(s) AS v, count(*) FILTER (s >= 0.75) AS y, count(*) FILTER (s <= 0.25) AS n FROM scored GROUP BY ALL),
cons AS (SELECT *, CASE WHEN v = 0 THEN 'Undecided' WHEN y > n THEN 'Yes' WHEN n > y THEN 'No' ELSE 'DISAGREE' END AS Consensus,
  (v = 0 OR NOT (y = v OR n = v)) AS Non_Unanimous FROM crit),
quest AS (SELECT QA_Type, Batch, Root_ID, any_value(Seed_Type) AS Seed_Type, count(*) AS N_Criteria, count(*) FILTER (Consensus = 'Yes') AS N_Pass,
  count(*) FILTER (Consensus = 'Yes') / count(*) AS Pass_Frac, count(*) FILTER (Consensus IN ('DISAGREE', 'Undecided')) / count(*) AS No_Majority_Frac,
  count(*) FILTER (Non_Unanimous) / count(*) AS Disagreement_Rate, avg(Mean_Score) AS Mean_Score FROM cons GROUP BY QA_Type, Batch, Root_ID),
poll AS (SELECT *, CASE WHEN No_Majority_Frac > 0.34 THEN 'DISAGREE' WHEN Pass_Frac >= 0.75 THEN 'PASS' ELSE 'FAIL' END AS Verdict FROM quest)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judges' votes on each line of an order, one vote a judge: a line number may repeat, and of conflicting votes the least
    word counts, whatever their order.

    Votes are numbers until they are collapsed (No 0, Unsure 1, Yes 2, the order of the words), and rows are dealt by
    question once: criteria and questions are then counted where they stand."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("Root_ID"), F.col("l_linenumber").alias("Criterion_No"), "l_returnflag", "l_quantity").repartition("Root_ID")
    one = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 0).otherwise(1)
    two = F.when(F.col("l_quantity") <= 30, 2).when(F.col("l_quantity") <= 45, 0).otherwise(1)
    least = li.groupBy("Root_ID", "Criterion_No").agg(F.min(one).alias("j1"), F.min(two).alias("j2"))
    five, word = F.col("Root_ID") % 5, lambda c: F.when(c == 2, "Yes").when(c == 0, "No").otherwise("Unsure")
    both = F.explode(F.array(*(F.struct(F.lit(j).alias("Judge"), word(F.col(j)).alias("Verdict")) for j in ("j1", "j2"))))
    return least.select(
        F.concat(F.lit("type"), (F.col("Root_ID") % 3 + 1).cast("string")).alias("QA_Type"), F.concat(F.lit("b"), (F.col("Root_ID") % 4 + 1).cast("string")).alias("Batch"),
        F.when(five == 0, "reg").when(five == 1, "dynamic_reg").when(five == 2, "generic").otherwise("dynamic_generic").alias("Seed_Type"), "Root_ID", "Criterion_No", both.alias("x"),
    ).select("QA_Type", "Batch", "Seed_Type", "Root_ID", "Criterion_No", "x.*")


CORPUS_SQL = "corpus AS (SELECT doc_id, lang AS QA_Type, source AS Batch, coalesce(text, '') AS Question FROM documents)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as questions."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("lang").alias("QA_Type"), F.col("source").alias("Batch"), F.coalesce("text", F.lit("")).alias("Question"))


PAIRED_SQL = "paired AS (SELECT doc_id, lang AS QA_Type, source AS Cluster, quality AS a, 1 - toxic AS b FROM labels JOIN documents USING (doc_id))"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' correctness on the same items: labels of documents, clustered by source."""
    l, d = load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents")
    return l.join(d.select("doc_id", "lang", "source"), "doc_id").select("doc_id", F.col("lang").alias("QA_Type"), F.col("source").alias("Cluster"), F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
