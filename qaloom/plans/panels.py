"""Judge panels over votes derived from lineitem."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qaloom.functions.keys import track
from qaloom.operators import panel
from qaloom.plans.derived import SCORED_SQL, VOTES_SQL, votes
from qaloom.plans.registry import query
from qaloom.tables import load

WITH = f"WITH {VOTES_SQL}, {SCORED_SQL} "
CRIT = [*panel.CRITERION, "Seed_Type"]
QUEST = [*panel.QUESTION, "Seed_Type"]


def _crit(spark, sf_dir, mode="exclude"):
    return panel.consensus(votes(spark, sf_dir), mode, CRIT)


def _quest(spark, sf_dir, preset="poll"):
    return panel.question_scores(_crit(spark, sf_dir), panel.PRESETS[preset], QUEST)


@query(WITH + "SELECT QA_Type, Batch, Root_ID, Criterion_No, Seed_Type, Consensus, round(Mean_Score, 4) AS Mean_Score, N_Judges, Non_Unanimous FROM cons")
def panel_consensus(spark, sf_dir):
    return _crit(spark, sf_dir).withColumn("Mean_Score", F.round("Mean_Score", 4))


_ROUND = "round(Pass_Frac, 4) AS Pass_Frac, round(No_Majority_Frac, 4) AS No_Majority_Frac, round(Disagreement_Rate, 4) AS Disagreement_Rate, round(Mean_Score, 4) AS Mean_Score"


@query(WITH + f"SELECT QA_Type, Batch, Root_ID, Seed_Type, N_Criteria, N_Pass, {_ROUND}, Verdict FROM poll")
def panel_verdict(spark, sf_dir):
    q = _quest(spark, sf_dir)
    return q.select(*(F.round(c, 4).alias(c) if c in ("Pass_Frac", "No_Majority_Frac", "Disagreement_Rate", "Mean_Score") else c for c in q.columns))


@query(WITH + """SELECT CASE WHEN grouping(QA_Type) = 0 THEN 'QA_Type' WHEN grouping(Seed_Type) = 0 THEN 'Seed_Type' ELSE 'all' END AS level, Seed_Type, QA_Type,
 count(*) AS n, count(*) FILTER (Verdict = 'PASS') AS n_pass, count(*) FILTER (Verdict = 'FAIL') AS n_fail, count(*) FILTER (Verdict = 'DISAGREE') AS n_disagree,
 round(avg(Pass_Frac), 6) AS mean_pass_frac, round(avg(Disagreement_Rate), 6) AS mean_disagreement FROM poll GROUP BY GROUPING SETS ((Seed_Type), (QA_Type), ())""")
def panel_summary_sets(spark, sf_dir):
    s = panel.summary_sets(_quest(spark, sf_dir), ["Seed_Type", "QA_Type"])
    return s.withColumn("mean_pass_frac", F.round("mean_pass_frac", 6)).withColumn("mean_disagreement", F.round("mean_disagreement", 6))


_UNANIMOUS = """SELECT QA_Type, Batch, Root_ID, Criterion_No, CASE count(DISTINCT CASE WHEN Verdict <> 'Unsure' THEN Verdict END) WHEN 0 THEN 'Undecided'
 WHEN 1 THEN min(CASE WHEN Verdict <> 'Unsure' THEN Verdict END) ELSE 'DISAGREE' END AS Label FROM votes GROUP BY ALL"""


@query(WITH + f""", u AS ({_UNANIMOUS}) SELECT QA_Type, Batch, Root_ID, count(*) AS N_Criteria, round(count(*) FILTER (Label = 'Yes') / count(*), 6) AS Pass_Frac,
 CASE WHEN count(*) FILTER (Label IN ('DISAGREE', 'Undecided')) / count(*) > 0.34 THEN 'DISAGREE' WHEN count(*) FILTER (Label = 'Yes') / count(*) >= 0.75 THEN 'PASS' ELSE 'FAIL' END AS Verdict
 FROM u GROUP BY QA_Type, Batch, Root_ID""")
def panel_unanimous(spark, sf_dir):
    q = panel.question_scores(panel.unanimous_label(votes(spark, sf_dir)), label="Label")
    return q.select(*panel.QUESTION, "N_Criteria", F.round("Pass_Frac", 6).alias("Pass_Frac"), "Verdict")


@query(WITH + f""", u AS (SELECT *, CASE Verdict WHEN 'Unsure' THEN 'Undecided' ELSE Verdict END AS Label FROM votes)
 SELECT Judge, QA_Type, Batch, Root_ID, count(*) AS N_Criteria, round(count(*) FILTER (Label = 'Yes') / count(*), 6) AS Pass_Frac,
 CASE WHEN count(*) FILTER (Label = 'Undecided') / count(*) > 0.34 THEN 'DISAGREE' WHEN count(*) FILTER (Label = 'Yes') / count(*) >= 0.75 THEN 'PASS' ELSE 'FAIL' END AS Verdict
 FROM u GROUP BY Judge, QA_Type, Batch, Root_ID""")
def panel_single_judge(spark, sf_dir):
    own = votes(spark, sf_dir).withColumn("Label", F.when(F.col("Verdict") == "Unsure", "Undecided").otherwise(F.col("Verdict")))
    q = panel.question_scores(own, key=["Judge", *panel.QUESTION], label="Label")
    return q.select("Judge", *panel.QUESTION, "N_Criteria", F.round("Pass_Frac", 6).alias("Pass_Frac"), "Verdict")


@query(WITH + """, w AS (SELECT QA_Type, Batch, Root_ID, Criterion_No, max(Verdict) FILTER (Judge = 'j1') AS j1, max(Verdict) FILTER (Judge = 'j2') AS j2 FROM votes GROUP BY ALL)
 SELECT QA_Type, j1, j2, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY QA_Type, j1), 6) AS row_pct,
 round(sum(sum(CASE WHEN j1 = j2 THEN 1 ELSE 0 END)) OVER (PARTITION BY QA_Type) / sum(count(*)) OVER (PARTITION BY QA_Type), 6) AS agreement FROM w GROUP BY QA_Type, j1, j2""")
def panel_agreement(spark, sf_dir):
    """Judges side by side: a crosstab with row shares and the rate at which they agree."""
    wide = votes(spark, sf_dir).groupBy(*panel.CRITERION).pivot("Judge", ["j1", "j2"]).agg(F.max("Verdict"))
    cell = wide.groupBy("QA_Type", "j1", "j2").agg(F.count(F.lit(1)).alias("n"))
    row, all_ = W.partitionBy("QA_Type", "j1"), W.partitionBy("QA_Type")
    same = F.sum(F.when(F.col("j1") == F.col("j2"), F.col("n")).otherwise(0)).over(all_) / F.sum("n").over(all_)
    return cell.select("QA_Type", "j1", "j2", "n", F.round(100.0 * F.col("n") / F.sum("n").over(row), 6).alias("row_pct"), F.round(same, 6).alias("agreement"))


@query(WITH + """SELECT QA_Type, Batch, Root_ID, Verdict AS poll, CASE WHEN No_Majority_Frac >= 0.34 THEN 'NOCON' WHEN Pass_Frac >= 0.75 THEN 'PASS' ELSE 'FAIL' END AS gate,
 CASE WHEN Pass_Frac >= 0.75 - 1e-9 THEN 'PASS' ELSE 'FAIL' END AS coverage FROM poll""")
def verdict_presets(spark, sf_dir):
    """The three definitions of PASS that live side by side."""
    q = _quest(spark, sf_dir)
    each = [panel.verdict(F.col("Pass_Frac"), F.col("No_Majority_Frac"), p).alias(n) for n, p in panel.PRESETS.items()]
    return q.select(*panel.QUESTION, *each)


FRACS = ["0.50", "0.55", "0.60", "0.65", "0.70", "0.75", "0.80", "0.85", "0.90", "0.95", "1.00"]
_MODE = """SELECT '{m}' AS unsure_mode, QA_Type, Batch, Root_ID, count(*) FILTER (Consensus = 'Yes') / count(*) AS pf, count(*) FILTER (Consensus IN ('DISAGREE', 'Undecided')) / count(*) AS nm FROM (
 SELECT QA_Type, Batch, Root_ID, Criterion_No, CASE WHEN count(s) = 0 THEN 'Undecided' WHEN count(*) FILTER (s >= .75) > count(*) FILTER (s <= .25) THEN 'Yes'
 WHEN count(*) FILTER (s <= .25) > count(*) FILTER (s >= .75) THEN 'No' ELSE 'DISAGREE' END AS Consensus
 FROM (SELECT *, CASE Verdict WHEN 'Yes' THEN 1.0 WHEN 'No' THEN 0.0 ELSE {x} END AS s FROM votes) GROUP BY ALL) GROUP BY QA_Type, Batch, Root_ID"""
_MODES = " UNION ALL ".join(_MODE.format(m=m, x=x) for m, x in (("exclude", "NULL"), ("zero", "0.0"), ("half", "0.5")))


@query(f"""WITH {VOTES_SQL}, m AS ({_MODES}), g AS (SELECT unnest([{', '.join(FRACS)}])::DOUBLE AS pass_frac)
 SELECT unsure_mode, pass_frac, QA_Type, count(*) AS n, count(*) FILTER (NOT nm > 0.34 AND pf >= pass_frac) AS n_pass, count(*) FILTER (nm > 0.34) AS n_disagree FROM m, g GROUP BY ALL""")
def threshold_grid(spark, sf_dir):
    return panel.threshold_grid(votes(spark, sf_dir), FRACS)


@query(WITH + """, kept AS (SELECT p.*, Batch AS b FROM poll p JOIN orders ON o_orderkey = Root_ID WHERE o_orderstatus <> 'P' AND Seed_Type IN ('reg', 'dynamic_reg')),
 per AS (SELECT b AS Batch, count(DISTINCT Root_ID) AS n_pass FROM kept WHERE Pass_Frac >= 0.75 - 1e-9 GROUP BY b)
 SELECT Batch, n_pass, CAST(sum(n_pass) OVER (ORDER BY Batch) AS BIGINT) AS cumulative FROM per""")
def pass_count_survivors(spark, sf_dir):
    """PASS questions of the reg track among surviving rows, running over batches (a handful of rows by then)."""
    alive = load(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("Root_ID"))
    q = _quest(spark, sf_dir, "coverage").where((track(F.col("Seed_Type")) == "reg") & (F.col("Verdict") == "PASS"))
    per = q.join(alive, "Root_ID", "left_semi").groupBy("Batch").agg(F.count_distinct("Root_ID").alias("n_pass"))
    return per.withColumn("cumulative", F.sum("n_pass").over(W.orderBy("Batch").rowsBetween(W.unboundedPreceding, 0)))


@query(WITH + "SELECT Verdict, count(*) AS n_votes, count(DISTINCT Judge) AS n_judges, count(DISTINCT Root_ID) AS n_roots FROM votes GROUP BY Verdict")
def vote_counts(spark, sf_dir):
    return votes(spark, sf_dir).groupBy("Verdict").agg(F.count(F.lit(1)).alias("n_votes"), F.count_distinct("Judge").alias("n_judges"), F.count_distinct("Root_ID").alias("n_roots"))


@query(WITH + """SELECT Criterion_No, count(*) AS n, round(count(*) FILTER (Consensus = 'No') / count(*), 6) AS fail_rate,
 round(count(*) FILTER (Consensus = 'DISAGREE') / count(*), 6) AS disagree_rate FROM cons GROUP BY Criterion_No""")
def position_rates(spark, sf_dir):
    c = F.col("Consensus")
    n = F.count(F.lit(1))
    return _crit(spark, sf_dir).groupBy("Criterion_No").agg(n.alias("n"), F.round(F.count_if(c == "No") / n, 6).alias("fail_rate"), F.round(F.count_if(c == "DISAGREE") / n, 6).alias("disagree_rate"))


@query(WITH + """, f AS (SELECT QA_Type, Seed_Type, count(*) AS n_scored, count(*) FILTER (Consensus = 'No') / count(*) AS fail FROM cons WHERE Consensus IN ('Yes', 'No') GROUP BY ALL),
 d AS (SELECT QA_Type, Seed_Type, count(*) AS n_split FROM cons WHERE Consensus = 'DISAGREE' GROUP BY ALL)
 SELECT QA_Type, Seed_Type, n_scored, round(fail, 6) AS fail_rate, coalesce(n_split, 0) AS n_split FROM f FULL JOIN d USING (QA_Type, Seed_Type)""")
def join_full_outer_rates(spark, sf_dir):
    c = _crit(spark, sf_dir)
    key = ["QA_Type", "Seed_Type"]
    fail = c.where("Consensus in ('Yes', 'No')").groupBy(*key).agg(F.count(F.lit(1)).alias("n_scored"), F.round(F.avg((F.col("Consensus") == "No").cast("double")), 6).alias("fail_rate"))
    split = c.where("Consensus = 'DISAGREE'").groupBy(*key).agg(F.count(F.lit(1)).alias("n_split"))
    return fail.join(split, key, "full").withColumn("n_split", F.coalesce("n_split", F.lit(0)))


@query("""SELECT l_orderkey AS Root_ID, l_linenumber AS Criterion_No, count(*) AS n, min(l_suppkey) AS least, max(l_suppkey) AS most, count(DISTINCT l_returnflag) > 1 AS conflicting
 FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def dedup_conflicts(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    many = li.groupBy(F.col("l_orderkey").alias("Root_ID"), F.col("l_linenumber").alias("Criterion_No")).agg(F.count(F.lit(1)).alias("n"), F.min("l_suppkey").alias("least"), F.max("l_suppkey").alias("most"), (F.count_distinct("l_returnflag") > 1).alias("conflicting"))
    return many.where("n > 1")


@query(WITH + """, x AS (SELECT Judge, QA_Type, round(avg(CASE Verdict WHEN 'Yes' THEN 1.0 WHEN 'No' THEN 0.0 END), 6) AS accept, round(avg(CASE WHEN Verdict = 'Unsure' THEN 1.0 ELSE 0.0 END), 6) AS unsure FROM votes GROUP BY ALL)
 SELECT QA_Type, max(accept) FILTER (Judge = 'j1') AS j1_accept, max(accept) FILTER (Judge = 'j2') AS j2_accept, round(100 * (max(accept) FILTER (Judge = 'j1') - max(accept) FILTER (Judge = 'j2')), 4) AS gap_pp,
 max(unsure) FILTER (Judge = 'j1') AS j1_unsure, max(unsure) FILTER (Judge = 'j2') AS j2_unsure FROM x GROUP BY QA_Type""")
def judge_gap(spark, sf_dir):
    """Acceptance by judge, pivoted, and the gap in percentage points."""
    s = panel.vote_score(F.col("Verdict"))
    x = votes(spark, sf_dir).groupBy("QA_Type").pivot("Judge", ["j1", "j2"]).agg(F.round(F.avg(s), 6).alias("accept"), F.round(F.avg((F.col("Verdict") == "Unsure").cast("double")), 6).alias("unsure"))
    return x.select("QA_Type", "j1_accept", "j2_accept", F.round(100 * (F.col("j1_accept") - F.col("j2_accept")), 4).alias("gap_pp"), "j1_unsure", "j2_unsure")


@query(WITH + """, f AS (SELECT Judge, Root_ID, QA_Type, Batch, avg(CASE Verdict WHEN 'Yes' THEN 1.0 WHEN 'No' THEN 0.0 END) AS a FROM votes GROUP BY ALL),
 w AS (SELECT QA_Type, Batch, Root_ID, max(a) FILTER (Judge = 'j1') - max(a) FILTER (Judge = 'j2') AS d FROM f GROUP BY ALL)
 SELECT CASE WHEN grouping(QA_Type) = 1 THEN 'pooled' ELSE QA_Type END AS QA_Type, count(d) AS n, round(100 * avg(d), 6) AS mean_pp, round(100 * median(d), 6) AS median_pp,
 count(*) FILTER (d <> 0) AS n_nonzero, count(*) FILTER (d < 0) AS n_negative FROM w GROUP BY GROUPING SETS ((QA_Type), ())""")
def question_differences(spark, sf_dir):
    """Paired differences of two judges' acceptance on each question, by type and pooled."""
    s = panel.vote_score(F.col("Verdict"))
    w = votes(spark, sf_dir).groupBy(*panel.QUESTION).pivot("Judge", ["j1", "j2"]).agg(F.avg(s)).withColumn("d", F.col("j1") - F.col("j2"))
    agg = [F.count("d").alias("n"), F.round(100 * F.avg("d"), 6).alias("mean_pp"), F.round(100 * F.median("d"), 6).alias("median_pp"), F.count_if(F.col("d") != 0).alias("n_nonzero"), F.count_if(F.col("d") < 0).alias("n_negative")]
    return w.rollup("QA_Type").agg(*agg).withColumn("QA_Type", F.coalesce("QA_Type", F.lit("pooled")))
