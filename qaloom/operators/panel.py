"""Judge panels: votes to criterion consensus to question verdicts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUESTION = ["QA_Type", "Batch", "Root_ID"]
CRITERION = [*QUESTION, "Criterion_No"]
MODES = ("exclude", "zero", "half")


def vote_score(vote: Column, unsure: str = "exclude") -> Column:
    """Yes 1, No 0; anything else 0 ("zero"), 0.5 ("half") or no score ("exclude")."""
    other = {"zero": F.lit(0.0), "half": F.lit(0.5), "exclude": F.lit(None).cast("double")}[unsure]
    return F.when(vote == "Yes", 1.0).when(vote == "No", 0.0).otherwise(other)


def _label(yes: Column, no: Column, scored: Column) -> Column:
    return F.when(scored == 0, "Undecided").when(yes > no, "Yes").when(no > yes, "No").otherwise("DISAGREE")


def consensus(votes: DataFrame, unsure: str = "exclude", key: list[str] = CRITERION) -> DataFrame:
    """One row a criterion: Consensus (Yes, No, DISAGREE, Undecided), Mean_Score, N_Judges, Non_Unanimous."""
    s = vote_score(F.col("Verdict"), unsure)
    yes, no, n = F.count_if(s >= 0.75), F.count_if(s <= 0.25), F.count(s)
    counted = votes.groupBy(*key).agg(yes.alias("y"), no.alias("n"), n.alias("v"), F.avg(s).alias("Mean_Score"), F.count(F.lit(1)).alias("N_Judges"))
    split = (F.col("v") == 0) | ~((F.col("y") == F.col("v")) | (F.col("n") == F.col("v")))
    return counted.select(*key, _label(F.col("y"), F.col("n"), F.col("v")).alias("Consensus"), "Mean_Score", "N_Judges", split.alias("Non_Unanimous"))


def unanimous_label(votes: DataFrame, key: list[str] = CRITERION) -> DataFrame:
    """Label: the verdict that all judges but the unsure ones share, else DISAGREE; Undecided without any."""
    yes, no = F.count_if(F.col("Verdict") == "Yes"), F.count_if(F.col("Verdict") == "No")
    counted = votes.groupBy(*key).agg(yes.alias("y"), no.alias("n"))
    label = F.when((F.col("y") == 0) & (F.col("n") == 0), "Undecided").when(F.col("n") == 0, "Yes").when(F.col("y") == 0, "No").otherwise("DISAGREE")
    return counted.select(*key, label.alias("Label"))


@dataclass(frozen=True)
class Preset:
    """Which question passes.  order: which of the two rules wins; strict: whether the share without majority must exceed
    its threshold; slack: what a pass may fall short by; blocks: whether a lack of majority keeps a question from passing."""

    pass_frac: float = 0.75
    no_majority: float = 0.34
    strict: bool = True
    slack: float = 0.0
    blocks: bool = True
    name: str = "DISAGREE"


PRESETS = {
    "poll": Preset(),
    "gate": Preset(strict=False, name="NOCON"),
    "coverage": Preset(slack=1e-9, blocks=False),
}


def verdict(pass_frac: Column, no_majority: Column, p: Preset = PRESETS["poll"]) -> Column:
    passes = F.when(pass_frac >= p.pass_frac - p.slack, "PASS").otherwise("FAIL")
    if not p.blocks:
        return passes
    lacks = no_majority > p.no_majority if p.strict else no_majority >= p.no_majority
    return F.when(lacks, p.name).otherwise(passes)


def question_scores(criteria: DataFrame, preset: Preset = PRESETS["poll"], key: list[str] = QUESTION, label: str = "Consensus") -> DataFrame:
    """N_Criteria, N_Pass, Pass_Frac, No_Majority_Frac, Disagreement_Rate, Mean_Score, Verdict; fractions are not rounded."""
    c = F.col(label)
    agg = [F.count(F.lit(1)).alias("N_Criteria"), F.count_if(c == "Yes").alias("N_Pass"), F.count_if(c.isin("DISAGREE", "Undecided")).alias("nm")]
    agg += [F.count_if("Non_Unanimous").alias("nu")] if "Non_Unanimous" in criteria.columns else [F.lit(None).cast("long").alias("nu")]
    agg += [F.avg("Mean_Score").alias("Mean_Score")] if "Mean_Score" in criteria.columns else [F.lit(None).cast("double").alias("Mean_Score")]
    got = criteria.groupBy(*key).agg(*agg)
    of = lambda x: F.col(x) / F.col("N_Criteria")
    got = got.withColumn("Pass_Frac", of("N_Pass")).withColumn("No_Majority_Frac", of("nm")).withColumn("Disagreement_Rate", of("nu"))
    return got.drop("nm", "nu").withColumn("Verdict", verdict(F.col("Pass_Frac"), F.col("No_Majority_Frac"), preset))


def summary_sets(scores: DataFrame, sets: list[str]) -> DataFrame:
    """Counts and means overall and by each column of `sets`, in one pass; level names the grouping."""
    level = reduce(lambda a, s: F.when(F.grouping(s) == 0, s).otherwise(a), sets, F.lit("all"))
    counts = [F.count_if(F.col("Verdict") == v).alias(f"n_{v.lower()}") for v in ("PASS", "FAIL", "DISAGREE")]
    agg = [level.alias("level"), F.count(F.lit(1)).alias("n"), *counts, F.avg("Pass_Frac").alias("mean_pass_frac"), F.avg("Disagreement_Rate").alias("mean_disagreement")]
    return scores.groupingSets([[s] for s in sets] + [[]], *sets).agg(*agg).select("level", *sets, "n", "n_pass", "n_fail", "n_disagree", "mean_pass_frac", "mean_disagreement")


def mode_fractions(votes: DataFrame, key: list[str] = QUESTION) -> DataFrame:
    """unsure_mode, key, Pass_Frac, No_Majority_Frac: what every mode makes of the votes, in one pass over them."""
    n = {v: F.count_if(F.col("Verdict") == v) for v in ("Yes", "No")}
    counted = votes.groupBy(*key, "Criterion_No").agg(n["Yes"].alias("y"), n["No"].alias("n"), F.count(F.lit(1)).alias("v"))
    y, no, v = F.col("y"), F.col("n"), F.col("v")
    label = {"exclude": _label(y, no, y + no), "zero": _label(y, v - y, v), "half": _label(y, no, v)}
    marks = [c for m, x in label.items() for c in (F.count_if(x == "Yes").alias(f"p_{m}"), F.count_if(x.isin("DISAGREE", "Undecided")).alias(f"l_{m}"))]
    got = counted.groupBy(*key).agg(F.count(F.lit(1)).alias("of"), *marks)
    each = F.array(*(F.struct(F.lit(m).alias("unsure_mode"), (F.col(f"p_{m}") / F.col("of")).alias("Pass_Frac"), (F.col(f"l_{m}") / F.col("of")).alias("No_Majority_Frac")) for m in label))
    return got.select(*key, F.explode(each).alias("x")).select("x.unsure_mode", *key, "x.Pass_Frac", "x.No_Majority_Frac")


def threshold_grid(votes: DataFrame, fracs: list[str], no_majority: float = 0.34) -> DataFrame:
    """unsure_mode, pass_frac, QA_Type, n, n_pass, n_disagree: one aggregation for all modes, then a fixed grid against the
    few distinct pairs of fractions."""
    hist = mode_fractions(votes).groupBy("unsure_mode", "QA_Type", F.col("Pass_Frac").alias("share"), "No_Majority_Frac").agg(F.count(F.lit(1)).alias("c"))
    lacks = F.col("No_Majority_Frac") > no_majority
    each = hist.withColumn("pass_frac", F.explode(F.array(*(F.lit(f).cast("double") for f in fracs))))
    sums = lambda x, n: F.sum(F.when(x, F.col("c")).otherwise(0)).alias(n)
    return each.groupBy("unsure_mode", F.col("pass_frac"), "QA_Type").agg(F.sum("c").alias("n"), sums(~lacks & (F.col("share") >= F.col("pass_frac")), "n_pass"), sums(lacks, "n_disagree"))
