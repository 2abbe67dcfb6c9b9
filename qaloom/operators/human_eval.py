"""A rating set for people: a stratified blind sample with its key, and the analysis of the ratings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions import text as X
from qaloom.functions.keys import py_strip
from qaloom.operators import guards, panel, sampling
from qaloom.operators.guards import RelationError
from qaloom.tables import written

QUESTION = ["Batch", "Root_ID", "Question_No"]
KEY = ["Item_ID", "Frame", "Grounding_Applicable", *QUESTION, "QID", "Verdict", "Pass_Frac", "No_Majority_Frac", "N_Criteria", "Seed_Type", "N_Docs", "N_Ans_Points"]
SHOWN = ["Item_ID", "Question", "Answer", "Documents", "Reg_Text"]
REG = ("reg", "dynamic_reg")
VERDICTS = ("PASS", "FAIL", "DISAGREE")
#: Rating fields, what each judges, and whether it applies to items without a clause.
FIELDS = {"Answer_Correct": ("correctness", True), "Clause_Governs": ("clause governance", False), "Traces_To_Source": ("grounding", False)}


@dataclass(frozen=True)
class Plan:
    """How many items of each verdict and of the baseline; expected: counts of verdicts that the corpus must have."""

    strata: dict[str, int]
    baseline: int
    seed: int = 20260816
    qa_type: str = "type2"
    expected: dict[str, int] = field(default_factory=dict)


def documents(text: Column) -> Column:
    """A stored list of documents, encoded up to four times over; null if it is no filled list of texts."""
    return F.when(F.size(X.decoded_json_list(text)) > 0, X.decoded_json_list(text))


def _none(df: DataFrame, message: str) -> None:
    if bad := df.take(1):
        raise RelationError(f"{message}: {bad[0].asDict()}")


def panel_verdicts(votes: DataFrame) -> DataFrame:
    """Verdicts by unanimity of the judges that aren't unsure; a vote may stand once only."""
    key = [*QUESTION, "Criterion_No"]
    guards.require_unique(votes, [*key, "Judge"])
    labels = panel.unanimous_label(votes.withColumn("Verdict", F.initcap(py_strip("Verdict"))), key)
    scores = panel.question_scores(labels, key=QUESTION, label="Label")
    kinds = votes.groupBy(*QUESTION).agg(F.max("Seed_Type").alias("Seed_Type"), F.max("QA_Type").alias("QA_Type"))
    return scores.join(kinds, QUESTION).select(*QUESTION, "QA_Type", "Seed_Type", "N_Criteria", F.round("Pass_Frac", 6).alias("Pass_Frac"), F.round("No_Majority_Frac", 6).alias("No_Majority_Frac"), "Verdict")


def build(votes: DataFrame, corpus: DataFrame, baseline: DataFrame, plan: Plan, exists: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, key, ratings form).  Raises RelationError where a relation breaks its contract.

    votes: Batch, Root_ID, Question_No, QA_Type, Seed_Type, Judge, Criterion_No, Verdict; corpus: the key, QA_Type, Seed_Type,
    Question, Answer, Rel_Docs_List, QID, Reg_Text; baseline: Root_ID, Question_No, Question, Answer, Rel_Docs_List,
    Doc_Ans_Points.  exists: whether a key was drawn before (it must not be drawn again).  Samples are drawn by hash."""
    if exists:
        raise RelationError("a key exists already")
    for df, names in ((votes, [*QUESTION, "QA_Type", "Seed_Type", "Judge", "Criterion_No", "Verdict"]), (corpus, [*QUESTION, "QA_Type", "Seed_Type", "Question", "Answer", "Rel_Docs_List", "QID", "Reg_Text"]), (baseline, ["Root_ID", "Question_No", "Question", "Answer", "Rel_Docs_List", "Doc_Ans_Points"])):
        guards.require_columns(df, names)
    guards.require_unique(corpus, QUESTION)
    guards.require_unique(baseline, ["Root_ID", "Question_No"])
    judged = written(panel_verdicts(votes), "verdicts")
    _none(judged.join(corpus, QUESTION, "left_anti"), "judged, but not in the corpus")
    _none(corpus.join(judged, QUESTION, "left_anti").select(*QUESTION), "in the corpus, but not judged")
    own = corpus.select(*QUESTION, F.col("QA_Type").alias("_t"), F.col("Seed_Type").alias("_s"), "QID", "Question", "Answer", "Reg_Text", documents(F.col("Rel_Docs_List")).alias("Documents"))
    both = judged.join(own, QUESTION)
    _none(both.where((F.col("QA_Type") != plan.qa_type) | (F.col("_t") != plan.qa_type)).select(*QUESTION, "QA_Type", "_t"), f"not of {plan.qa_type}")
    reg = both.where(F.col("Seed_Type").isin(*REG))
    _none(reg.where(~F.col("_s").isin(*REG)).select(*QUESTION, "Seed_Type", "_s"), "seed types disagree")
    counts = {r[0]: r[1] for r in judged.where(F.col("Seed_Type").isin(*REG)).groupBy("Verdict").count().collect()}  # three verdicts
    if off := {v: counts.get(v, 0) for v, n in plan.expected.items() if counts.get(v, 0) != n}:
        raise RelationError(f"verdict counts {off}, expected {plan.expected}")
    sampling.require_sample(reg, "Verdict", plan.strata)
    ident = F.concat_ws("/", *QUESTION)
    wanted = F.create_map(*(F.lit(x) for v, n in plan.strata.items() for x in (v, n)))
    drawn = sampling.stratified(reg.withColumn("_id", ident), "Verdict", "_id", max(plan.strata.values()), plan.seed).where(F.col("nth") <= F.try_element_at(wanted, F.col("Verdict")))

    shaped = baseline.select("Root_ID", "Question_No", "Question", "Answer", documents(F.col("Rel_Docs_List")).alias("Documents"), F.size(F.json_object_keys("Doc_Ans_Points")).alias("N_Ans_Points"))
    _none(shaped.where("Documents is null or N_Ans_Points is null or size(Documents) <> N_Ans_Points").select("Root_ID", "Question_No", "N_Ans_Points"), "baseline points and documents don't agree")
    shaped = shaped.withColumn("N_Docs", F.size("Documents")).withColumn("_id", F.concat_ws("/", "Root_ID", "Question_No"))
    population = shaped.groupBy(F.col("N_Docs").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    if shaped.count() < plan.baseline:
        raise RelationError(f"the baseline has fewer than {plan.baseline} rows")
    shares = sampling.largest_remainder(population, plan.baseline).withColumnRenamed("stratum", "N_Docs")
    plain = sampling.proportional(shaped, shares, "N_Docs", "_id", plan.seed)

    text = lambda c: F.lit(None).cast("string").alias(c)
    first = drawn.select(
        F.lit("corpus").alias("Frame"), F.lit("yes").alias("Grounding_Applicable"), *(F.col(c).cast("string").alias(c) for c in QUESTION), "QID", "Verdict", "Pass_Frac", "No_Majority_Frac", "N_Criteria", "Seed_Type",
        F.size("Documents").alias("N_Docs"), F.lit(None).cast("int").alias("N_Ans_Points"), "Question", "Answer", "Documents", "Reg_Text", F.concat(F.lit("c/"), "_id").alias("_id"),
    )
    second = plain.select(
        F.lit("baseline").alias("Frame"), F.lit("no").alias("Grounding_Applicable"), text("Batch"), *(F.col(c).cast("string").alias(c) for c in QUESTION[1:]), text("QID"), text("Verdict"), F.lit(None).cast("double").alias("Pass_Frac"),
        F.lit(None).cast("double").alias("No_Majority_Frac"), F.lit(None).cast("long").alias("N_Criteria"), text("Seed_Type"), "N_Docs", "N_Ans_Points", "Question", "Answer", "Documents", F.lit("").alias("Reg_Text"), F.concat(F.lit("b/"), "_id").alias("_id"),
    )
    items = written(sampling.item_ids(first.unionByName(second), "_id", plan.seed), "items")
    _none(items.where("Documents is null").select("Item_ID"), "no filled list of documents")
    _none(items.where((F.col("Grounding_Applicable") == "yes") & (F.coalesce(py_strip("Reg_Text"), F.lit("")) == "")).select("Item_ID"), "no source clause")
    filler = F.when(F.col("Grounding_Applicable") == "yes", "").otherwise("n/a")
    form = items.select("Item_ID", F.lit("").alias("Answer_Correct"), filler.alias("Clause_Governs"), filler.alias("Traces_To_Source"), F.lit("").alias("Reason"))
    return items, items.select(*KEY), form


def shown(items: DataFrame, inline: bool = False) -> DataFrame:
    """What raters see; inline: whether the clause is to be judged stands above the question."""
    mark = F.concat(F.lit("[Judgement B applicable: "), F.col("Grounding_Applicable"), F.lit("]\n\n"), F.col("Question"))
    return sampling.blinded(items.withColumn("Question", mark) if inline else items, SHOWN)


def joined(ratings: DataFrame, key: DataFrame) -> DataFrame:
    """Ratings beside their items.  Raises RelationError for repeated or lacking items, ratings that the instrument doesn't
    allow, clause ratings where none applies (or n/a where one does), and a No without a reason."""
    for df in (ratings, key):
        guards.require_unique(df, ["Item_ID"])
    _none(ratings.join(key, "Item_ID", "left_anti").select("Item_ID"), "rated, but not in the key")
    _none(key.join(ratings, "Item_ID", "left_anti").select("Item_ID"), "in the key, but not rated")
    read = ratings.select("Item_ID", *(X.rating(F.col(f), not everywhere).alias(f) for f, (_, everywhere) in FIELDS.items()), F.coalesce(py_strip("Reason"), F.lit("")).alias("Reason"))
    both = written(key.select("Item_ID", "Frame", "Grounding_Applicable", "Verdict", "Seed_Type", "Root_ID", "Question_No", "Batch").join(read, "Item_ID"), "ratings")
    lacks = F.lit(False)
    for f in FIELDS:
        lacks |= F.col(f).isNull()
    _none(both.where(lacks), "a rating that the instrument doesn't allow")
    clause = [f for f, (_, everywhere) in FIELDS.items() if not everywhere]
    applies = F.col("Grounding_Applicable") == "yes"
    for f in clause:
        _none(both.where(applies & (F.col(f) == "n/a")), f"{f} is n/a though a clause is there")
        _none(both.where(~applies & (F.col(f) != "n/a")), f"{f} is rated though no clause is there")
    some_no = F.lit(False)
    for f in FIELDS:
        some_no |= F.col(f) == "no"
    _none(both.where(some_no & (F.col("Reason") == "")), "a No without a reason")
    return both


def correct_by(rows: DataFrame, column: str) -> DataFrame:
    """column, n, correct."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("Answer_Correct") == "yes").alias("correct"))


def grounding_by_verdict(rows: DataFrame) -> DataFrame:
    """Verdict (null: all), n, governs, traces over the items with a clause."""
    return rows.where("Grounding_Applicable = 'yes'").rollup("Verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("Clause_Governs") == "yes").alias("governs"), F.count_if(F.col("Traces_To_Source") == "yes").alias("traces"))


def failures(rows: DataFrame) -> DataFrame:
    """One row a failed judgement, with its reason."""
    named = F.array(*(F.struct(F.lit(name).alias("Judgement"), F.col(f).alias("r")) for f, (name, _) in FIELDS.items()))
    each = rows.select("Item_ID", "Frame", F.coalesce("Verdict", F.lit("n/a")).alias("Verdict"), "Reason", F.explode(named).alias("x"))
    return each.where("x.r = 'no'").select("Item_ID", "Frame", "Verdict", "x.Judgement", F.lit("yes").alias("Reported"), "Reason")
