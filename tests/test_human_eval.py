"""The rating set: ten cases over a small corpus of known verdicts."""

import json

import pytest
from pyspark.sql import functions as F

from qaloom.operators import human_eval as H
from qaloom.operators.guards import RelationError

COUNTS = {"PASS": 20, "FAIL": 15, "DISAGREE": 18}
PATTERN = {"PASS": [("Yes", "Yes")] * 8 + [("No", "No")], "FAIL": [("Yes", "Yes")] * 4 + [("No", "No")] * 5, "DISAGREE": [("Yes", "No")] * 4 + [("Yes", "Yes")] * 5}
PLAN = H.Plan({"PASS": 12, "FAIL": 8, "DISAGREE": 10}, 30)


def relations(spark, counts=COUNTS, qa_type="type2", twice=False, docs='["d1","d2"]', shapes=False):
    votes, corpus, root = [], [], 0
    for verdict, n in [*counts.items(), ("generic", 6)]:
        for i in range(n):
            root += 1
            seed = "generic" if verdict == "generic" else ["reg", "dynamic_reg"][i % 2]
            corpus.append((f"b{i % 2}", root, 1, qa_type, seed, f"q{root}", "a", docs, f"qid{root}", "clause\nof two lines"))
            for c, pair in enumerate(PATTERN["PASS" if verdict == "generic" else verdict], 1):
                votes += [(f"b{i % 2}", root, 1, "type2", seed, f"j{k}", c, v) for k, v in enumerate(pair)]
    if twice:
        votes.append(votes[0])
    baseline = []
    for i in range(40):
        n = i % 4 + 1 if shapes else 2
        listed = json.dumps([f"d{k}" for k in range(n)])
        baseline.append((i, 1, f"bq{i}", "a", json.dumps(listed) if i % 3 == 0 else listed, json.dumps({str(k): ["p"] for k in range(n)})))
    return (
        spark.createDataFrame(votes, "Batch string, Root_ID long, Question_No int, QA_Type string, Seed_Type string, Judge string, Criterion_No int, Verdict string"),
        spark.createDataFrame(corpus, "Batch string, Root_ID long, Question_No int, QA_Type string, Seed_Type string, Question string, Answer string, Rel_Docs_List string, QID string, Reg_Text string"),
        spark.createDataFrame(baseline, "Root_ID long, Question_No int, Question string, Answer string, Rel_Docs_List string, Doc_Ans_Points string"),
    )


@pytest.fixture(scope="module")
def built(spark):
    return H.build(*relations(spark), PLAN)


def test_sixty_items(built):
    items, key, form = built
    rows = key.collect()
    assert sorted(r.Item_ID for r in rows) == [f"I{i:03d}" for i in range(1, 61)]
    of = lambda v: sum(r.Verdict == v for r in rows)
    assert (of("PASS"), of("FAIL"), of("DISAGREE"), sum(r.Frame == "baseline" for r in rows)) == (12, 8, 10, 30)
    assert {r.Seed_Type for r in rows} == {"reg", "dynamic_reg", None} and set(key.columns) == set(H.KEY)
    assert {r.Clause_Governs for r in form.collect()} == {"", "n/a"}
    assert set(H.shown(items).columns) == set(H.SHOWN)


def test_a_seed_draws_alike_and_another_doesn_t(spark, built):
    chosen = lambda key: {(r.Item_ID, r.Frame, r.Root_ID) for r in key.collect()}
    assert chosen(H.build(*(df.repartition(3) for df in relations(spark)), PLAN)[1]) == chosen(built[1])
    assert chosen(H.build(*relations(spark), H.Plan(PLAN.strata, 30, seed=1))[1]) != chosen(built[1])


@pytest.mark.parametrize(
    ("how", "plan", "exists", "says"),
    [({}, PLAN, True, "exists"), ({"counts": {"PASS": 20, "FAIL": 15, "DISAGREE": 6}}, PLAN, False, "too small"), ({"qa_type": "type1"}, PLAN, False, "not of type2"), ({"docs": '{"a": 1}'}, PLAN, False, "list of documents"),
     ({"twice": True}, PLAN, False, "repeats"), ({}, H.Plan(PLAN.strata, 30, expected={"PASS": 21}), False, "expected"), ({}, H.Plan(PLAN.strata, 41), False, "fewer than 41")],
)
def test_broken_relations_stop_it(spark, how, plan, exists, says):
    with pytest.raises(RelationError, match=says):
        H.build(*relations(spark, **how), plan, exists)


def test_baseline_by_number_of_documents(spark):
    _, key, _ = H.build(*relations(spark, shapes=True), PLAN)
    rows = key.where("Frame = 'baseline'").collect()
    n = sorted(sum(r.N_Docs == k for r in rows) for k in (1, 2, 3, 4))
    assert n == [7, 7, 8, 8] and all(r.N_Docs == r.N_Ans_Points for r in rows)


def test_inline_marks(built):
    marks = [r.Question for r in H.shown(built[0], inline=True).collect()]
    assert len(marks) == 60 and sum("applicable: yes" in m for m in marks) == 30 and sum("applicable: no" in m for m in marks) == 30


def test_ratings(spark, built):
    _, key, form = built
    good = form.withColumn("Answer_Correct", F.lit("Yes")).withColumn("Clause_Governs", F.when(F.col("Clause_Governs") == "", "no").otherwise("n/a")).withColumn("Traces_To_Source", F.when(F.col("Traces_To_Source") == "", "1").otherwise("NA")).withColumn("Reason", F.lit("because"))
    rows = H.joined(good, key)
    assert {r.Frame: (r.n, r.correct) for r in H.correct_by(rows, "Frame").collect()} == {"corpus": (30, 30), "baseline": (30, 30)}
    assert {r.Verdict: (r.n, r.governs, r.traces) for r in H.grounding_by_verdict(rows).collect()} == {None: (30, 0, 30), "PASS": (12, 0, 12), "FAIL": (8, 0, 8), "DISAGREE": (10, 0, 10)}
    assert H.failures(rows).count() == 30
    for broken, says in ((good.withColumn("Reason", F.lit(" ")), "without a reason"), (good.withColumn("Answer_Correct", F.lit("maybe")), "doesn't allow"), (good.limit(59), "not rated"), (good.union(good.limit(1)), "repeats"),
                         (good.withColumn("Clause_Governs", F.lit("n/a")), "n/a though"), (good.withColumn("Clause_Governs", F.lit("yes")), "no clause"), (good.union(good.limit(1).withColumn("Item_ID", F.lit("I999"))), "not in the key")):
        with pytest.raises(RelationError, match=says):
            H.joined(broken, key)
