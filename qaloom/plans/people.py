"""The rating set for people over derived votes, corpus and baseline; and verification with recorded replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaloom.operators import human_eval as H
from qaloom.operators import verification as V
from qaloom.plans.panels import WITH
from qaloom.plans.derived import votes
from qaloom.plans.registry import query
from qaloom.plans.replies import cat
from qaloom.tables import load

PLAN = H.Plan({"PASS": 12, "FAIL": 8, "DISAGREE": 10}, 30, 20260816, "type2")
_TAG = "'s' || CAST(20260816 AS VARCHAR)"


def _votes(spark, sf_dir):
    """Votes of the second type, a question of each root."""
    own = votes(spark, sf_dir).where("QA_Type = 'type2'").withColumn("Question_No", F.lit(1))
    return own.select("Batch", "Root_ID", "Question_No", "QA_Type", "Seed_Type", "Judge", "Criterion_No", "Verdict")


def _corpus(spark, sf_dir):
    q = _votes(spark, sf_dir).select("Batch", "Root_ID", "Question_No", "QA_Type", "Seed_Type").distinct()
    docs = F.concat(F.lit('["d'), F.col("Root_ID").cast("string"), F.lit('","e"]'))
    return q.select("*", cat("q", F.col("Root_ID")).alias("Question"), F.lit("a").alias("Answer"), docs.alias("Rel_Docs_List"), cat("qid", F.col("Root_ID")).alias("QID"), F.lit("clause").alias("Reg_Text"))


def _baseline(spark, sf_dir):
    """One to four documents a customer; every third list is encoded twice."""
    k = F.col("c_custkey")
    n = (k % 4 + 1).cast("int")
    docs = F.to_json(F.transform(F.sequence(F.lit(1), n), lambda i: cat("d", i)))
    points = F.to_json(F.map_from_entries(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.cast("string").alias("key"), F.array(F.lit("p")).alias("value")))))
    twice = F.concat(F.lit('"'), F.replace(docs, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return load(spark, sf_dir, "customer").select(k.alias("Root_ID"), F.lit(1).alias("Question_No"), F.col("c_name").alias("Question"), F.lit("a").alias("Answer"), F.when(k % 3 == 0, twice).otherwise(docs).alias("Rel_Docs_List"), points.alias("Doc_Ans_Points"))


_KEY = WITH.rstrip() + """, un AS (SELECT Batch, Root_ID, Seed_Type, Criterion_No, CASE count(DISTINCT CASE WHEN Verdict <> 'Unsure' THEN Verdict END) WHEN 0 THEN 'Undecided' WHEN 1 THEN min(CASE WHEN Verdict <> 'Unsure' THEN Verdict END) ELSE 'DISAGREE' END AS Label FROM votes WHERE QA_Type = 'type2' GROUP BY ALL),
 qs AS (SELECT Batch, Root_ID, any_value(Seed_Type) AS Seed_Type, count(*) AS N_Criteria, count(*) FILTER (Label = 'Yes') / count(*) AS pf, count(*) FILTER (Label IN ('DISAGREE', 'Undecided')) / count(*) AS nm FROM un GROUP BY Batch, Root_ID),
 v AS (SELECT *, CASE WHEN nm > 0.34 THEN 'DISAGREE' WHEN pf >= 0.75 THEN 'PASS' ELSE 'FAIL' END AS Verdict, 'c/' || Batch || '/' || Root_ID || '/1' AS id FROM qs WHERE Seed_Type IN ('reg', 'dynamic_reg')),
 d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Verdict ORDER BY sha1('20260816|' || substr(id, 3))) AS nth FROM v) WHERE nth <= CASE Verdict WHEN 'PASS' THEN 12 WHEN 'FAIL' THEN 8 ELSE 10 END),
 pop AS (SELECT c_custkey % 4 + 1 AS s, count(*) AS n FROM customer GROUP BY 1), sh AS (SELECT *, 30.0 * n / sum(n) OVER () AS e FROM pop),
 al AS (SELECT s, floor(e) + CASE WHEN row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, s) <= 30 - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS a FROM sh),
 b AS (SELECT * FROM (SELECT c_custkey AS Root_ID, c_custkey % 4 + 1 AS s, 'b/' || c_custkey || '/1' AS id, row_number() OVER (PARTITION BY c_custkey % 4 ORDER BY sha1('20260816|' || c_custkey || '/1')) AS nth FROM customer) JOIN al USING (s) WHERE nth <= a),
 items AS (SELECT 'corpus' AS Frame, Batch, CAST(Root_ID AS VARCHAR) AS Root_ID, Verdict, round(pf, 6) AS Pass_Frac, N_Criteria, 2 AS N_Docs, NULL AS N_Ans_Points, id FROM d UNION ALL SELECT 'baseline', NULL, CAST(Root_ID AS VARCHAR), NULL, NULL, NULL, s, s, id FROM b),
 kk AS (SELECT 'I' || lpad(CAST(row_number() OVER (ORDER BY sha1('20260816|' || id)) AS VARCHAR), 3, '0') AS Item_ID, * FROM items)"""


def _key(spark, sf_dir):
    return H.build(_votes(spark, sf_dir), _corpus(spark, sf_dir), _baseline(spark, sf_dir), PLAN)


@query(_KEY + " SELECT Item_ID, Frame, Batch, Root_ID, Verdict, Pass_Frac, N_Criteria, CAST(N_Docs AS INTEGER) AS N_Docs, CAST(N_Ans_Points AS INTEGER) AS N_Ans_Points FROM kk")
def human_eval_key(spark, sf_dir):
    """Sixty items: 12, 8 and 10 by verdict, 30 of the baseline by number of documents; shuffled by hash."""
    _, key, _ = _key(spark, sf_dir)
    return key.select("Item_ID", "Frame", "Batch", "Root_ID", "Verdict", "Pass_Frac", "N_Criteria", "N_Docs", "N_Ans_Points")


@query(_KEY + " SELECT Item_ID, CASE WHEN Frame = 'corpus' THEN '[Judgement B applicable: yes]' || chr(10) || chr(10) || 'q' || Root_ID ELSE '[Judgement B applicable: no]' || chr(10) || chr(10) || (SELECT c_name FROM customer WHERE CAST(c_custkey AS VARCHAR) = kk.Root_ID) END AS Question, N_Docs AS n_documents, CASE WHEN Frame = 'corpus' THEN '' ELSE 'n/a' END AS form FROM kk")
def human_eval_items(spark, sf_dir):
    """What raters see, with the marks inline, and their form."""
    items, _, form = _key(spark, sf_dir)
    seen = H.shown(items, inline=True)
    return seen.join(form, "Item_ID").select("Item_ID", "Question", F.size("Documents").cast("long").alias("n_documents"), F.col("Clause_Governs").alias("form"))


_RATED = _KEY + """, n AS (SELECT *, CAST(substr(Item_ID, 2) AS INTEGER) AS i FROM kk), r AS (SELECT *, CASE WHEN i % 7 = 0 THEN 'no' ELSE 'yes' END AS correct, CASE WHEN Frame = 'baseline' THEN 'n/a' WHEN i % 3 = 0 THEN 'no' ELSE 'yes' END AS governs, CASE WHEN Frame = 'baseline' THEN 'n/a' WHEN i % 5 = 0 THEN 'no' ELSE 'yes' END AS traces FROM n)"""


def _joined(spark, sf_dir):
    """Ratings by item number: every seventh answer wrong, every third clause beside the point, every fifth untraced."""
    _, key, form = _key(spark, sf_dir)
    i, clause = F.substring("Item_ID", 2, 9).cast("int"), F.col("Clause_Governs") == ""
    rated = form.select("Item_ID", F.when(i % 7 == 0, " N ").otherwise("Yes").alias("Answer_Correct"), F.when(~clause, "NA").when(i % 3 == 0, "0").otherwise("y").alias("Clause_Governs"), F.when(~clause, "n/a").when(i % 5 == 0, "false").otherwise("1").alias("Traces_To_Source"), cat("why ", i).alias("Reason"))
    return H.joined(rated, key)


@query(_RATED + " SELECT Item_ID, Frame, correct AS Answer_Correct, governs AS Clause_Governs, traces AS Traces_To_Source FROM r")
def ratings_join(spark, sf_dir):
    return _joined(spark, sf_dir).select("Item_ID", "Frame", *H.FIELDS)


@query(_RATED + " SELECT Frame, coalesce(Verdict, 'none') AS Verdict, count(*) AS n, count(*) FILTER (correct = 'yes') AS correct FROM r GROUP BY GROUPING SETS ((Frame), (Frame, Verdict)) HAVING NOT (Frame = 'baseline' AND grouping(Verdict) = 0)")
def ratings_counts(spark, sf_dir):
    """Correct answers by corpus, and of the judged one by verdict."""
    j = _joined(spark, sf_dir)
    by = H.correct_by(j, "Frame").select("Frame", F.lit("none").alias("Verdict"), "n", "correct")
    return by.union(H.correct_by(j.where("Frame = 'corpus'"), "Verdict").select(F.lit("corpus"), "Verdict", "n", "correct"))


@query(_RATED + " SELECT coalesce(Verdict, 'all') AS Verdict, count(*) AS n, count(*) FILTER (governs = 'yes') AS governs, count(*) FILTER (traces = 'yes') AS traces FROM r WHERE Frame = 'corpus' GROUP BY ROLLUP (Verdict)")
def grounding_counts(spark, sf_dir):
    return H.grounding_by_verdict(_joined(spark, sf_dir)).withColumn("Verdict", F.coalesce("Verdict", F.lit("all")))


@query(_RATED + """ SELECT Item_ID, coalesce(Verdict, 'n/a') AS Verdict, Judgement, 'why ' || i AS Reason FROM (SELECT Item_ID, Verdict, i, unnest(['correctness', 'clause governance', 'grounding']) AS Judgement, unnest([correct, governs, traces]) AS x FROM r) WHERE x = 'no'""")
def failure_rows(spark, sf_dir):
    return H.failures(_joined(spark, sf_dir)).select("Item_ID", "Verdict", "Judgement", "Reason")


@query(_RATED + """, g AS (SELECT Item_ID FROM r WHERE governs = 'no'), t AS (SELECT Item_ID FROM r WHERE traces = 'no') SELECT Item_ID, 'left' AS side FROM g WHERE Item_ID NOT IN (SELECT Item_ID FROM t) UNION ALL SELECT Item_ID, 'right' FROM t WHERE Item_ID NOT IN (SELECT Item_ID FROM g)""")
def failure_sets(spark, sf_dir):
    """Items that fail one of two judgements only."""
    from qaloom.operators.relations import except_both

    j = _joined(spark, sf_dir)
    return except_both(j.where("Clause_Governs = 'no'").select("Item_ID"), j.where("Traces_To_Source = 'no'").select("Item_ID"))


_S = "s AS (SELECT s_suppkey AS k, s_name AS name FROM supplier)"


def _questions(spark, sf_dir):
    """A question a supplier with two documents of a point each and one adversarial document."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    return load(spark, sf_dir, "supplier").select(
        k.alias("key"), cat("What of ", name).alias("question"), F.array(cat("doc ", k, " one"), cat("doc ", k, " two")).alias("docs"),
        F.array(F.array(cat("point ", k)), F.array(cat("other ", k))).alias("points"), F.array(F.array(cat("adv ", k))).alias("adversarial"),
    )


def _recorded(spark, sf_dir):
    """Replies by key: the first document holds further points (k % 2 = 0), and then an answer from it does too (k % 4 = 0); the second
    lacks its point (k % 3 = 0); the adversarial one is relevant (k % 5 = 0), and answers (k % 7 = 0)."""
    k, q = F.col("key"), F.col("question")
    base = _questions(spark, sf_dir).withColumn("d1", F.get("docs", F.lit(0))).withColumn("d2", F.get("docs", F.lit(1))).withColumn("p1", F.get(F.get("points", F.lit(0)), F.lit(0))).withColumn("p2", F.get(F.get("points", F.lit(1)), F.lit(0))).withColumn("adv", F.get(F.get("adversarial", F.lit(0)), F.lit(0)))
    d1, d2, p1, p2, adv = (F.col(c) for c in ("d1", "d2", "p1", "p2", "adv"))
    no, none = F.lit("False. Extra Points Mentioned: none"), F.lit("No relevant information found in this document.")
    cut1 = F.when(k % 2 == 0, F.concat(d1, F.lit(" cut"))).otherwise(d1)
    done1 = F.when(k % 4 == 0, F.concat(cut1, F.lit(" again"))).otherwise(cut1)
    cut_a = F.when(k % 5 == 0, F.concat(adv, F.lit(" cut"))).otherwise(adv)
    null = F.lit(None).cast("string")
    asked = [
        (V.prompt("extra", question=q, points=p1, doc=d1), F.when(k % 2 == 0, "True. Extra Points Mentioned: more").otherwise(no)), (V.prompt("extra", question=q, points=p2, doc=d2), no),
        (V.prompt("remove", question=q, points=p1, info=F.lit("more"), doc=d1), F.concat(d1, F.lit(" cut \n"))),
        (V.prompt("predict", question=q, doc=cut1), F.when(k % 4 == 0, F.lit("an answer")).otherwise(none)), (V.prompt("predict", question=q, doc=d2), none),
        (V.prompt("compare", question=q, points=p1, answer=F.lit("an answer")), F.lit("True. Extra Points Mentioned: beyond")),
        (V.prompt("remove", question=q, points=p1, info=F.lit("beyond"), doc=cut1), F.concat(cut1, F.lit(" again"))),
        (V.prompt("presence", question=q, point=p1, doc=done1), F.lit("True Explanation for Presence: x Relevance: True Explanation for Relevance: y")),
        (V.prompt("presence", question=q, point=p2, doc=d2), F.when(k % 3 == 0, F.lit("False Explanation for Presence: x Relevance: True Explanation for Relevance: y")).otherwise("True Explanation for Presence: x Relevance: True Explanation for Relevance: y")),
        (V.prompt("add", question=q, info=p2, doc=d2), F.concat(d2, F.lit(" with point"))),
        (V.prompt("extra_adv", question=q, doc=adv), F.when(k % 5 == 0, F.lit("True. Relevant Points: it")).otherwise("False. Relevant Points: no")),
        (V.prompt("remove", question=q, points=null, info=F.lit("it"), doc=adv), F.concat(adv, F.lit(" cut"))),
        (V.prompt("predict", question=q, doc=cut_a), F.when(k % 7 == 0, F.lit("some answer")).otherwise(none)),
        (V.prompt("remove", question=q, points=null, info=F.lit("some answer"), doc=cut_a), F.concat(cut_a, F.lit(" gone"))),
    ]
    each = F.explode(F.array(*(F.struct(p.alias("prompt"), r.alias("reply")) for p, r in asked)))
    return base.select(each.alias("x")).select("x.*").distinct()


@query(f"""WITH {_S} SELECT k AS key, 'doc ' || k || ' one' || CASE WHEN k % 2 = 0 THEN ' cut' ELSE '' END || CASE WHEN k % 4 = 0 THEN ' again' ELSE '' END AS d1, 'doc ' || k || ' two' || CASE WHEN k % 3 = 0 THEN ' with point' ELSE '' END AS d2,
 'adv ' || k || CASE WHEN k % 5 = 0 THEN ' cut' ELSE '' END || CASE WHEN k % 7 = 0 THEN ' gone' ELSE '' END AS adv FROM s""")
def verify_cascade(spark, sf_dir):
    """All passes over the documents of every question."""
    got = V.verified_documents(_questions(spark, sf_dir), _recorded(spark, sf_dir))
    return got.select("key", F.get("docs", F.lit(0)).alias("d1"), F.get("docs", F.lit(1)).alias("d2"), F.get(F.get("adversarial", F.lit(0)), F.lit(0)).alias("adv"))


def _groups(spark, sf_dir):
    """Groups of two siblings; the first has points x and y, the second z and a conclusion."""
    k = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(
        k.alias("ID"), F.col("s_name").alias("Persona"), F.array(cat("q1 ", k), cat("q2 ", k)).alias("Questions"), F.array(F.lit("- x\n- y"), F.lit("- z\n- Conclusion: c")).alias("Answers"), F.array(F.lit("i"), F.lit("j")).alias("Documents_Info"),
        F.array(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("z"), F.lit("Conclusion: c"))).alias("Ans_Points"), F.array(F.array(F.array(F.lit("x")), F.array(F.lit("y"))), F.array(F.array(F.lit("z")))).alias("Doc_Ans_Points"),
    )


def _crossed(spark, sf_dir):
    groups = _groups(spark, sf_dir)
    k, p = F.col("ID"), F.col("point")
    hit = ((p == "x") & (k % 2 == 0)) | ((p == "y") & (k % 6 == 0)) | ((p == "z") & (k % 3 == 0))
    recorded = V.cross_checks(groups).select("prompt", F.when(hit, "Relevance: True").otherwise("Relevance: False").alias("reply"))
    return V.cross_checked(groups, recorded)


@query(f"""WITH {_S} SELECT k AS ID, name AS Persona, CASE WHEN k % 6 = 0 THEN '' ELSE 'q1 ' || k END || CASE WHEN k % 3 = 0 THEN '' ELSE '|q2 ' || k END AS questions, CASE WHEN k % 2 = 0 THEN '- y' ELSE '- x' || chr(10) || '- y' END AS answer, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END AS n_docs,
 md5(CASE WHEN k % 2 = 0 THEN 'Document 1 Answer points assigned:' || chr(10) || '- y' ELSE 'Document 1 Answer points assigned:' || chr(10) || '- x' || chr(10) || chr(10) || 'Document 2 Answer points assigned:' || chr(10) || '- y' END) AS info FROM s WHERE k % 6 <> 0""")
def cross_check_cascade(spark, sf_dir):
    """Points that another question of the group wants go, with their documents and answer lines."""
    kept, _ = _crossed(spark, sf_dir)
    return kept.select("ID", "Persona", F.array_join("Questions", "|").alias("questions"), F.get("Answers", F.lit(0)).alias("answer"), F.size(F.get("Doc_Ans_Points", F.lit(0))).alias("n_docs"), F.md5(F.get("Documents_Info", F.lit(0))).alias("info"))


@query(f"""WITH {_S} SELECT k AS ID, 'all_pairs_removed' AS reason FROM s WHERE k % 6 = 0""")
def cross_check_removals(spark, sf_dir):
    _, removed = _crossed(spark, sf_dir)
    return removed.select("ID", F.col("Removed_Reason").alias("reason"))
