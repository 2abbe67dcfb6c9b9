"""Parsers of model replies over replies that are made of the driver's rows, so that what they must give is known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaloom.functions import responses as R
from qaloom.functions import sections as S
from qaloom.functions import text as X
from qaloom.operators import postprocess as P
from qaloom.operators import verification as V
from qaloom.plans.registry import query
from qaloom.tables import load

def K() -> Column:
    return F.col("k")



def cat(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def customers(spark, sf_dir):
    """k and name of every customer."""
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


def pick(of: int, cases: dict[int, Column], other: Column) -> Column:
    """A case by k modulo `of`."""
    out = other
    for r, c in cases.items():
        out = F.when(K() % of == r, c).otherwise(out)
    return out


_C = "c AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer)"


@query(f"""WITH {_C} SELECT k, CASE WHEN k % 7 = 6 THEN NULL ELSE 'What of ' || name || '?' END AS question, CASE WHEN k % 7 IN (2, 5) THEN NULL ELSE '- a' || k || chr(10) || '- b' || CASE WHEN k % 7 = 4 THEN chr(10) || 'Document 1: note' ELSE '' END END AS answer,
 CASE WHEN k % 7 = 5 THEN NULL WHEN k % 7 = 2 THEN 'Document 1: note' || chr(10) || '- a' || k WHEN k % 7 = 4 THEN 'Document 1: note' || chr(10) || 'Document 1 Title: T' || chr(10) || '- a' || k ELSE 'Document 1 Title: T' || chr(10) || '- a' || k END AS documents FROM c""")
def qa_replies(spark, sf_dir):
    """Question, answer and documents of replies; by k % 7 a reply breaks off, has its question on the next line or twice, a note
    before the documents, or no colon."""
    head, answer, docs = cat("What of ", F.col("name"), "?"), cat("Answer: - a", K(), "\n- b\n"), cat("Document 1 Title: T\n- a", K())
    plain = cat("Sure.\nQuestion: ", head, "\n", answer, docs)
    reply = pick(7, {
        1: cat("Question:\n", head, "\n", answer, docs), 2: cat("Question: ", head, "\n", answer, "Document 1: note\n- a", K()), 3: cat("Question: Question:\nQuestion: ", head, "\n", answer, docs),
        4: cat("Question: ", head, "\n", answer, "Document 1: note\n", docs), 5: cat("Question: ", head, "\nAnswer: - a"), 6: cat("Question ", head, "\n", answer, docs),
    }, plain)
    return customers(spark, sf_dir).select("k", R.qa_reply(reply).alias("x")).select("k", "x.*")


@query(f"""WITH {_C} SELECT k, CASE WHEN k % 4 IN (1, 2) THEN NULL ELSE 'Why ' || name END AS question, k % 4 IN (0, 3) AS kept FROM c""")
def adversarial_replies(spark, sf_dir):
    """Adversarial replies: a question that is empty (k % 4 = 1) or without a colon (2) lacks; one on the next line (3) counts."""
    rest = cat("\nAnswer: x\nDocument 1 Title: T\n- x")
    reply = pick(4, {1: cat("Question:\n  ", rest), 2: cat("Question", rest), 3: cat("Question: \n Why ", F.col("name"), " ", rest)}, cat("Question: Why ", F.col("name"), rest))
    x = customers(spark, sf_dir).select("k", R.qa_reply(reply, adversarial=True).alias("x"))
    return x.select("k", "x.question", (F.col("x.question").isNotNull() & F.col("x.answer").isNotNull() & F.col("x.documents").isNotNull()).alias("kept"))


@query(f"""WITH {_C} SELECT k, CASE k % 6 WHEN 3 THEN chr(34) || name WHEN 5 THEN '' ELSE name END AS bare FROM c""")
def quotes_stripped(spark, sf_dir):
    n = F.col("name")
    wrapped = pick(6, {0: cat('"', n, '"'), 1: cat(" “ '", n, "' ” "), 2: cat("'", n, "”"), 3: cat('"', n), 4: n, 5: cat("\"'\"'")}, n)
    return customers(spark, sf_dir).select("k", R.strip_quotes(wrapped).alias("bare"))


@query(f"""WITH {_C} SELECT k, CASE WHEN k % 3 = 2 THEN 'p' || k || '|q;in ' || k || ';last|Title: kept' ELSE 'p' || k || '|q;free|in ' || k || ';last|Title: kept' END AS docs FROM c""")
def document_points(spark, sf_dir):
    """Documents' points: repeated headings, a heading of two digits, inline points, titles, short lines, a heading with blanks alone."""
    info = cat("Document 1 Title: A\n- p", K(), "\n-\nab\n  - q\n", F.when(K() % 3 == 2, "").otherwise("Document 2 title: low\nfree\n"), "Document 2: in ", K(), "\nDocument 12:   \n- last\nTitle: kept")
    docs = R.document_points(info)
    return customers(spark, sf_dir).select("k", F.array_join(F.transform(docs, lambda d: F.array_join(d, "|")), ";").alias("docs"))


def _roots(spark, sf_dir):
    """Answers and documents of every customer: one point is lacking (k % 4 = 0), one asked for twice (k % 5 = 0), line breaks
    are literal (k % 7 = 0), texts are null (k % 11 = 0)."""
    answer = cat("- a", K(), "\n\n- b", K(), "\nc", F.when(K() % 5 == 0, cat("\n- a", K())).otherwise(""))
    info = cat("Document 1 Title: T\n- a", K(), "\nDocument 2: b", K(), "\n", F.when(K() % 4 == 0, "").otherwise("c more\nc\n"))
    lit = lambda x: F.when(K() % 11 == 0, None).when(K() % 7 == 0, X.escape_newlines(x)).otherwise(x)
    padded = F.replace(answer, F.lit("\nc"), F.lit("\nc long"))
    return customers(spark, sf_dir).select("k", lit(padded).alias("Answer"), lit(F.replace(info, F.lit("\nc\n"), F.lit("\nc long\n"))).alias("Documents_Info"))


@query(f"""WITH {_C} SELECT k, CASE WHEN k % 11 = 0 THEN 0 ELSE 3 + (k % 5 = 0)::INT END AS n_points, CASE WHEN k % 11 = 0 THEN 1 ELSE 2 END AS n_docs, CASE WHEN k % 11 = 0 THEN 'missing' WHEN k % 4 = 0 OR k % 5 = 0 THEN 'unmatched_points' END AS reason FROM c""")
def post_process_points(spark, sf_dir):
    return P.answer_points(_roots(spark, sf_dir)).select("k", F.size("Ans_Points").alias("n_points"), F.size("Doc_Ans_Points").alias("n_docs"), F.col("Reason").alias("reason"))


@query(f"""WITH {_C} SELECT k, CASE WHEN k % 11 = 0 THEN '' ELSE 'a' || k || '|b' || k || '|c long' || CASE WHEN k % 5 = 0 THEN '|a' || k ELSE '' END END AS points, CASE WHEN k % 11 = 0 THEN '' ELSE 'a' || k || ';' END AS docs, CASE WHEN k % 11 = 0 THEN 'missing' END AS reason FROM c""")
def post_process_type3(spark, sf_dir):
    """The type whose documents list bullets only and whose points need no match."""
    out = P.answer_points(_roots(spark, sf_dir), conclusions=True)
    return out.select("k", F.array_join("Ans_Points", "|").alias("points"), F.array_join(F.transform("Doc_Ans_Points", lambda d: F.array_join(d, "|")), ";").alias("docs"), F.col("Reason").alias("reason"))


def _siblings(spark, sf_dir):
    """A root and three adversarial siblings a customer: the first fails to match at k % 6 = 0, the second at k % 3 = 0, the third
    is empty at k % 4 = 0; no sibling at all at k % 13 = 0.  Answers end in a conclusion."""
    point = lambda i: cat(f"s{i} ", K())
    answer = lambda i: cat("- ", point(i), "\n- Conclusion: yes")
    info = lambda i, fails: cat("Document 1 Title: T\n- ", F.when(fails, "other").otherwise(point(i)), "\n- Conclusion: yes")
    many = lambda *x: F.when(K() % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(*x))
    return customers(spark, sf_dir).select(
        F.col("k").alias("ID"), cat("root ", F.col("name")).alias("Question"), answer(0).alias("Answer"), info(0, F.lit(False)).alias("Documents_Info"), F.array(point(0), F.lit("Conclusion: yes")).alias("Ans_Points"),
        F.array(F.array(point(0), F.lit("Conclusion: yes"))).alias("Doc_Ans_Points"), F.col("segment").alias("Persona"), many(*(cat(f"q{i} ", F.col("name")) for i in (1, 2, 3))).alias("Adv_Question"),
        many(answer(1), answer(2), F.when(K() % 4 == 0, " ").otherwise(answer(3))).alias("Adv_Answer"), many(info(1, K() % 6 == 0), info(2, K() % 3 == 0), info(3, F.lit(False))).alias("Adv_Documents_Info"), K().alias("k"),
    )


_LEFT = "list_filter([1, 2, 3], lambda i: NOT (i = 1 AND k % 6 = 0) AND NOT (i = 2 AND k % 3 = 0) AND NOT (i = 3 AND k % 4 = 0))"


@query(f"""WITH {_C}, x AS (SELECT *, {_LEFT} AS l FROM c WHERE k % 13 <> 0) SELECT k AS ID, segment AS Persona, 'root ' || name || list_aggregate(list_prepend('', list_transform(l, lambda i: '|q' || i || ' ' || name)), 'string_agg', '') AS questions,
 1 + len(l) AS n, 's0 ' || k || list_aggregate(list_prepend('', list_transform(l, lambda i: ';s' || i || ' ' || k)), 'string_agg', '') AS points FROM x WHERE len(l) > 0""")
def adversarial_flatten(spark, sf_dir):
    """Groups of a root and its matched siblings."""
    groups, _, _ = P.sibling_groups(_siblings(spark, sf_dir).drop("k"))
    return groups.select("ID", "Persona", F.array_join("Questions", "|").alias("questions"), F.size("Answers").alias("n"), F.array_join(F.transform("Ans_Points", lambda p: F.array_join(R.without_conclusions(p), "|")), ";").alias("points"))


@query(f"""WITH {_C}, x AS (SELECT k, unnest([1, 2, 3]) AS i FROM c WHERE k % 13 <> 0) SELECT k AS ID, i - 1 AS Adv_Question_Index, CASE WHEN i = 3 THEN 'empty_answer' ELSE 'unmatched_points' END AS Reason
 FROM x WHERE (i = 1 AND k % 6 = 0) OR (i = 2 AND k % 3 = 0) OR (i = 3 AND k % 4 = 0)""")
def adversarial_drops(spark, sf_dir):
    _, dropped, _ = P.sibling_groups(_siblings(spark, sf_dir).drop("k"))
    return dropped.select("ID", "Adv_Question_Index", "Reason")


@query(f"""WITH {_C}, x AS (SELECT *, {_LEFT} AS l FROM c) SELECT k AS ID, CASE WHEN k % 13 = 0 THEN 0 ELSE 3 END AS n_siblings FROM x WHERE k % 13 = 0 OR len(l) = 0""")
def adversarial_failures(spark, sf_dir):
    """Rows that keep no sibling."""
    _, _, failed = P.sibling_groups(_siblings(spark, sf_dir).drop("k"))
    return failed.select("ID", F.size("Adv_Answer").alias("n_siblings"))


@query(f"""WITH {_C}, x AS (SELECT *, {_LEFT} AS l FROM c WHERE k % 13 <> 0) SELECT k AS ID, 1 + len(l) AS n, 's0 ' || k || '|Conclusion: yes' || list_aggregate(list_prepend('', list_transform(l, lambda i: ';s' || i || ' ' || k)), 'string_agg', '') AS docs,
 md5('Document 1 Title: T' || chr(10) || '- s0 ' || k) AS info FROM x WHERE len(l) > 0""")
def adversarial_flatten_type3(spark, sf_dir):
    """Groups whose conclusions leave the documents and their texts."""
    groups, _, _ = P.sibling_groups(_siblings(spark, sf_dir).drop("k"), conclusions=True)
    return groups.select("ID", F.size("Answers").alias("n"), F.array_join(F.transform("Doc_Ans_Points", lambda d: F.array_join(F.flatten(d), "|")), ";").alias("docs"), F.md5(F.get("Documents_Info", F.lit(0))).alias("info"))


def _groups(spark, sf_dir):
    """Groups with documents; one array is too short (k % 9 = 0) or lacking (k % 10 = 0)."""
    groups, _, _ = P.sibling_groups(_siblings(spark, sf_dir).drop("k"))
    doc = lambda q: F.array(cat("Talk. Title: ", q, "\nBody In summary, no"), cat("untitled ", q))
    listed = F.transform("Questions", doc)
    k = F.col("ID")
    return groups.withColumn("Docs_List", F.when(k % 10 == 0, None).when(k % 9 == 0, F.slice(listed, F.lit(1), F.size(listed) - 1)).otherwise(listed))


@query(f"""WITH {_C}, x AS (SELECT *, list_prepend('root ' || name, list_transform({_LEFT}, lambda i: 'q' || i || ' ' || name)) AS qs FROM c WHERE k % 13 <> 0 AND len({_LEFT}) > 0 AND k % 9 <> 0 AND k % 10 <> 0)
 SELECT k AS Root_ID, CAST(j AS INTEGER) AS Question_No, segment AS Persona, qs[j] AS Question, array_to_string(list_filter(qs, lambda q: q <> qs[j]), '|') AS others, md5('Title: ' || qs[j] || chr(10) || 'Body' || '|untitled ' || qs[j]) AS docs FROM x, range(1, 5) r(j) WHERE j <= len(qs)""")
def sibling_questions(spark, sf_dir):
    """Every sibling with its cut documents and the others of its group by place."""
    rows, _ = P.sibling_rows(_groups(spark, sf_dir))
    return rows.select("Root_ID", "Question_No", "Persona", "Question", F.array_join("Adv_Question", "|").alias("others"), F.md5(F.array_join("Rel_Docs_List", "|")).alias("docs"))


@query(f"""WITH {_C} SELECT k AS ID, CASE WHEN k % 10 = 0 THEN 'non_list:Docs_List' ELSE 'short:Docs_List' END AS Reason FROM c WHERE k % 13 <> 0 AND len({_LEFT}) > 0 AND (k % 9 = 0 OR k % 10 = 0)""")
def sibling_skips(spark, sf_dir):
    _, skipped = P.sibling_rows(_groups(spark, sf_dir))
    return skipped.select("ID", "Reason")


def _documented(spark, sf_dir):
    """k % 4 documents' points against k % 3 documents."""
    points = F.transform(F.sequence(F.lit(0), (K() % 4).cast("int")), lambda i: F.array(cat("p", i)))
    docs = F.transform(F.sequence(F.lit(0), (K() % 3).cast("int")), lambda i: cat("d", i))
    return customers(spark, sf_dir).select("k", F.slice(points, F.lit(2), 9).alias("Doc_Ans_Points"), F.slice(docs, F.lit(2), 9).alias("Rel_Docs_List"), F.when(K() % 2 == 0, F.array(F.lit("- Conclusion: x"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("Ans_Points"))


@query(f"""WITH {_C} SELECT k, CASE WHEN k % 4 > k % 3 THEN 'doc_ans_points_' || (k % 4) || '_gt_rel_docs_' || (k % 3) END AS reason, CASE WHEN k % 4 > k % 3 THEN k % 3 ELSE k % 4 END AS n_docs FROM c""")
def documents_for_points(spark, sf_dir):
    kept, removed = P.documents_for_points(_documented(spark, sf_dir))
    one = kept.select("k", F.lit(None).cast("string").alias("reason"), F.size("Rel_Docs_List").cast("long").alias("n_docs"))
    return one.union(removed.select("k", "Removed_Reason", F.size("Rel_Docs_List").cast("long")))


@query(f"""WITH {_C} SELECT k, 'empty_rel_docs_list' AS reason, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END AS n_points, k % 2 = 0 AS conclusion_only FROM c WHERE k % 3 = 0""")
def rows_without_documents(spark, sf_dir):
    _, removed = P.rows_with_documents(_documented(spark, sf_dir))
    return removed.select("k", F.col("Removed_Reason").alias("reason"), F.col("N_Ans_Points").alias("n_points"), F.col("Conclusion_Only").alias("conclusion_only"))


@query(f"""WITH {_C} SELECT k, k % 4 AS n_points, k % 3 AS n_documents FROM c WHERE k % 4 <> k % 3""")
def documents_mismatch(spark, sf_dir):
    return P.documents_match(_documented(spark, sf_dir), "Doc_Ans_Points", "Rel_Docs_List").select("k", F.col("n_points").cast("long").alias("n_points"), F.col("n_documents").cast("long").alias("n_documents"))


@query(f"""WITH {_C} SELECT k, CASE WHEN k % 5 IN (0, 1) THEN k % 10 ELSE 0 END AS score, CASE WHEN k % 5 = 4 THEN 1 ELSE 0 END AS steps, CASE WHEN k % 5 = 2 THEN 1 ELSE 0 END AS verdict FROM c""")
def evaluator_marks(spark, sf_dir):
    """Marks of replies in the three styles."""
    ten = K() % 10
    reply = pick(5, {0: cat(ten, ", as it lacks a point"), 1: cat(" ", ten, ".\nno"), 2: cat("**True** it is\nno"), 3: cat("False\nFINAL VERDICT: wrong")}, cat("First\nthen it's INCORRECT"))
    marks = [X.evaluated(reply, style).cast("long").alias(name) for style, name in (("score", "score"), ("step-by-step", "steps"), ("verdict", "verdict"))]
    return customers(spark, sf_dir).select("k", *marks)


@query(f"""WITH {_C} SELECT k, CASE WHEN k % 4 = 0 THEN 'reply ' || k ELSE 'False. Error in prediction.' END AS explanation, CASE WHEN k % 4 = 0 THEN 1.0 END AS counted FROM c""")
def failed_predictions(spark, sf_dir):
    """Predictions that are null, blank or an error are false without a grader, and leave a running accuracy's denominator."""
    prediction = pick(4, {1: F.lit(None).cast("string"), 2: F.lit("  "), 3: F.lit("error")}, F.lit("42"))
    failed = prediction.isNull() | X.py_strip(prediction).isin("", "error")
    return customers(spark, sf_dir).select("k", X.graded_or_error(prediction, cat("reply ", K())).alias("explanation"), F.when(~failed, 1.0).alias("counted"))


@query(f"""WITH {_C} SELECT k, ['yes', 'no', 'yes', NULL, NULL][k % 5 + 1] AS strict, ['yes', 'no', 'yes', 'n/a', NULL][k % 5 + 1] AS lenient FROM c""")
def ratings_read(spark, sf_dir):
    said = pick(5, {0: F.lit(" Y "), 1: F.lit("FALSE"), 2: F.lit("1"), 3: F.lit("Not applicable"), 4: F.lit("maybe")}, F.lit(None))
    return customers(spark, sf_dir).select("k", X.rating(said).alias("strict"), X.rating(said, True).alias("lenient"))


@query(f"""WITH {_C} SELECT family, count(*) AS n FROM (SELECT CASE k % 4 WHEN 0 THEN 'COBS ' || (k % 3) || '.2' WHEN 1 THEN 'HMRC notes' WHEN 2 THEN 'Pensions Act 2008' ELSE 'OTHER' END AS family FROM c) GROUP BY family ORDER BY n DESC, family""")
def clause_families(spark, sf_dir):
    """Heads of clauses by a pattern, counted."""
    clause = pick(4, {0: cat(" COBS ", K() % 3, ".2 rules\nCONC 1"), 1: cat("HMRC notes, part"), 2: cat("Pensions Act 2008 duties")}, cat("On COBS 9"))
    pattern = r"((?:COBS|MCOB|ICOBS|CONC|SYSC|PRIN)\s*[\d.]+|HMRC[^.,:]*|Pensions Act \d+)"
    return customers(spark, sf_dir).groupBy(X.families(clause, pattern).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_C} SELECT k, 'ctx ' || k AS original_context, 'what ' || k AS question_statement, 'it is ' || k AS previous_answer, 'more' || chr(10) || 'lines' AS new_context, 'how many' AS new_question, 'because' AS reasoning, k / 2.0 AS answer FROM c""")
def problem_sections(spark, sf_dir):
    """Sections of an extended problem; ** and ## go, <x> is x, markers come in two forms."""
    answer = F.when(K() % 2 == 0, cat("New answer [Number only]: $", (K() / 2).cast("string"), " euros")).otherwise(cat("New answer: <", K(), "/2> or so"))
    reply = cat("Sure\n**Original context", F.when(K() % 3 == 0, " [without question statement]").otherwise(""), ":** <ctx ", K(), ">\n## Question statement: what ", K(), "\nOriginal answer statement: it is ", K(), "\nNew operation over original answer: add\nNew context: more\nlines\n New question statement: how many\nNew answer reasoning:\nbecause\n", answer)
    x = customers(spark, sf_dir).select("k", S.sections(reply, S.EXTEND).alias("x"))
    return x.select("k", *(f"x.{n}" for n in S.EXTEND if n not in ("operation", "answer")), S.plain_number(F.col("x.answer")).alias("answer"))


@query(f"""WITH {_C} SELECT k, 'd' || k || chr(10) || 'e' AS documents, 'q: ' || k AS question, CASE WHEN k % 3 = 0 THEN NULL ELSE 'a' || k END AS answer, 'one' AS context_1, 'two ' || k AS context_2, CASE WHEN k % 3 = 0 THEN NULL ELSE 'three' END AS context_3 FROM c""")
def marked_sections(spark, sf_dir):
    """Replies without a program's sections, and corrected contexts; by k % 3 one is lacking."""
    naive = cat("Documents:\n<d", K(), "\ne>\n**Question:** q: ", K(), F.when(K() % 3 == 0, "").otherwise(cat("\nAnswer: <a", K(), ">")))
    grammar = cat("Corrected context 1: <one>\nCorrected context 2:two ", K(), "\n", F.when(K() % 3 == 0, "").otherwise("  Corrected context 3: three\n"))
    x = customers(spark, sf_dir).select("k", S.sections(naive, S.NAIVE).alias("x"), S.sections(grammar, S.GRAMMAR).alias("y"))
    return x.select("k", "x.*", "y.*")


@query(f"""WITH {_C} SELECT k, CAST(i AS INTEGER) AS nth, CAST(i + k AS DOUBLE) AS number, 'ctx ' || i AS modified_context, 'new ' || i AS new_question, 's' || i AS subjects, 'o' || i AS objects FROM c, range(1, 4) r(i) WHERE i <= k % 3 + 1""")
def problem_quantities(spark, sf_dir):
    """The quantities of a broken-up problem, one to three."""
    number, modified, new = S.BREAK["number"][0], S.BREAK["modified_context"][0], S.BREAK["new_question"][0]
    one = lambda i: cat(f"Quantity {i}:\n{number} ", K() + i, f" things\n{modified} <ctx {i}>\n{new} new {i}\n{S.BREAK['subjects'][0]} s{i}\n{S.BREAK['objects'][0]} o{i}\n")
    text = cat("Original context [without question statement]: c\nQuestion statement: q\nAnswer statement: a\n", one(1), F.when(K() % 3 > 0, one(2)).otherwise(""), F.when(K() % 3 == 2, one(3)).otherwise(""))
    x = customers(spark, sf_dir).select("k", F.posexplode(S.quantities(text)).alias("nth", "x"))
    return x.select("k", (F.col("nth") + 1).alias("nth"), S.plain_number(F.col("x.number")).alias("number"), "x.modified_context", "x.new_question", "x.subjects", "x.objects")


@query(f"""WITH {_C} SELECT k, 'p' || k AS persona, 'e: ' || segment AS environment, CASE WHEN k % 4 = 0 THEN 'GENERIC' ELSE CAST(k AS VARCHAR) END AS area FROM c WHERE k % 4 <> 3""")
def scenario_replies(spark, sf_dir):
    """Scenarios of replies: one whole, one without documents, one whose area is no number (k % 4 = 3 for the first too)."""
    area = pick(4, {0: F.lit("generic"), 3: F.lit("none")}, K().cast("string"))
    text = cat("Talk\nUSER_PERSONA: p", K(), "\nCOLLECTION_OF_DOCS: e: ", F.col("segment"), "\nREGULATORY_AREA_ID: ", area, "\nUSER_PERSONA: x\nREGULATORY_AREA_ID: 3\nUSER_PERSONA: y\nCOLLECTION_OF_DOCS: z\nREGULATORY_AREA_ID: q")
    return customers(spark, sf_dir).select("k", F.explode(S.scenarios(text)).alias("x")).select("k", "x.*")


@query(f"""WITH {_C} SELECT k, 3 AS n, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS n_generic, 1 AS n_no_documents, 0 AS n_no_area, CASE WHEN k % 2 = 1 AND k % 10 > 4 THEN 1 ELSE 0 END + 1 AS n_unknown, 1 AS n_no_colon FROM c""")
def scenario_faults(spark, sf_dir):
    """What the pre-flight check of a scenario file finds; areas 0 to 4 are known."""
    area = F.when(K() % 2 == 0, "Generic").otherwise((K() % 10).cast("string"))
    text = cat("USER_PERSONA: p\nCOLLECTION_OF_DOCS: d\nREGULATORY_AREA_ID: ", area, "\nUSER_PERSONA: x\nREGULATORY_AREA_ID: 3\nUSER_PERSONA y\nCOLLECTION_OF_DOCS: z\nREGULATORY_AREA_ID: 99")
    x = customers(spark, sf_dir).select("k", S.scenario_faults(text, F.array(*(F.lit(str(i)) for i in range(5)))).alias("x"))
    return x.select("k", "x.n", "x.n_generic", F.size("x.no_documents").alias("n_no_documents"), F.size("x.no_area").alias("n_no_area"), F.size("x.unknown_area").alias("n_unknown"), F.size("x.no_colon").alias("n_no_colon"))


@query(f"""WITH {_C} SELECT k, CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k AS VARCHAR) END AS type1, CASE WHEN k % 3 = 0 THEN NULL ELSE 'a=b' END AS type2, CASE WHEN k % 3 = 0 THEN NULL ELSE 2 END AS n_paths FROM c""")
def key_value_maps(spark, sf_dir):
    """"k=v,k=v" and "k=x+y": k % 3 = 0 lacks an equals sign."""
    text = F.when(K() % 3 == 0, "type1").otherwise(cat("type1 = ", K(), " ,type2=a=b"))
    paths = F.when(K() % 3 == 0, "type1").otherwise(cat("type1= x", K(), " + y+ ,type2=z"))
    x = customers(spark, sf_dir).select("k", X.key_values(text).alias("m"), X.key_values(paths, "+").alias("l"))
    return x.select("k", F.try_element_at("m", F.lit("type1")).alias("type1"), F.try_element_at("m", F.lit("type2")).alias("type2"), F.when(F.col("l").isNotNull(), F.size(F.try_element_at("l", F.lit("type1")))).alias("n_paths"))


@query(f"""WITH {_C} SELECT k, 'He paid  for  pens and 7 cups, ' || CASE WHEN k % 2 = 0 THEN '.5' ELSE '' END || ' in all' AS bare FROM c WHERE k <> 7 AND CAST(k AS VARCHAR) NOT LIKE '%7%'
 UNION ALL SELECT k, 'He paid  for  pens and ' || replace('7', CAST(k AS VARCHAR), '') || ' cups, ' || CASE WHEN k % 2 = 0 THEN '.5' ELSE '' END || ' in all' FROM c WHERE CAST(k AS VARCHAR) LIKE '%7%'""")
def numbers_removed(spark, sf_dir):
    """Texts without their known numbers, as digits or words."""
    text = cat("He paid ", K(), " for twenty-one pens and 7 cups, ", K(), F.when(K() % 2 == 0, ".5").otherwise(""), " in all")
    return customers(spark, sf_dir).select("k", S.numbers_removed(text, F.array(K().cast("double"), F.lit(21.0))).alias("bare"))


@query(f"""WITH {_C} SELECT k, CASE WHEN k % 5 IN (1, 3, 4) THEN 'x good' || k ELSE 'x bad' || k END AS answer, CASE WHEN k % 5 = 3 THEN 'stale' WHEN k % 5 IN (1, 4) THEN 'd good' || k ELSE 'd bad' || k END AS info, k % 5 IN (2, 4) AS discarded FROM c""")
def corrected_points(spark, sf_dir):
    """Grounding checks put points right: grounded at once (k % 5 = 0), after one correction (1; 3 with stale documents), a point that
    isn't there (2), never grounded (4)."""
    bad = lambda x: cat('Grounded: False\nFlagged Point: "', x, '"\nCorrected Point: good', K())
    good, own, right = F.lit("Grounded: True\nFlagged Point: none"), bad(cat("bad", K())), bad(cat("good", K()))
    replies = pick(5, {0: F.array(good), 1: F.array(own, good), 2: F.array(bad(F.lit("absent")), good), 3: F.array(own, good)}, F.array(own, right, right))
    info = F.when(K() % 5 == 3, "stale").otherwise(cat("d bad", K()))
    return customers(spark, sf_dir).select("k", V.corrected_in_place(cat("x bad", K()), info, replies).alias("x")).select("k", "x.*")


@query(f"""WITH {_C} SELECT k, md5('Document 1 Answer points assigned:' || chr(10) || '- a' || chr(10) || chr(10) || 'Document 2 Answer points assigned:' || chr(10) || '- b' || k || chr(10) || '- c' || chr(10) || chr(10) || 'Document 10 Answer points assigned:' || chr(10) || '- d') AS info,
 'a\\nb' || k AS escaped, 'a' || chr(10) || 'b' || k AS back, CAST(k AS VARCHAR) || ' {{b}} x' AS prompt FROM c""")
def rendered_texts(spark, sf_dir):
    """Documents' points as text, escaped line ends, and a prompt whose first value looks like the next slot."""
    m = F.map_from_arrays(F.array(F.lit("10"), F.lit("2"), F.lit("1")), F.array(F.array(F.lit("d")), F.array(cat("b", K()), F.lit("c")), F.array(F.lit("a"))))
    escaped = X.escape_newlines(cat("a\nb", K()))
    return customers(spark, sf_dir).select("k", F.md5(R.documents_info(m)).alias("info"), escaped.alias("escaped"), X.unescape_newlines(escaped).alias("back"), X.prompt("{a} {b}", {"a": cat(K(), " {b}"), "b": F.lit("x")}).alias("prompt"))


@query(f"""WITH {_C} SELECT k, CASE WHEN k % 4 = 3 THEN NULL ELSE 2 END AS n, CASE WHEN k % 4 = 3 THEN NULL ELSE '["p' || k || '","q"]' END AS again FROM c""")
def json_lists(spark, sf_dir):
    """JSON lists, up to three times encoded, decoded and encoded again; anything else is null."""
    once = F.to_json(F.array(cat("p", K()), F.lit("q")))
    quoted = lambda x: F.get_json_object(F.to_json(F.struct(x.alias("x"))), "$.x")
    twice = F.concat(F.lit('"'), F.replace(once, F.lit('"'), F.lit('\\"')), F.lit('"'))
    text = pick(4, {0: once, 1: quoted(once), 2: twice}, F.lit('{"a": 1}'))
    back = X.decoded_json_list(text)
    return customers(spark, sf_dir).select("k", F.when(back.isNotNull(), F.size(back)).alias("n"), F.to_json(back).alias("again"))


@query(f"""WITH {_C} SELECT k, 1 + k % 2 AS n, md5('Document 1:' || chr(10) || 'Title: t' || chr(10) || 'Text:' || chr(10) || 'x' || k) AS first FROM c""")
def reply_documents(spark, sf_dir):
    """Documents of a reply, each from its heading on."""
    text = cat("Here. Document 1: Title: t\nQuestion: q\nText: y Text: x", K(), "\n", F.when(K() % 2 == 1, "Document 12:\nText: z").otherwise(""))
    docs = R.reply_documents(text)
    return customers(spark, sf_dir).select("k", F.size(docs).cast("long").alias("n"), F.md5(F.get(docs, F.lit(0))).alias("first"))


@query(f"""WITH {_C} SELECT k, CASE WHEN k % 3 = 0 THEN NULL ELSE 'more ' || k END AS extra, CASE WHEN k % 4 = 3 THEN NULL ELSE k % 4 = 0 END AS present, k % 2 = 0 AS on_topic, CASE WHEN k % 3 = 2 THEN NULL ELSE k % 3 = 0 END AS relevant FROM c""")
def check_replies(spark, sf_dir):
    """What verification checks say: further points, presence with relevance, topic, cross-check."""
    extra = pick(6, {0: cat("False.\nExtra Points Mentioned: none"), 3: cat("True\nExtra Points Mentioned: None of the points in the document fit")}, cat("True\nExtra Points Mentioned: more ", K(), ": really"))
    present = pick(4, {0: F.lit("Presence: True\nExplanation for Presence: a\nRelevance: True\nExplanation for Relevance: b"), 1: F.lit("Presence: True\nExplanation for Presence: a\nRelevance: False\nExplanation for Relevance: true"), 2: F.lit("Presence: True\nExplanation for Presence: a")}, F.lit(None).cast("string"))
    topic = cat("On_Topic: False\nso\nOn_Topic: ", F.when(K() % 2 == 0, "True").otherwise("False"), "\nend")
    cross = pick(3, {0: F.lit("Relevance: TRUE"), 1: F.lit("True. Relevance: no")}, F.lit("True"))
    return customers(spark, sf_dir).select("k", V.extra_points(extra).alias("extra"), V.present(present).alias("present"), V.on_topic(topic).alias("on_topic"), V.relevant(cross).alias("relevant"))
