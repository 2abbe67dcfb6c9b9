"""Generated answers to checked points: parsing, matching, flattening of sibling groups, documents.

Every operator is one pass of column expressions; a row that fails goes to the second relation with its reason, so
nothing is lost.  Arrays hold one answer's lines or one group's siblings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions import responses as R
from qaloom.functions import text as X
from qaloom.functions.keys import let, py_strip


def _plain_bullets(answer: Column) -> Column:
    """Points where a line's first character goes if the line, stripped, begins with a dash: of indented bullets the dash stays."""
    rows = F.filter(X.lines(answer), lambda t: py_strip(t) != "")
    return F.transform(rows, lambda t: F.when(py_strip(t).startswith("-"), py_strip(F.substring(t, F.lit(2), F.length(t)))).otherwise(py_strip(t)))


def answer_points(rows: DataFrame, answer: str = "Answer", info: str = "Documents_Info", conclusions: bool = False) -> DataFrame:
    """`rows` with literal line breaks restored, Ans_Points, Doc_Ans_Points (array of documents) and Reason: null if each
    answer point stands among the documents' as often as in the answer, else "unmatched_points"; null texts give "missing".

    conclusions: the type whose points need no match: bullets only are documents' points, and nothing fails but nulls."""
    plain = rows.withColumn(answer, X.unescape_newlines(F.col(answer))).withColumn(info, X.unescape_newlines(F.col(info)))
    points = _plain_bullets(F.col(answer)) if conclusions else X.bullet_points(F.col(answer))
    parsed = plain.withColumn("Ans_Points", points).withColumn("Doc_Ans_Points", R.document_points(F.col(info), conclusions))
    reason = F.when(F.col(answer).isNull() | F.col(info).isNull(), "missing")
    if not conclusions:
        reason = reason.when(~R.covers(F.col("Ans_Points"), F.flatten("Doc_Ans_Points")), "unmatched_points")
    return parsed.withColumn("Reason", reason)


def sibling_points(answer: Column, info: Column, conclusions: bool = False) -> Column:
    """reason, points and docs of one adversarial answer.  conclusions: conclusion points need no match and leave the documents."""
    lacks = lambda x: x.isNull() | (py_strip(x) == "")

    def judged(points: Column, parsed: Column) -> Column:
        asked = R.without_conclusions(points) if conclusions else points
        docs = F.transform(parsed, lambda d: R.without_conclusions(d)) if conclusions else parsed
        reason = F.when(lacks(answer), "empty_answer").when(F.size(points) == 0, "no_points").when(lacks(info), "empty_documents").when(~R.covers(asked, F.flatten(parsed)), "unmatched_points")
        return F.struct(reason.alias("reason"), points.alias("points"), docs.alias("docs"))

    return let(X.bullet_points(answer), lambda points: let(R.document_points(info), lambda parsed: judged(points, parsed)))


def without_conclusion_lines(info: Column) -> Column:
    """Documents' points without conclusions: their lines go, and so does one that follows "assigned:" on a line."""
    at = lambda x: F.instr(F.lower(x), "assigned:")
    ends = lambda x: F.substring(x, F.lit(1), at(x) + len("assigned:") - 1)
    tail = lambda x: F.lower(py_strip(F.substring(x, at(x) + len("assigned:"), F.length(x))))
    kept = F.filter(X.lines(info), lambda x: ~X.is_conclusion(x, True))
    return F.array_join(F.transform(kept, lambda x: F.when((at(x) > 0) & tail(x).startswith("conclusion:"), ends(x)).otherwise(x)), "\n")


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once a row.  It comes from a generator, as filters and later columns would else be folded into
    the parse and repeat it for each array that they name."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def sibling_groups(rows: DataFrame, conclusions: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, dropped siblings, failed rows) of roots with adversarial siblings.

    rows: Question, Answer, Documents_Info, Ans_Points, Doc_Ans_Points and the arrays Adv_Question, Adv_Answer,
    Adv_Documents_Info, beside any others, which stay.  A sibling that fails is dropped with its place and reason; a row
    whose siblings all fail (or that has none) fails.  A group's arrays hold the root first, then the siblings that are left."""
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes a row, but dear ones to parse
    n = F.size("Adv_Answer")
    each = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.struct(i.alias("i"), F.get("Adv_Question", i).alias("question"), F.get("Adv_Answer", i).alias("answer"), F.get("Adv_Documents_Info", i).alias("info")))
    tried = F.transform(F.filter(each, lambda s: s["i"] < n), lambda s: F.struct(s["i"].alias("i"), s["question"].alias("question"), s["answer"].alias("answer"), s["info"].alias("info"), sibling_points(s["answer"], s["info"], conclusions).alias("x")))
    marked = _once(_once(rows, "_s", tried), "_k", F.filter("_s", lambda s: s["x"]["reason"].isNull()))
    dropped = marked.select(*rows.columns, F.explode("_s").alias("s")).where("s.x.reason is not null")
    dropped = dropped.select(*[c for c in rows.columns if not c.startswith("Adv_")], F.col("s.i").alias("Adv_Question_Index"), F.col("s.question").alias("Adv_Question"), F.col("s.x.reason").alias("Reason"))
    # the siblings are null with the array, so a row without one is a failed row too
    good = F.coalesce(F.size(F.coalesce("_k", F.array())) > 0, F.lit(False))
    info = (lambda x: without_conclusion_lines(x)) if conclusions else (lambda x: x)
    put = lambda first, rest: F.concat(F.array(first), F.transform("_k", rest))
    own = ("Question", "Answer", "Documents_Info", "Ans_Points", "Doc_Ans_Points")
    groups = marked.where(good).select(
        *(c for c in rows.columns if not c.startswith("Adv_") and c not in own),
        put(F.col("Question"), lambda s: s["question"]).alias("Questions"), put(F.col("Answer"), lambda s: s["answer"]).alias("Answers"),
        put(info(F.col("Documents_Info")), lambda s: info(s["info"])).alias("Documents_Info"),
        put(F.col("Ans_Points"), lambda s: s["x"]["points"]).alias("Ans_Points"), put(F.col("Doc_Ans_Points"), lambda s: s["x"]["docs"]).alias("Doc_Ans_Points"),
    )
    return groups, dropped, marked.where(~good).select(*rows.columns)


def sibling_rows(groups: DataFrame, key: str = "ID") -> tuple[DataFrame, DataFrame]:
    """(questions, skipped groups): one row a sibling with its documents cut and Adv_* arrays of all others, by place.

    A group whose arrays Answers, Ans_Points, Doc_Ans_Points or Docs_List are null or shorter than Questions is skipped,
    with the first such array's name as its reason.  Question_No counts a group's siblings from 1; number the questions
    of the whole relation by positions() on (key, Question_No)."""
    n = F.size("Questions")
    reason = F.when(F.col("Questions").isNull(), "non_list:Questions")
    for c in ("Answers", "Docs_List", "Ans_Points", "Doc_Ans_Points"):
        reason = reason.when(F.col(c).isNull(), f"non_list:{c}")
    for c in ("Answers", "Docs_List", "Ans_Points", "Doc_Ans_Points"):
        reason = reason.when(F.size(c) < n, f"short:{c}")
    marked = groups.withColumn("Reason", reason).withColumn("_docs", F.transform("Docs_List", lambda ds: F.transform(ds, X.cut_document)))
    skipped = marked.where("Reason is not null").drop("_docs")
    each = marked.where("Reason is null").select("*", F.posexplode("Questions").alias("_i", "_q"))
    others = lambda a: F.filter(F.slice(a, F.lit(1), n), lambda x, j: j != F.col("_i"))
    own = lambda a: F.get(a, F.col("_i"))
    lists = ("Questions", "Answers", "Documents_Info", "Ans_Points", "Doc_Ans_Points", "Docs_List")
    rest = [c for c in groups.columns if c not in (key, *lists)]
    return each.select(
        F.col(key).alias("Root_ID"), (F.col("_i") + 1).alias("Question_No"), F.col("_q").alias("Question"), own("Answers").alias("Answer"), own("Ans_Points").alias("Ans_Points"),
        own("Doc_Ans_Points").alias("Doc_Ans_Points"), own("_docs").alias("Rel_Docs_List"), others("Questions").alias("Adv_Question"), others("Answers").alias("Adv_Answer"),
        others("Ans_Points").alias("Adv_Ans_Pts"), others("Doc_Ans_Points").alias("Adv_Doc_Ans_Pts"), others("_docs").alias("Adv_Docs_List"), *rest,
    ), skipped


def documents_for_points(rows: DataFrame, points: str = "Doc_Ans_Points", docs: str = "Rel_Docs_List") -> tuple[DataFrame, DataFrame]:
    """(rows, removed): rows with fewer documents than documents' points go, with the counts as their reason; documents beyond
    the points' are cut off.  Null arrays count as empty."""
    many = lambda c: F.coalesce(F.size(F.coalesce(c, F.array())), F.lit(0))
    short = many(points) > many(docs)
    reason = F.concat(F.lit("doc_ans_points_"), many(points).cast("string"), F.lit("_gt_rel_docs_"), many(docs).cast("string"))
    return rows.where(~short).withColumn(docs, F.slice(docs, F.lit(1), many(points))), rows.where(short).withColumn("Removed_Reason", reason)


def rows_with_documents(rows: DataFrame, docs: str = "Rel_Docs_List", points: str = "Ans_Points") -> tuple[DataFrame, DataFrame]:
    """(rows, removed): rows without a relevant document go, with N_Ans_Points and whether a conclusion is all they hold."""
    empty = F.coalesce(F.size(F.col(docs)) < 1, F.lit(True))
    n = F.coalesce(F.size(points), F.lit(0))
    only = (n == 1) & X.is_conclusion(F.regexp_replace(F.coalesce(F.get(points, F.lit(0)), F.lit("")), r"^[- ]+", ""))
    removed = rows.where(empty).withColumn("Removed_Reason", F.lit("empty_rel_docs_list")).withColumn("N_Ans_Points", n).withColumn("Conclusion_Only", only)
    return rows.where(~empty), removed


def documents_match(rows: DataFrame, points: str, docs: str) -> DataFrame:
    """Rows whose number of documents' points differs from that of documents, with both numbers (null: not readable)."""
    counted = rows.withColumn("n_points", F.size(points)).withColumn("n_documents", F.size(docs))
    return counted.where(F.col("n_points").isNull() | F.col("n_documents").isNull() | (F.col("n_points") != F.col("n_documents")))
