from pyspark.sql import functions as F

from qaloom.functions import code as C
from qaloom.functions import responses as R
from qaloom.functions import text as X
from qaloom.operators import postprocess, responder
from qaloom.operators import verification as V


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def text(spark, column, t):
    return spark.createDataFrame([(t,)], "t string").select(column.alias("x")).first().x


REPLY = "Hm\nQuestion:\nWhat?\nAnswer: - a\n- b\nDocument 1 Title: T\n- a\nDocument 2 Title: U\n- b"


def test_replies(spark):
    assert tuple(text(spark, R.qa_reply(F.col("t")), REPLY)) == ("What?", "- a\n- b", "Document 1 Title: T\n- a\nDocument 2 Title: U\n- b")
    assert tuple(text(spark, R.qa_reply(F.col("t")), "Question: q\nAnswer: a")) == ("q", None, None) and tuple(text(spark, R.qa_reply(F.col("t")), None)) == (None, None, None)
    assert text(spark, R.qa_reply(F.col("t")), "Question: Question:\nQuestion: x\nAnswer: a\nDocument 1 Title: T").question == "x"
    noted = text(spark, R.qa_reply(F.col("t")), "Question: x\nAnswer: a\nDocument 1: note\nDocument 1 Title: T")
    assert noted.answer == "a\nDocument 1: note" and noted.documents == "Document 1: note\nDocument 1 Title: T"
    assert text(spark, R.qa_reply(F.col("t"), True), "Question:\n \nAnswer: a\nDocument 1 Title: T").question is None


def test_quotes(spark):
    for t, want in ((' "“x”" ', "x"), ("'x”", "x"), ('"x', '"x'), ('""', ""), ("\"'\"", "'"), ("a 'b' c", "a 'b' c"), (None, None), ("' \" y \" '", "y")):
        assert text(spark, R.strip_quotes(F.col("t")), t) == want


def test_document_points(spark):
    info = "\n".join([f"Document {i} Title: t{i}\n- p{i}" for i in range(1, 12)]) + "\nDocument 11: inline\nDocument 3:\n- again\nTitle: kept\nab\nDocument 3 title: low"
    got = text(spark, R.document_points(F.col("t")), info)
    assert len(got) == 12 and got[10] == ["p11", "inline"] and got[11] == ["again", "Title: kept"]
    pool = R.pool_of(R.as_map(R.document_points(F.col("t"))))
    assert text(spark, R.covers(F.array(F.lit("p1"), F.lit("p2")), pool), info) and not text(spark, R.covers(F.array(F.lit("p1"), F.lit("p1")), pool), info)
    assert text(spark, R.document_points(F.col("t"), True), "Document 1: inline\n - a\nfree\nDocument 2:\n- b") == [["a"], ["b"]]


def test_maps_lose_points_and_are_numbered_anew(spark):
    m = F.create_map(F.lit("2"), F.array(F.lit("a")), F.lit("10"), F.array(F.lit("b"), F.lit("c")), F.lit("1"), F.array(F.lit("d")))
    left = R.without_points(m, F.array(F.lit("a"), F.lit("c")))
    assert one(spark, left, t=1) == {"1": ["d"], "2": ["b"]}
    assert one(spark, R.documents_info(left), t=1) == "Document 1 Answer points assigned:\n- d\n\nDocument 2 Answer points assigned:\n- b"
    assert one(spark, R.without_conclusions(F.array(F.lit(" Conclusion: x"), F.lit("y"))), t=1) == ["y"]
    odd = F.create_map(F.lit("x"), F.lit("last"), F.lit("2"), F.lit("first"))
    assert one(spark, X.renumbered_map(odd), t=1) == {"1": "first", "2": "last"}


def test_splices_and_documents(spark):
    assert text(spark, R.spliced(F.col("t"), F.lit("bad"), F.lit("good")), "a bad b") == "a good b" and text(spark, R.spliced(F.col("t"), F.lit("no"), F.lit("x")), "abc") is None
    got = text(spark, R.reply_documents(F.col("t")), "Hi Document 1: Title: x Text: one\nDocument 2: two\nQuestion: q")
    assert got == ["Document 1:\nTitle: x Text: one\nText:\none", "Document 2:\ntwo\nText:\ntwo\nQuestion: q"]
    assert text(spark, X.cut_document(F.col("t")), "a Title: b Title: c") == "Title: b" and text(spark, X.cut_document(F.col("t")), "no title In summary, x") == "no title"


def test_prompts_and_marks(spark):
    assert one(spark, X.prompt("{a}-{b}-{c}", {"a": F.lit("{b}"), "b": F.lit("x")}), t=1) == "{b}-x-{c}"
    assert text(spark, X.verdict_lines(F.col("t"), F.lit(2)), "20240101123456. no\n1. yes") == ["Yes", "Unsure"]
    assert [text(spark, X.evaluated(F.col("t"), s), "8, fine\nINCORRECT") for s in ("score", "step-by-step", "verdict")] == [8, 1, 0]
    assert text(spark, X.evaluated(F.col("t"), "score"), "") == 0 and text(spark, X.evaluated(F.col("t")), "**True**") == 1
    assert text(spark, X.key_values(F.col("t")), "a=1, b = 2=3") == {"a": "1", "b": "2=3"} and text(spark, X.key_values(F.col("t")), "a=1,a=2") is None and text(spark, X.key_values(F.col("t"), "+"), "a=x + y") == {"a": ["x", "y"]}


def test_code(spark):
    assert text(spark, C.unfenced(F.col("t")), "so ```python\nfrom m.py import x\n``` end") == "from m import x"
    assert text(spark, C.asserts_at_end(F.col("t")), "a\nassert x\nb\n \n") and not text(spark, C.asserts_at_end(F.col("t")), "assert x" + "\nb" * 6) and not text(spark, C.asserts_at_end(F.col("t")), "assert x is None\n# assert y")
    assert C.defined_counts("def f(a, b=(1, 2), *,\n c: dict[str, int]={}):\n  return a, b") == (4, 2) and C.defined_counts("def f():\n  pass") == (0, 0) and C.defined_counts(None) == (0, 0)
    assert text(spark, C.called_functions(F.col("t")), "x = g(1)\ndef f():\n  a = h(1)\n  b = len(a)\n  c = m.k(1)") == ["h"]
    assert C.function_blocks("Parameters:\nnothing else") == [] and C.function_blocks(None) == [] and C.generated_problem("x") is None
    found = C.definitions("import os\ndef a(x):\n  return x\ndef b():\n  pass", "m.py")
    assert [(f["function_name"], f["import_lines"]) for f in found] == [("a", ["import os"]), ("b", ["import os"])]


def test_cross_check_and_agreement(spark):
    points = spark.createDataFrame([(1, "a"), (1, "b")], "k int, point string")
    replies = spark.createDataFrame([(1, "a", "False"), (1, "a", "True"), (1, "b", "False")], "k int, point string, reply string")
    got = responder.hit_points(points, replies, ["k", "point"], F.col("reply") == "True").collect()
    assert {r.point: r.removed for r in got} == {"a": True, "b": False}
    solved = spark.createDataFrame([(1, 2.0, 2.0), (1, 2.000001, 2.0), (2, None, 1.0)], "k int, x double, y double")
    assert {r.k: r.accepted for r in responder.all_agree(solved, ["k"], "x", "y").collect()} == {1: True, 2: False}


def plain_removal(points, docs, answer, hits):
    """One point after another, as lists."""
    points, docs, lines = list(points), [list(d) for d in docs], answer.split("\n")
    for p in hits:
        if p in points:
            points.remove(p)
        k = 0
        while k < len(docs):
            found = p in docs[k]
            if found:
                docs[k].remove(p)
            if not docs[k]:
                del docs[k]
            else:
                k += 1
            if found:
                break
        for i, x in enumerate(lines):
            t = x.strip()
            if p.strip() in (t, t[1:].strip() if t[:1] == "-" else t):
                del lines[i]
                break
    return points, docs, "\n".join(lines).strip() if hits else answer


def test_removed_points_equal_the_plain_way(spark):
    cases = [
        (["a", "b", "a"], [["a"], ["b"], ["a"]], "- a\nb\n - a", ["a"]), (["a", "b"], [[], ["a"], [], ["b"]], "- a\n- b", ["b"]), (["a"], [[], ["x"], []], "- c", ["a"]),
        (["a", "b"], [["a", "b"]], "a\n-b", ["a", "b"]), (["a"], [["a"]], " a ", []), (["a", "a"], [["a", "a"]], "- a\n- a", ["a", "a"]),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p array<string>, d array<array<string>>, a string, h array<string>")
    got = {r.i: (r.x.points, r.x.docs, r.x.answer) for r in df.select("i", V.without_hits(F.col("p"), F.col("d"), F.col("a"), F.col("h")).alias("x")).collect()}
    assert got == {i: plain_removal(*c) for i, c in enumerate(cases)}


def test_conclusions_leave_the_documents(spark):
    info = "Document 1 Answer points assigned: Conclusion: x\n- a\n- Conclusion: y\nconclusion: z\nDocument 2 Answer points assigned: b"
    assert text(spark, postprocess.without_conclusion_lines(F.col("t")), info) == "Document 1 Answer points assigned:\n- a\nDocument 2 Answer points assigned: b"


def test_bullets_are_cut_before_they_are_trimmed(spark):
    rows = spark.createDataFrame([("- a\n  - b\nc\n\n", "Document 1:\n- a")], "Answer string, Documents_Info string")
    got = postprocess.answer_points(rows, conclusions=True).first()
    assert got.Ans_Points == ["a", "- b", "c"] and got.Doc_Ans_Points == [["a"]] and got.Reason is None
    plain = postprocess.answer_points(rows).first()
    assert plain.Ans_Points == ["a", "b", "c"] and plain.Reason == "unmatched_points"
