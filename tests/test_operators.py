import math
import random

import pytest
from pyspark.sql import functions as F

from qaloom.functions import keys, python_checks, statistics, text
from qaloom.operators import guards, panel, relations, responder, sampling, similarity, testing
from qaloom.sources import files
from qaloom.streaming import judgments
from tests.fixtures import SCHEMA, votes


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_verdicts_of_known_patterns(spark):
    v = spark.createDataFrame(votes({"PASS": 20, "FAIL": 15, "DISAGREE": 18}), SCHEMA)
    q = panel.question_scores(panel.consensus(v))
    got = {(r.Verdict, round(r.Pass_Frac, 3), round(r.No_Majority_Frac, 3)): r["count"] for r in q.groupBy("Verdict", "Pass_Frac", "No_Majority_Frac").count().collect()}
    assert got == {("PASS", 0.889, 0.0): 20, ("FAIL", 0.444, 0.0): 15, ("DISAGREE", 0.556, 0.444): 18}
    unanimous = panel.question_scores(panel.unanimous_label(v), label="Label")
    assert {r.Verdict: r["count"] for r in unanimous.groupBy("Verdict").count().collect()} == {"PASS": 20, "FAIL": 15, "DISAGREE": 18}


@pytest.mark.parametrize(("pair", "mode", "label", "mean", "split"), [(("Unsure", "Unsure"), "exclude", "Undecided", None, True), (("Yes", "Unsure"), "exclude", "Yes", 1.0, False), (("Yes", "Unsure"), "half", "Yes", 0.75, True), (("Yes", "Unsure"), "zero", "DISAGREE", 0.5, True)])
def test_unsure_modes(spark, pair, mode, label, mean, split):
    v = spark.createDataFrame([("t", "b", "reg", 1, 1, f"j{i}", x) for i, x in enumerate(pair)], SCHEMA)
    r = panel.consensus(v, mode).first()
    assert (r.Consensus, r.Mean_Score, r.Non_Unanimous) == (label, mean, split)


def test_keys_that_collide_across_batch_and_type(spark):
    rows = [(t, b, "reg", 1, 1, "j1", x) for t, b, x in (("type1", "b1", "Yes"), ("type1", "b2", "No"), ("type2", "b1", "Unsure"))]
    assert panel.consensus(spark.createDataFrame(rows, SCHEMA)).count() == 3


def test_guards(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "z")], "k int, v string")
    for broken in (lambda: guards.require_unique(df, ["k"]), lambda: guards.require_no_nulls(df, ["v"]), lambda: guards.require_domain(df, "v", ["a", "z"]), lambda: guards.require_columns(df, ["q"]), lambda: guards.require_same_columns(df, df.select("k"))):
        with pytest.raises(guards.RelationError):
            broken()
    assert guards.duplicate_keys(df, ["k"]).count() == 1 and guards.drop_header_rows(spark.createDataFrame([("v",), ("x",)], "v string"), "v").count() == 1
    with pytest.raises(Exception, match="positive"):
        guards.require(df, F.col("k") > 1, "k must be positive").collect()


def test_qid_meets_its_definition(spark):
    import hashlib

    got = one(spark, keys.qid(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a="type1", b="  p ", c="e\n", d="q")
    assert got == "q" + hashlib.sha1("type1\0p\0e\0q".encode()).hexdigest()[:16]


def test_mcnemar_goldens(spark):
    df = spark.createDataFrame([(57, 46), (72, 50), (45, 78), (0, 0), (3000, 2900)], "b long, c long")
    got = [r.p for r in df.select(statistics.binomial_two_sided(F.col("b"), F.col("c")).alias("p")).collect()]
    assert [round(p, 4) for p in got[:3]] == [0.3245, 0.0568, 0.0037] and got[3] is None and 0.19 < got[4] < 0.21


def test_p_values(spark):
    df = spark.createDataFrame([(1.959964, 3.841459), (0.0, 0.0)], "z double, x double")
    got = df.select(statistics.normal_two_sided("z").alias("a"), statistics.chi_square_one("x").alias("b")).collect()
    assert [round(v, 4) for r in got for v in r] == [0.05, 0.05, 1.0, 1.0]


def test_holm(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "key string, p double")
    got = {r.key: (r.rejected, round(r.adjusted, 3)) for r in testing.holm(t, "p", "key").collect()}
    assert got == {"d": (True, 0.02), "a": (True, 0.03), "c": (False, 0.06), "b": (False, 0.06)}


def test_greedy_selection_keeps_what_only_a_dropped_row_blocks(spark):
    chain = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (4, 6), (5, 6)], "i long, j long")
    got = {r.node: (r.kept, r.blocker) for r in similarity.greedy_selection(chain).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (True, None), 5: (False, 4), 6: (False, 4)}


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 7)))) for i in range(120)]
    least: dict = {}
    for i, t in rows:
        least.setdefault(frozenset(t.split()), i)
    reps = sorted((i, s) for s, i in least.items())
    want = {(i, j) for i, s in reps for j, t in reps if i < j and 100 * len(s & t) / len(s | t) >= 60}
    got = {(r.i, r.j) for r in similarity.similar_pairs(spark.createDataFrame(rows, "k long, t string"), "k", "t", 60).collect()}
    assert got == want


def test_relations(spark):
    df = spark.createDataFrame([(f"k{i:02d}", i) for i in range(23)], "k string, v long").repartition(5)
    got = relations.positions(df, ["k"])
    assert [(r.k, r.row_idx) for r in got.orderBy("k").collect()] == [(f"k{i:02d}", i) for i in range(23)]
    sizes = [r["count"] for r in relations.shard_contiguous(got, 4, 23).groupBy("shard").count().orderBy("shard").collect()]
    assert sizes == [6, 6, 6, 5]
    with pytest.raises(guards.RelationError):
        relations.join_one_to_one(df, df.where("v < 5").select("k"), ["k"], lose_none=True)
    assert {r.k: r.v for r in relations.first_of(df.union(df.withColumn("v", F.col("v") + 100)), ["k"], ["v"]).collect()} == {f"k{i:02d}": i for i in range(23)}
    assert relations.same_rows(df, df) and not relations.same_rows(df, df.limit(3))


def test_parsers(spark):
    raw = "```\n1. **First?** \n 3) second\nno\n2.\n10. third\n```"
    assert one(spark, text.numbered_lines(F.col("t")), t=raw) == ["First?", "second", "third"]
    assert one(spark, text.verdict_lines(F.col("t"), F.lit(4)), t="2) NO way\n1. yes\n2. yes\n9. no\n```\n3. maybe") == ["Yes", "No", "Unsure", "Unsure"]
    assert one(spark, text.bullet_points(F.col("t")), t="- a\n\n-b \n c-d\n -") == ["a", "b", "c-d", ""]
    assert one(spark, text.py_tokens(F.col("t")), t=" A  b\tC\n") == ["a", "b", "c"] and one(spark, text.py_tokens(F.col("t")), t="") == []
    assert one(spark, text.answer_number(F.col("t")), t="So The answer is **$1,234.50**.") == 1234.5 and one(spark, text.answer_number(F.col("t")), t="none") is None
    assert one(spark, text.truth_number(F.col("t")), t="x\n#### 1,000") == 1000.0
    assert one(spark, text.decoded_json_list(F.col("t")), t='"[\\"a\\"]"') == ["a"]
    assert tuple(one(spark, text.empty_bullets(F.array(F.lit("a"), F.lit(" "), F.lit("b"), F.lit(""))), t=1)) == (1, 1, 2)
    assert one(spark, text.cut_document(F.col("t")), t="hm Title: x\ny In conclusion, z") == "Title: x\ny"
    assert one(spark, text.graded_correct(F.col("t")), t="INCORRECT") and not one(spark, text.graded_correct(F.col("t"), False), t="incorrect")
    assert one(spark, text.said_true(F.col("t"), "END"), t="It is True END false") is True and one(spark, text.said_true(F.col("t"), "END"), t="true") is None


def test_python_checks():
    assert python_checks.arithmetic("2 * (3 + 4) ^ 2") == 98 and python_checks.arithmetic("-7 % 3") == 2
    for bad in ("__import__('os')", "9 ** 9 ** 9", "x + 1", "1 if 1 else 2"):
        with pytest.raises((ValueError, SyntaxError)):
            python_checks.arithmetic(bad)
    good = "Calculation:\nStep 1: a = 2 + 3 = 5\nStep 2: b = 5 * 2 = 10\nStep 3: c = 1 + 1 = 2\nQuestion: q"
    assert python_checks.grounded(good) == (True, None)
    assert python_checks.grounded(good.replace("= 10", "= 11"))[1] == "mismatch" and python_checks.grounded("x")[1] == "no calculation"
    assert python_checks.grounded(good.replace("5 * 2 = 10", "4 * 2 = 8"))[1] == "independent steps" and python_checks.grounded(good.replace("Step 3", "Part 3"))[1] == "too few steps"
    assert python_checks.uses_result_in_assert("r = m.f(1)\nassert r == 2", "f") and not python_checks.uses_result_in_assert("f(1)\nassert True", "f")


def test_longest_repeat_equals_the_plain_search():
    def plain(t, least=8):
        w, best, n = t.split(), "", least
        while n <= len(w):
            seen: dict = {}
            for i in range(len(w) - n + 1):
                seen.setdefault(tuple(w[i : i + n]), []).append(i)
            many = [k for k, v in seen.items() if len(v) > 1]
            if not many:
                break
            best, n = " ".join(many[0]), n + 1
        return best

    rng = random.Random(2)
    for _ in range(200):
        t = " ".join(rng.choices("ab" if rng.random() < 0.5 else "abcd", k=rng.randint(0, 60)))
        assert python_checks.longest_repeat(t) == plain(t)


def test_sampling(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(90)], "key long, s string")
    a, b = (sampling.stratified(rows.repartition(n), "s", "key", 5, 1).select("key").collect() for n in (2, 7))
    assert sorted(a) == sorted(b) and len(a) == 15 and sorted(a) != sorted(sampling.stratified(rows, "s", "key", 5, 2).select("key").collect())
    counts = spark.createDataFrame([("1", 47), ("2", 45), ("3", 43), ("4", 10)], "stratum string, n long")
    assert [r.allocated for r in sampling.largest_remainder(counts, 30).orderBy("stratum").collect()] == [10, 9, 9, 2]
    with pytest.raises(guards.RelationError):
        sampling.require_sample(rows, "s", {"a": 31})
    types = spark.createDataFrame([("t1", 0.5, 33.3), ("t2", 0.6, 33.3), ("t3", 0.7, 33.4)], "t string, acc double, w double")
    assert [r.w for r in sampling.reallocated(types, 0.75, 10, 5).orderBy("t").collect()] == [33.3, 33.3, 33.4]
    moved = {r.t: round(r.w, 2) for r in sampling.reallocated(types, 0.6, 30, 10).collect()}
    assert moved == {"t1": 80.0, "t2": 10.0, "t3": 10.0}


def test_tsv_round_trip(spark, tmp_path):
    rows = [("a\tb", 'q"uo"te', "line\nend"), ("", " lead", "NA"), (None, "x", "é")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    files.write_tsv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_tsv(spark, str(tmp_path / "t"), ["a", "b", "c"]).collect()), key=str) == sorted(rows, key=str)
    assert files.write_checked(df.where("a is not null"), str(tmp_path / "u")).count() == 2
    got = files.read_tsv(spark, str(tmp_path / "t"), ["a", "b", "c"], missing=True).where("c is null").count()
    assert got == 1


def test_marker_blocks_and_json(spark, tmp_path):
    (tmp_path / "m.txt").write_text("P: one\nD: two\nR: 3\nnoise\nP: a\nD: b\n")
    assert [tuple(r)[1:] for r in files.read_markers(spark, str(tmp_path / "m.txt"), ["P", "D", "R"]).collect()] == [(1, "one", "two", "3")]
    (tmp_path / "j.json").write_text('{"1": {"x": "a"}, "2": {"x": "b"}}')
    assert sorted((r.id, r.value.x) for r in files.read_json_map(spark, str(tmp_path / "j.json"), "struct<x:string>").collect()) == [("1", "a"), ("2", "b")]
    assert r"50\%" in files.latex_table(spark.createDataFrame([("50%",)], "a_b string"), "c")


def test_responder(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "k int, prompt string")
    r = spark.createDataFrame([("a", "yes"), ("a", "no")], "prompt string, reply string")
    assert {x.k: x.reply for x in responder.replay(p, r).collect()} == {1: "no", 2: None}
    attempts = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 4, True)], "k int, attempt int, ok boolean")
    assert [(x.k, x.attempt) for x in responder.first_success(attempts, ["k"], "attempt", F.col("ok"), 3).collect()] == [(1, 2)]


def test_bootstrap_is_as_wide_as_a_random_one(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    for clusters in (7, 20, 200):
        rows = [(f"c{i % clusters:03d}", int(rng.random() < 0.5 + 0.3 * (i % clusters % 3 - 1)), int(rng.random() < 0.5)) for i in range(1_200)]
        r = testing.cluster_bootstrap(spark.createDataFrame(rows, "cluster string, a int, b int"), "cluster", 4_000).first()
        d, n = np.zeros(clusters), np.zeros(clusters)
        for c, a, b in rows:
            d[int(c[1:])] += a - b
            n[int(c[1:])] += 1
        picks = rng.integers(0, clusters, (40_000, clusters))
        means = d[picks].sum(1) / n[picks].sum(1)
        lo, hi = np.percentile(means, [2.5, 97.5])
        assert abs((r.hi - r.lo) / (hi - lo) - 1) < 0.06 and abs(r.mean - means.mean()) < 0.01 and abs(r.lo - lo) < 0.03


def test_tests_meet_known_values(spark):
    assert math.isclose(statistics.student_two_sided(2.228139, 10), 0.05, abs_tol=1e-6) and math.isclose(statistics.student_two_sided(1.0, 1), 0.5, abs_tol=1e-12) and statistics.student_two_sided(0.0, 5) == 1.0
    assert math.isclose(statistics.signed_rank_two_sided(10, 8), 0.048828125) and statistics.signed_rank_two_sided(4, 5) == 1.0
    d = spark.createDataFrame([("x", float(v)) for v in (1, -2, 3, 4, 5, 6, 7, 8, -9, 10, 0)] + [("y", 1.0), ("y", 1.0)], "g string, d double")
    w = {r.g: r for r in testing.wilcoxon(d, "d", ["g"]).collect()}
    assert (w["x"].n, w["x"].w_plus, w["x"].w_minus) == (10, 44.0, 11.0) and math.isclose(w["x"].p, statistics.signed_rank_two_sided(10, 11)) and 0 < w["y"].p < 1
    t = {r.g: r for r in testing.paired_t(d, "d", ["g"]).collect()}
    assert math.isclose(t["x"].t, 3.0 / (5.477225575051661 / 11**0.5), rel_tol=0.2) and t["y"].t is None and t["y"].p is None


def test_binomial_of_many(spark):
    df = spark.createDataFrame([(3_000_000_000, 2_999_900_000), (30_000, 30_600), (9_000, 9_300), (0, 5)], "b long, c long")
    p = [r.p for r in df.select(statistics.binomial_two_sided(F.col("b"), F.col("c")).alias("p")).collect()]
    z = lambda b, c: math.erfc((abs(b - c) - 1) / math.sqrt(b + c) / math.sqrt(2))
    assert all(math.isclose(x, z(b, c), rel_tol=2e-3) for x, (b, c) in zip(p, ((3_000_000_000, 2_999_900_000), (30_000, 30_600), (9_000, 9_300)), strict=False)) and p[3] == 0.0625


def test_deep_expressions_are_unparsed():
    deep = "Calculation:\nStep 1: a = " + "(" * 5000 + "1" + ")" * 5000 + " = 1\nStep 2: b = " + "-" * 50_000 + "1 = 1\nStep 3: c = 1 + 1 = 2"
    assert python_checks.grounded(deep) == (False, "unparsed step") and python_checks.literals("(" * 5000) == []


def test_guards_of_stages(spark):
    df = spark.createDataFrame([("a", "reg"), ("a", "generic"), (None, "reg")], "k string, Seed_Type string")
    assert guards.with_support(df, ["k"], 2).count() == 2 and guards.with_support(df, ["k"], 1).count() == 3 and guards.track_rows(df, "reg").count() == 2
    for broken in (lambda: guards.track_rows(df, "other"), lambda: guards.require_same_count(df, df.limit(1)), lambda: relations.merged_shards({1: df, 2: None}, {1, 2}), lambda: relations.merged_shards({1: None}, set(), False)):
        with pytest.raises(guards.RelationError):
            broken()
    assert relations.merged_shards({1: df, 2: None}, {1}).count() == 3
    with pytest.raises(Exception, match="without"):
        relations.remapped(df, df.where("k is not null").select("k", F.lit(1).alias("v")).distinct(), ["k"], "v").collect()


def test_summaries_leave_no_view(spark):
    v = spark.createDataFrame(votes({"PASS": 2}), SCHEMA)
    assert panel.summary_sets(panel.question_scores(panel.consensus(v, key=[*panel.CRITERION, "Seed_Type"]), key=[*panel.QUESTION, "Seed_Type"]), ["Seed_Type"]).count() == 2
    assert all(t.name != "_scores" for t in spark.catalog.listTables())
    modes = {r.unsure_mode: r.Pass_Frac for r in panel.mode_fractions(spark.createDataFrame([("t", "b", "reg", 1, c, j, x) for c, pair in enumerate([("Yes", "Unsure"), ("Unsure", "Unsure"), ("No", "Unsure")]) for j, x in zip("xy", pair, strict=True)], SCHEMA)).collect()}
    assert {m: round(x, 3) for m, x in modes.items()} == {m: round(panel.question_scores(panel.consensus(spark.createDataFrame([("t", "b", "reg", 1, c, j, x) for c, pair in enumerate([("Yes", "Unsure"), ("Unsure", "Unsure"), ("No", "Unsure")]) for j, x in zip("xy", pair, strict=True)], SCHEMA), m)).first().Pass_Frac, 3) for m in panel.MODES}


def test_stream_equals_batch(spark, tmp_path):
    v = spark.createDataFrame(votes({"PASS": 3, "DISAGREE": 2}), SCHEMA).repartition(3)
    v.write.json(str(tmp_path / "log"))
    q = judgments.running_consensus(judgments.deduplicated(judgments.read_log(spark, str(tmp_path / "log")))).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    assert relations.same_rows(spark.table("running"), panel.consensus(v))
    judgments.to_table(judgments.read_log(spark, str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == v.count()


def test_siblings_are_parsed_once_and_by_many_tasks(spark):
    from qaloom.operators import postprocess

    one = [(1, "q", "- a", "Document 1: a", ["a"], [["a"]], ["x"], ["- a"], ["Document 1 Title: T\n- a"])]
    names = "ID long, Question string, Answer string, Documents_Info string, Ans_Points array<string>, Doc_Ans_Points array<array<string>>, Adv_Question array<string>, Adv_Answer array<string>, Adv_Documents_Info array<string>"
    groups, _, _ = postprocess.sibling_groups(spark.createDataFrame(one * 8, names).coalesce(1))
    plan = groups._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and "Repartition 4, true" in plan and groups.count() == 8
