import random

import pytest
from pyspark.sql import functions as F

from qaloom.operators import sampling
from qaloom.operators import similarity as S


def words(rng, most=7, letters="abcdefgh"):
    return " ".join(rng.choices(letters, k=rng.randint(0, most)))


def alike(a, b):
    x, y = set(a.split()), set(b.split())
    return 100.0 if not x | y else 100 * len(x & y) / len(x | y)


def test_histogram_counts_empty_texts_and_scopes(spark):
    rng = random.Random(3)
    rows = [(i, words(rng), f"b{i % 3}", f"t{i % 2}") for i in range(80)] + [(100 + i, "", "b0", "t0") for i in range(3)]
    df = spark.createDataFrame(rows, "k long, t string, batch string, kind string")
    want = {}
    for b in (50, 70, 90):
        pairs = [(x, y) for i, x in enumerate(rows) for y in rows[:i] if alike(x[1], y[1]) >= b]
        want[b] = (len(pairs), sum(x[2] != y[2] for x, y in pairs), sum(x[3] != y[3] for x, y in pairs))
    got = {r.bound: (r.total, r.cross_batch, r.cross_type) for r in S.scoped_histogram(df, "k", "t", "batch", "kind", [50, 70, 90]).collect()}
    assert got == want
    plain = {r.bound: r.n for r in S.similarity_histogram(S.similar_pairs(df, "k", "t", 50), S.token_classes(df, "k", "t"), [50, 70, 90]).collect()}
    assert plain == {b: n for b, (n, _, _) in want.items()}


@pytest.mark.parametrize(("scope", "cross"), [("cross_batch", False), ("cross_batch", True), ("all", False), ("all", True), ("none", False)])
def test_near_duplicates_equal_the_plain_loop(spark, scope, cross):
    rng = random.Random(5)
    rows = [(i, words(rng, 4, "abcd"), f"b{rng.randrange(2)}", f"t{rng.randrange(2)}") for i in range(120)]
    dropped, want = set(), {}
    for j, (k, t, b, q) in enumerate(rows):
        hit = None
        for i, (h, u, c, p) in enumerate(rows[:j]):
            if scope != "none" and h not in dropped and alike(t, u) >= 60 and (cross or p == q) and (scope == "all" or b != c):
                hit = (h, round(alike(t, u), 6))
                break
        if hit:
            dropped.add(k)
        want[k] = (hit is None, *(hit or (None, None)))
    df = spark.createDataFrame(rows, "k long, t string, batch string, kind string").repartition(4)
    got = S.near_duplicates(df, "k", "t", "batch", "kind", 60, scope, cross).collect()
    assert {r.k: (r.kept, r.matched, None if r.similarity is None else round(r.similarity, 6)) for r in got} == want


def test_exact_duplicates(spark):
    rows = [(1, "x", "a"), (2, "x", "a"), (3, "x", "b"), (4, "y", "b")]
    got = S.exact_duplicates(spark.createDataFrame(rows, "k long, q string, b string"), "q", "k", "b").collect()
    assert {r.k: (r.kept, r.matched_batch, r.cross_batch) for r in got} == {1: (True, None, None), 2: (False, "a", False), 3: (False, "a", True), 4: (True, None, None)}


def test_admission_equals_the_plain_loop(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["g", "h", None]), words(rng, 4, "abcde")) for i in range(90)]
    kept: dict = {}
    want = {}
    for k, g, t in rows:
        hit = next((h for h, u in kept.get(g, []) if alike(t, u) >= 60), None)
        want[k] = hit is None
        if hit is None:
            kept.setdefault(g, []).append((k, t))
    got = S.admitted(spark.createDataFrame(rows, "k long, g string, t string").repartition(3), "k", "t", ["g"], 60).collect()
    assert {r.k: r.kept for r in got} == {k: w for k, w in want.items()}


def test_scenario_admission_equals_the_plain_loop(spark):
    rng = random.Random(9)
    prior = [(-i, words(rng, 3, "abc"), words(rng, 3, "xyz")) for i in range(1, 6)]
    rows = [(i, words(rng, 3, "abc"), words(rng, 3, "xyz"), rng.random() < 0.8) for i in range(80)]
    kept, want = [(p, e) for _, p, e in prior], {}
    for k, p, e, ok in rows:
        near = any((alike(p, q) + alike(e, f)) / 2 >= 60 for q, f in kept)
        want[k] = "area" if not ok else "alike" if near else None
        if want[k] is None:
            kept.append((p, e))
    now = spark.createDataFrame(rows, "k long, p string, e string, ok boolean").repartition(3)
    got = S.admitted_scenarios(now, "k", "p", "e", F.col("ok"), spark.createDataFrame(prior, "k long, p string, e string")).collect()
    assert {r.k: r.reason for r in got} == want


def test_dissimilar_draws_end_and_hold(spark):
    rows = [(i, f"p{i % 7}", f"e{i % 5}") for i in range(60)] + [(100, "", ""), (101, "p1 p2", "e1")]
    got = S.dissimilar_draws(spark.createDataFrame(rows, "k long, p string, e string"), "k", "p", "e", 4, 3).collect()
    of = {k: (p, e) for k, p, e in rows}
    for r in got:
        assert r.k != r.other and (alike(of[r.k][0], of[r.other][0]) + alike(of[r.k][1], of[r.other][1])) / 2 < 20
    per: dict = {}
    for r in got:
        per.setdefault(r.k, []).append(r)
    assert all(sorted(x.nth for x in v) == list(range(1, len(v) + 1)) and len({x.other for x in v}) == len(v) <= 4 for v in per.values())
    same = spark.createDataFrame([(i, "p", "e") for i in range(20)], "k long, p string, e string")
    assert S.dissimilar_draws(same, "k", "p", "e", 2, 3).count() == 0


def test_context_draws_without_reuse(spark):
    prompts = spark.createDataFrame([(p, n) for p in (1, 2) for n in range(3)], "problem int, nth int")
    pool = spark.createDataFrame([(f"f{i}",) for i in range(12)], "name string")
    similar = spark.createDataFrame([(1, "f1"), (1, "f2")], "problem int, name string")
    got: dict = {}
    for r in sampling.context_draws(prompts, pool, similar, 4, 1).collect():
        got.setdefault((r.problem, r.nth), set()).add(r.name)
    assert len(got[1, 0]) == len(got[1, 1]) == 4 and got[1, 0].isdisjoint(got[1, 1]) and len(got[1, 2]) == 2 and not {"f1", "f2"} & set().union(*(got[1, n] for n in range(3)))
    assert sorted(len(got[2, n]) for n in range(3)) == [4, 4, 4]


def test_context_draws_look_at_drawn_pairs_only(spark):
    prompts = spark.createDataFrame([(p, n) for p in (1, 2, 3) for n in range(2)], "problem int, nth int")
    pool = spark.createDataFrame([(f"f{i}", i) for i in range(300)], "name string, i int")
    looked = []

    def unlike(seen):
        looked.append(seen.count())
        return seen.where((F.col("problem") == 1) | ((F.col("problem") == 2) & (F.col("i") % 10 == 0)) | ((F.col("problem") == 3) & (F.col("i") < 7)))

    got: dict = {}
    for r in sampling.context_draws(prompts, pool, unlike, 5, 1).collect():
        got.setdefault((r.problem, r.nth), set()).add(int(r.name[1:]))
    assert {k: len(v) for k, v in got.items()} == {(1, 0): 5, (1, 1): 5, (2, 0): 5, (2, 1): 5, (3, 0): 5, (3, 1): 2}
    assert all(i % 10 == 0 for n in (0, 1) for i in got[2, n]) and got[3, 0] | got[3, 1] == set(range(7))
    similar = spark.createDataFrame([(2, f"f{i}") for i in range(300) if i % 10] + [(3, f"f{i}") for i in range(7, 300)], "problem int, name string")
    plain: dict = {}
    for r in sampling.context_draws(prompts, pool, similar, 5, 1).collect():
        plain.setdefault((r.problem, r.nth), set()).add(int(r.name[1:]))
    assert plain == got and looked[0] == 3 * 20


def test_digests_lose_no_pair_and_few_pairs_pass(spark, monkeypatch):
    rng = random.Random(21)
    base = [rng.sample(range(3_000), rng.choice([3, 40, 90, 200])) for _ in range(60)]
    sets = {tuple(sorted({w if rng.random() < 0.8 else rng.randrange(3_000) for w in b})) for b in base for _ in range(3)}
    rows = [(i, [f"w{x}" for x in t], 1) for i, t in enumerate(sets)]
    want = {(i, j) for i, t, _ in rows for j, u, _ in rows if i < j and 100 * len(set(t) & set(u)) >= 50 * len(set(t) | set(u))}
    close = []
    real = S.written

    def noted(df, name):
        out = real(df, name)
        close.extend([out] * (name == "close"))
        return out

    monkeypatch.setattr(S, "written", noted)
    monkeypatch.setattr(S, "BLOCK_ROWS", 25)
    got = S.pairs_of_classes(spark.createDataFrame(rows, "rep long, tokens array<string>, members int"), 50).collect()
    assert {(r.i, r.j) for r in got} == want and len(got) == len(want) > 50
    assert close[0].count() < 4 * len(want)
