"""Near duplicates of questions, admission of questions and scenarios, two-level gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaloom.functions.keys import qid
from qaloom.operators import relations as R
from qaloom.operators import similarity as S
from qaloom.plans.derived import CORPUS_SQL, corpus
from qaloom.plans.registry import query
from qaloom.tables import load, written

_T = "list_sort(list_distinct(list_filter(regexp_split_to_array(lower({0}), '[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+'), lambda x: x <> '')))"
_CLASSES = f"""{CORPUS_SQL}, toks AS (SELECT doc_id, Batch, QA_Type, {_T.format('Question')} AS t FROM corpus),
 cls AS MATERIALIZED (SELECT t, min(doc_id) AS rep, count(*) AS members FROM toks GROUP BY t),
 ex AS MATERIALIZED (SELECT rep, len(t) AS n, members, unnest(t) AS w FROM cls),
 inter AS (SELECT a.rep AS i, b.rep AS j, a.n AS ni, b.n AS nj, a.members AS members_i, b.members AS members_j, count(*) AS c FROM ex a JOIN ex b ON a.w = b.w AND a.rep < b.rep GROUP BY ALL),
 prs AS MATERIALIZED (SELECT i, j, members_i, members_j, 100.0 * c / (ni + nj - c) AS similarity FROM inter WHERE 100.0 * c / (ni + nj - c) >= 50)"""


def _pairs(spark, sf_dir, least):
    return S.similar_pairs(corpus(spark, sf_dir), "doc_id", "Question", least)


@query(f"WITH {_CLASSES} SELECT i, j, members_i, members_j, round(similarity, 4) AS similarity FROM prs WHERE similarity >= 50")
def jaccard_pairs(spark, sf_dir):
    """Pairs of distinct questions at least half alike, with how many rows each stands for."""
    return _pairs(spark, sf_dir, 50).withColumn("similarity", F.round("similarity", 4))


@query(f"""WITH {_CLASSES}, b AS (SELECT unnest([50, 60, 70, 80, 90]) AS bound), c AS (SELECT CAST(coalesce(sum(members * (members - 1) / 2), 0) AS BIGINT) AS copies FROM cls)
 SELECT bound, CAST(coalesce((SELECT sum(members_i * members_j) FROM prs WHERE similarity >= bound), 0) + copies AS BIGINT) AS n FROM b, c""")
def jaccard_histogram(spark, sf_dir):
    classes = written(S.token_classes(corpus(spark, sf_dir), "doc_id", "Question"), "classes")
    return S.similarity_histogram(S.pairs_of_classes(classes, 50), classes, [50, 60, 70, 80, 90])


_ROWS = f"""{_CLASSES}, own AS MATERIALIZED (SELECT doc_id AS k, Batch, QA_Type, rep FROM toks JOIN cls USING (t)), rows_ AS MATERIALIZED (
 SELECT x.k AS i, y.k AS j, similarity, x.Batch IS DISTINCT FROM y.Batch AS xb, x.QA_Type IS DISTINCT FROM y.QA_Type AS xt FROM prs p JOIN own x ON x.rep = p.i JOIN own y ON y.rep = p.j
 UNION ALL SELECT x.k, y.k, 100.0, x.Batch IS DISTINCT FROM y.Batch, x.QA_Type IS DISTINCT FROM y.QA_Type FROM own x JOIN own y ON x.rep = y.rep AND x.k < y.k)"""


@query(f"""WITH {_ROWS} SELECT bound, count(*) FILTER (similarity >= bound) AS total, count(*) FILTER (similarity >= bound AND xb) AS cross_batch, count(*) FILTER (similarity >= bound AND xt) AS cross_type FROM rows_, (SELECT unnest([50, 60, 70, 80, 90]) AS bound) GROUP BY bound""")
def neardup_histogram(spark, sf_dir):
    """Pairs of rows by similarity: all, across batches, across types."""
    return S.scoped_histogram(corpus(spark, sf_dir), "doc_id", "Question", "Batch", "QA_Type", [50, 60, 70, 80, 90])


_GREEDY = """e AS MATERIALIZED (SELECT least(i, j) AS i, greatest(i, j) AS j, max(similarity) AS similarity FROM {0} GROUP BY 1, 2), nodes AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) AS r FROM (SELECT i AS node FROM e UNION SELECT j FROM e)),
 g(r, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT g.r + 1, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.j = n.node AND list_contains(g.kept, e.i)) THEN g.kept ELSE list_append(g.kept, n.node) END FROM g JOIN nodes n ON n.r = g.r + 1),
 k AS MATERIALIZED (SELECT kept FROM g ORDER BY r DESC LIMIT 1)"""


@query(f"""WITH RECURSIVE {_CLASSES}, {_GREEDY.format('prs WHERE similarity >= 60')}
 SELECT node, list_contains((SELECT kept FROM k), node) AS kept, CASE WHEN NOT list_contains((SELECT kept FROM k), node) THEN (SELECT min(i) FROM e WHERE j = node AND list_contains((SELECT kept FROM k), i)) END AS blocker FROM nodes""")
def neardup_greedy(spark, sf_dir):
    """Of similar questions, in order, those that no kept one blocks."""
    return S.greedy_selection(_pairs(spark, sf_dir, 60))


_SCOPED = """WITH RECURSIVE {rows}, {greedy} SELECT own.k AS doc_id, matched IS NULL AS kept, matched, round(similarity, 4) AS similarity FROM own LEFT JOIN (SELECT j, min(i) AS matched, arg_min(similarity, i) AS similarity FROM e WHERE list_contains((SELECT kept FROM k), i) GROUP BY j) ON j = own.k"""


def _dropped(spark, sf_dir, **how):
    return S.near_duplicates(corpus(spark, sf_dir), "doc_id", "Question", "Batch", "QA_Type", 60, **how).withColumn("similarity", F.round("similarity", 4))


@query(_SCOPED.format(rows=_ROWS, greedy=_GREEDY.format("rows_ WHERE similarity >= 60 AND xb AND NOT xt")))
def neardup_cross_batch(spark, sf_dir):
    """Rows dropped for an earlier kept one of another batch and the same type."""
    return _dropped(spark, sf_dir)


@query(_SCOPED.format(rows=_ROWS, greedy=_GREEDY.format("rows_ WHERE similarity >= 60")))
def neardup_all(spark, sf_dir):
    """Rows dropped for an earlier kept one, whatever its batch and type."""
    return _dropped(spark, sf_dir, scope="all", cross_type=True)


@query(f"""WITH {CORPUS_SQL}, q AS (SELECT doc_id, Batch, 'q' || substr(sha1(coalesce(QA_Type, '') || chr(0) || chr(0) || chr(0) || regexp_replace(Question, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')), 1, 16) AS QID FROM corpus), f AS (SELECT *, min(doc_id) OVER (PARTITION BY QID) AS first FROM q)
 SELECT f.doc_id, f.QID, f.doc_id = f.first AS kept, CASE WHEN f.doc_id <> f.first THEN h.Batch END AS matched_batch, CASE WHEN f.doc_id <> f.first THEN h.Batch IS DISTINCT FROM f.Batch END AS cross_batch FROM f JOIN q h ON h.doc_id = f.first""")
def exact_qid_dedup(spark, sf_dir):
    """Rows of equal content keys: the first stays, the others name its batch."""
    none = F.lit("")
    rows = corpus(spark, sf_dir).select("doc_id", "Batch", qid(F.col("QA_Type"), none, none, F.col("Question")).alias("QID"))
    return S.exact_duplicates(rows, "QID", "doc_id", "Batch").select("doc_id", "QID", "kept", "matched_batch", "cross_batch")


@query(f"""WITH {_CLASSES} SELECT doc_id, rep AS kept_as, doc_id <> rep AS dropped FROM toks JOIN cls USING (t)""")
def exact_question_classes(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    sets = rows.select("doc_id", S.token_set(F.col("Question")).alias("tokens"))
    cls = S.token_classes(rows, "doc_id", "Question")
    return sets.join(cls, "tokens").select("doc_id", F.col("rep").alias("kept_as"), (F.col("doc_id") != F.col("rep")).alias("dropped"))


_NAME = "list_distinct(string_split(lower({0}), ' '))"


@query(f"""WITH RECURSIVE t AS MATERIALIZED (SELECT p_partkey AS k, p_brand AS g, {_NAME.format('p_name')} AS w FROM part), e0 AS MATERIALIZED (SELECT x.k AS i, y.k AS j FROM t x JOIN t y ON x.g = y.g AND x.k < y.k WHERE 100.0 * len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w)) >= 30),
 e AS MATERIALIZED (SELECT DISTINCT i, j FROM e0), st(r, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT st.r + 1, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.j = n.k AND list_contains(st.kept, e.i)) THEN st.kept ELSE list_append(st.kept, n.k) END FROM st JOIN (SELECT k, row_number() OVER (ORDER BY k) AS r FROM t) n ON n.r = st.r + 1),
 z AS MATERIALIZED (SELECT kept FROM st ORDER BY r DESC LIMIT 1) SELECT k, list_contains((SELECT kept FROM z), k) AS kept, (SELECT min(i) FROM e WHERE j = k AND list_contains((SELECT kept FROM z), i)) AS blocker FROM t""")
def question_admission(spark, sf_dir):
    """Names admitted to their brand one after another, unless an admitted one is 30 per cent alike."""
    return S.admitted(load(spark, sf_dir, "part"), "p_partkey", "p_name", ["p_brand"], 30).withColumnRenamed("p_partkey", "k")


_SCEN = f"""c0 AS MATERIALIZED (SELECT c_custkey AS k, c_mktsegment AS persona, n_name || ' ' || (c_custkey % 3) AS env, c_custkey % 11 <> 0 AS ok FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey > 20), pr AS (SELECT c_custkey AS k, c_mktsegment AS persona, n_name || ' ' || (c_custkey % 3) AS env FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey <= 20)"""


def _scenarios(spark, sf_dir):
    """Customers' segments and nations as scenarios; the first twenty are prior, every eleventh area is invalid."""
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    s = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("k"), F.col("c_mktsegment").alias("persona"), F.concat_ws(" ", "n_name", (k % 3).cast("string")).alias("env"))
    return s.where("k > 20"), s.where("k <= 20")


@query(f"""WITH RECURSIVE {_SCEN}, a AS MATERIALIZED (SELECT k, persona, env, ok, {_NAME.format('persona')} AS p, {_NAME.format('env')} AS e, row_number() OVER (PARTITION BY persona, env ORDER BY k) AS nth FROM (SELECT * FROM c0 WHERE ok)),
 pp AS MATERIALIZED (SELECT k, {_NAME.format('persona')} AS p, {_NAME.format('env')} AS e FROM pr), u AS MATERIALIZED (SELECT * FROM a WHERE nth = 1),
 sim AS MATERIALIZED (SELECT x.k AS i, y.k AS j FROM u x JOIN u y ON x.k < y.k WHERE (100.0 * len(list_intersect(x.p, y.p)) / len(list_distinct(x.p || y.p)) + 100.0 * len(list_intersect(x.e, y.e)) / len(list_distinct(x.e || y.e))) / 2 >= 60),
 old AS MATERIALIZED (SELECT y.k AS j, min(x.k) AS i FROM pp x JOIN u y ON (100.0 * len(list_intersect(x.p, y.p)) / len(list_distinct(x.p || y.p)) + 100.0 * len(list_intersect(x.e, y.e)) / len(list_distinct(x.e || y.e))) / 2 >= 60 GROUP BY y.k),
 st(r, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT st.r + 1, CASE WHEN n.k IN (SELECT j FROM old) OR EXISTS (SELECT 1 FROM sim WHERE sim.j = n.k AND list_contains(st.kept, sim.i)) THEN st.kept ELSE list_append(st.kept, n.k) END FROM st JOIN (SELECT k, row_number() OVER (ORDER BY k) AS r FROM u) n ON n.r = st.r + 1),
 z AS MATERIALIZED (SELECT kept FROM st ORDER BY r DESC LIMIT 1)
 SELECT c0.k, c0.ok AND list_contains((SELECT kept FROM z), c0.k) AS admitted, CASE WHEN NOT c0.ok THEN 'area' WHEN NOT list_contains((SELECT kept FROM z), c0.k) THEN 'alike' END AS reason FROM c0""")
def scenario_admission(spark, sf_dir):
    """Scenarios admitted one after another against prior ones and each other."""
    now, prior = _scenarios(spark, sf_dir)
    return S.admitted_scenarios(now, "k", "persona", "env", F.col("k") % 11 != 0, prior).select("k", "admitted", "reason")


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey > 20")
def emitted_scenarios(spark, sf_dir):
    """What a batch writes where only new scenarios are asked for."""
    now, prior = _scenarios(spark, sf_dir)
    return R.emitted(now.union(prior), prior, ["k"], "new").select("k")


@query(f"""WITH s AS (SELECT DISTINCT c_mktsegment AS persona, n_name AS env FROM customer JOIN nation ON n_nationkey = c_nationkey),
 x AS (SELECT *, {_NAME.format('persona')} AS p, {_NAME.format('env')} AS e FROM s),
 y AS (SELECT a.persona, a.env, b.persona AS other_persona, b.env AS other_env, 100.0 * len(list_intersect(a.p, b.p)) / len(list_distinct(a.p || b.p)) AS ps, 100.0 * len(list_intersect(a.e, b.e)) / len(list_distinct(a.e || b.e)) AS es
 FROM x a JOIN x b ON (a.persona, a.env) < (b.persona, b.env))
 SELECT persona, env, count(*) AS n_close, round(max((ps + es) / 2), 4) AS closest FROM y WHERE (ps + es) / 2 >= 50 GROUP BY ALL""")
def scenario_gate(spark, sf_dir):
    """Scenarios and how near the later ones come, as the mean of two similarities."""
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    s = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("persona"), F.col("n_name").alias("env")).distinct()
    s = s.withColumn("k", F.struct("persona", "env"))
    close = S.similar_scenarios(s, "k", "persona", "env", 50)
    return close.groupBy("i.persona", "i.env").agg(F.count(F.lit(1)).alias("n_close"), F.round(F.max("similarity"), 4).alias("closest"))


@query("""WITH t AS (SELECT p_name, p_type, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM (SELECT DISTINCT p_name, p_type FROM part)),
 z AS (SELECT x.p_name, x.p_type, 100.0 * len(list_intersect(x.a, y.a)) / len(list_distinct(x.a || y.a)) AS s1, 100.0 * len(list_intersect(x.b, y.b)) / len(list_distinct(x.b || y.b)) AS s2
 FROM t x JOIN t y ON (x.p_name, x.p_type) <> (y.p_name, y.p_type)) SELECT p_name, p_type, count(*) AS n_alike FROM z WHERE s1 > 30 AND s2 > 20 GROUP BY ALL""")
def two_level_gate(spark, sf_dir):
    """Functions with others alike in name (over 30) and objective (over 20): distinct names and distinct objectives meet first, then
    the functions that have them."""
    t = load(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    t = t.withColumn("a", S.token_set(F.col("p_name"))).withColumn("b", S.token_set(F.col("p_type")))

    def alike(c: str, over: int):
        sets = t.select(F.col(c).alias("tokens")).distinct().withColumn("rep", F.concat_ws(" ", "tokens"))
        own = sets.select("rep", "tokens")
        met = S.meetings(sets, over).join(own.toDF("i", "x"), "i").join(own.toDF("j", "y"), "j").where(S.jaccard(F.col("x"), F.col("y")) > over)
        return met.select("x", "y").union(met.select("y", "x")).union(own.select("tokens", "tokens"))

    names, aims = alike("a", 30).toDF("a", "c"), alike("b", 20).toDF("b", "d")
    other = t.toDF("q_name", "q_type", "c", "d")
    met = t.join(names, "a").join(aims, "b").join(other, ["c", "d"])
    return met.where("p_name <> q_name or p_type <> q_type").groupBy("p_name", "p_type").agg(F.count(F.lit(1)).alias("n_alike"))
