"""Stratified samples, allocation, blinding."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaloom.operators import sampling as P
from qaloom.operators import similarity as S
from qaloom.plans.registry import query
from qaloom.tables import load

_DRAW = "sha1('20260816' || '|' || CAST(doc_id AS VARCHAR))"


@query(f"""SELECT doc_id, lang, nth FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW}) AS nth FROM documents) WHERE nth <= 12""")
def stratified_sample(spark, sf_dir):
    return P.stratified(load(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 12, 20260816).select("doc_id", "lang", "nth")


_ALLOC = """pop AS (SELECT source AS stratum, count(*) AS n FROM documents GROUP BY source), sh AS (SELECT *, 100.0 * n / sum(n) OVER () AS exact FROM pop),
 fl AS (SELECT *, CAST(floor(exact) AS BIGINT) AS base, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, stratum) AS r, 100 - CAST(sum(floor(exact)) OVER () AS BIGINT) AS left_over FROM sh),
 al AS (SELECT stratum, n, base + CASE WHEN r <= left_over THEN 1 ELSE 0 END AS allocated FROM fl)"""


@query(f"WITH {_ALLOC} SELECT stratum, n, allocated FROM al")
def largest_remainder(spark, sf_dir):
    counts = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return P.largest_remainder(counts, 100)


@query(f"""WITH {_ALLOC}, d AS (SELECT doc_id, source AS stratum, {_DRAW} AS h FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h) AS nth FROM d),
 s AS (SELECT doc_id, stratum, sha1('7|' || CAST(doc_id AS VARCHAR)) AS g FROM k JOIN al USING (stratum) WHERE nth <= allocated)
 SELECT 'I' || lpad(CAST(row_number() OVER (ORDER BY g) AS VARCHAR), 3, '0') AS Item_ID, doc_id, stratum FROM s""")
def proportional_items(spark, sf_dir):
    """A proportional sample, shuffled and numbered I001, I002, ... (a hundred rows)."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("stratum"))
    alloc = P.largest_remainder(docs.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), 100)
    return P.item_ids(P.proportional(docs, alloc, "stratum", "doc_id", 20260816), "doc_id", 7).select("Item_ID", "doc_id", "stratum")


@query("""SELECT doc_id, 'q' || substr(sha1(text), 1, 16) AS QID, text AS Question FROM documents JOIN labels USING (doc_id) WHERE quality = 0""")
def blind_items(spark, sf_dir):
    """What raters see: no label, source or language."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").where("quality = 0"), "doc_id")
    return P.blinded(d.withColumn("QID", F.concat(F.lit("q"), F.substring(F.sha1("text"), 1, 16))).withColumnRenamed("text", "Question"), ["doc_id", "QID", "Question"])


@query("""WITH acc AS (SELECT lang AS t, avg(quality) AS acc FROM labels JOIN documents USING (doc_id) GROUP BY lang), w AS (SELECT *, 25.0 AS w FROM acc), s AS (SELECT *, acc >= 0.85 AS sat, CASE WHEN acc >= 0.85 THEN least(10.0, greatest(0.0, w - 18.0)) ELSE 0.0 END AS shed FROM w),
 m AS (SELECT bool_or(sat) AND NOT bool_and(sat) AS moves, sum(shed) AS total, arg_min(t, (acc, t)) FILTER (NOT sat) AS recipient FROM s)
 SELECT t, round(acc, 6) AS acc, round(CASE WHEN moves THEN w - shed + CASE WHEN t = recipient THEN total ELSE 0 END ELSE w END, 6) AS weight FROM s, m""")
def allocate_weights(spark, sf_dir):
    """One round of moving weight from saturated types to the weakest of the others."""
    acc = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents"), "doc_id").groupBy(F.col("lang").alias("t")).agg(F.avg("quality").alias("acc"))
    out = P.reallocated(acc.withColumn("w", F.lit(25.0)), threshold=0.85, shift=10.0, floor=18.0)
    return out.select("t", F.round("acc", 6).alias("acc"), F.round("w", 6).alias("weight"))


_WORDS = "list_distinct(string_split(lower({0}), ' '))"


@query(f"""WITH r AS (SELECT c_custkey AS k, c_mktsegment AS p, n_name AS e, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer JOIN nation ON n_nationkey = c_nationkey), n AS (SELECT count(*) AS n FROM r),
 d AS (SELECT k, p, e, t, ('0x' || substr(md5('11|' || CAST(k AS VARCHAR) || '|' || CAST(t AS VARCHAR)), 1, 8))::BIGINT % n AS pos FROM r, n, range(1, 25) x(t)),
 m AS (SELECT d.k, r.k AS other, min(t) AS t FROM d JOIN r USING (pos) WHERE d.k <> r.k AND (100.0 * len(list_intersect({_WORDS.format('d.p')}, {_WORDS.format('r.p')})) / len(list_distinct({_WORDS.format('d.p')} || {_WORDS.format('r.p')}))
 + 100.0 * len(list_intersect({_WORDS.format('d.e')}, {_WORDS.format('r.e')})) / len(list_distinct({_WORDS.format('d.e')} || {_WORDS.format('r.e')}))) / 2 < 20 GROUP BY ALL)
 SELECT k, other, CAST(row_number() OVER (PARTITION BY k ORDER BY t) AS INTEGER) AS nth FROM m QUALIFY nth <= 3""")
def distractor_sample(spark, sf_dir):
    """Three other customers of each, drawn by hash, whose segment and nation are less than 20 per cent alike."""
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    s = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("persona"), F.col("n_name").alias("env"))
    return S.dissimilar_draws(s, "k", "persona", "env", 3, 11)


@query("""WITH s AS (SELECT c_custkey AS k, c_mktsegment AS persona, c_name AS env, ['reg', 'generic', 'dynamic_reg', 'dynamic_generic'][c_custkey % 4 + 1] AS seed, 'clause ' || (c_custkey % 12) AS reg FROM customer),
 x AS (SELECT *, CASE WHEN seed IN ('generic', 'dynamic_generic') THEN 'GENERIC' WHEN c_ok THEN CAST(k % 12 AS VARCHAR) END AS area FROM (SELECT *, k % 12 < 8 AS c_ok FROM s))
 SELECT k, 'USER_PERSONA: ' || persona || chr(10) || 'COLLECTION_OF_DOCS: ' || env || chr(10) || 'REGULATORY_AREA_ID: ' || area AS exemplar FROM x WHERE area IS NOT NULL ORDER BY sha1('3|' || CAST(k AS VARCHAR)) LIMIT 5""")
def exemplars(spark, sf_dir):
    """Five drawn scenarios with the area that their clause has; some clauses are unknown, one has two ids."""
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("reg", "generic", "dynamic_reg", "dynamic_generic"))), (k % 4 + 1).cast("int"))
    s = load(spark, sf_dir, "customer").select(k.alias("k"), F.col("c_mktsegment").alias("Persona"), F.col("c_name").alias("Environment"), kind.alias("Seed_Type"), F.concat(F.lit(" clause "), (k % 12).cast("string")).alias("Reg_Text"))
    clauses = spark.createDataFrame([(str(i), f"clause {i}") for i in range(8)] + [("9", "clause 3"), ("10", " ")], "id string, clause string")
    return P.exemplars(s, clauses, "k", 5, 3)


@query("""SELECT Judgement, Verdict, count(*) AS n FROM (SELECT unnest(['quality', 'toxic']) AS Judgement, unnest([quality, toxic]) AS Verdict FROM labels) GROUP BY ALL""")
def failure_unpivot(spark, sf_dir):
    return load(spark, sf_dir, "labels").unpivot(["doc_id"], ["quality", "toxic"], "Judgement", "Verdict").groupBy("Judgement", "Verdict").agg(F.count(F.lit(1)).alias("n"))
