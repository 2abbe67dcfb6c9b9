"""Tests of paired results: labels of documents as two models' correctness."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qaloom.functions import statistics as ST
from qaloom.operators import testing as T
from qaloom.plans.derived import PAIRED_SQL, paired
from qaloom.plans.registry import query

_BINOM = "CASE WHEN b + c > 0 THEN least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END"
_DISC = f"""WITH {PAIRED_SQL}, g AS (SELECT {{0}}, count(*) AS n, avg(a) AS acc_a, avg(b) AS acc_b, count(*) FILTER (a = 1 AND b <> 1) AS bb, count(*) FILTER (a <> 1 AND b = 1) AS c FROM paired GROUP BY {{0}}),
 t AS (SELECT {{0}}, n, acc_a, acc_b, bb AS b, c FROM g), p AS (SELECT *, {_BINOM} AS p FROM t)"""


@query(_DISC.format("QA_Type") + " SELECT QA_Type, n, round(acc_a, 6) AS acc_a, round(acc_b, 6) AS acc_b, b, c, round(p, 6) AS mcnemar_p FROM p")
def mcnemar_exact(spark, sf_dir):
    d = T.discordant(paired(spark, sf_dir), ["QA_Type"])
    return d.select("QA_Type", "n", *(F.round(x, 6).alias(x) for x in ("acc_a", "acc_b")), "b", "c", F.round("mcnemar_p", 6).alias("mcnemar_p"))


@query(_DISC.format("Cluster") + " SELECT Cluster, n, b, c, CAST(sign(acc_a - acc_b) AS INTEGER) AS leader FROM p")
def discordant_by_group(spark, sf_dir):
    return T.discordant(paired(spark, sf_dir), ["Cluster"]).select("Cluster", "n", "b", "c", F.signum(F.col("acc_a") - F.col("acc_b")).cast("int").alias("leader"))


@query(_DISC.format("Cluster") + """, r AS (SELECT Cluster, p, row_number() OVER (ORDER BY round(p, 9), Cluster) AS rank, count(*) OVER () AS m FROM p WHERE p IS NOT NULL)
 SELECT Cluster, round(p, 6) AS p, rank, round(0.05 / (m - rank + 1), 8) AS threshold, min(CASE WHEN p <= 0.05 / (m - rank + 1) THEN 1 ELSE 0 END) OVER (ORDER BY rank) = 1 AS rejected,
 round(least(1.0, max((m - rank + 1) * p) OVER (ORDER BY rank)), 6) AS adjusted FROM r""")
def holm_stepdown(spark, sf_dir):
    d = T.discordant(paired(spark, sf_dir), ["Cluster"]).where("mcnemar_p is not null").select("Cluster", F.col("mcnemar_p").alias("p"))
    h = T.holm(d, "p", "Cluster")
    return h.select("Cluster", F.round("p", 6).alias("p"), "rank", F.round("threshold", 8).alias("threshold"), "rejected", F.round("adjusted", 6).alias("adjusted"))


@query(f"""WITH {PAIRED_SQL}, g AS (SELECT QA_Type, sum(a)::DOUBLE AS x1, sum(b)::DOUBLE AS x2, count(*)::DOUBLE AS n FROM paired GROUP BY QA_Type), h AS (SELECT *, (x1 + x2) / (2 * n) AS p FROM g)
 SELECT QA_Type, round((x1 / n - x2 / n) / sqrt(p * (1 - p) * (2 / n)), 6) AS z FROM h""")
def two_prop_z(spark, sf_dir):
    g = paired(spark, sf_dir).groupBy("QA_Type").agg(F.sum("a").alias("x1"), F.sum("b").alias("x2"), F.count(F.lit(1)).alias("n"))
    return g.select("QA_Type", F.round(ST.two_proportion_z(F.col("x1"), F.col("n"), F.col("x2"), F.col("n")), 6).alias("z"))


#: 1 - erf(x) by its series, good to nine places below 4; beyond, the value rounds to 0.
_ERFC = "CASE WHEN {0} > 3.9 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda i: CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END * exp((2 * i + 1) * ln(greatest({0}, 1e-12)) - lgamma(i + 1)) / (2 * i + 1))) END"


@query(f"""WITH {PAIRED_SQL}, g AS (SELECT QA_Type, sum(a)::DOUBLE AS x1, sum(b)::DOUBLE AS x2, count(*)::DOUBLE AS n, count(*) FILTER (a = 1 AND b <> 1) AS b, count(*) FILTER (a <> 1 AND b = 1) AS c FROM paired GROUP BY QA_Type),
 h AS (SELECT *, (x1 + x2) / (2 * n) AS p FROM g), z AS (SELECT *, abs((x1 / n - x2 / n) / sqrt(p * (1 - p) * (2 / n))) / sqrt(2) AS u, (abs(b - c) - 1) / sqrt(b + c) / sqrt(2) AS w FROM h)
 SELECT QA_Type, CASE WHEN p * (1 - p) > 0 THEN round({_ERFC.format('u')}, 6) END AS z_p, round(CASE WHEN b + c < 25 THEN {_BINOM} ELSE {_ERFC.format('abs(w)')} END, 6) AS mcnemar_p FROM z""")
def p_values_udf(spark, sf_dir):
    """p-values that need the error function; tests hold them against known values as well."""
    g = paired(spark, sf_dir).groupBy("QA_Type").agg(F.sum("a").alias("x1"), F.sum("b").alias("x2"), F.count(F.lit(1)).alias("n"), F.count_if((F.col("a") == 1) & (F.col("b") != 1)).alias("b"), F.count_if((F.col("a") != 1) & (F.col("b") == 1)).alias("c"))
    z = ST.two_proportion_z(F.col("x1"), F.col("n"), F.col("x2"), F.col("n"))
    return g.select("QA_Type", F.round(ST.normal_two_sided(z), 6).alias("z_p"), F.round(ST.mcnemar_auto(F.col("b"), F.col("c")), 6).alias("mcnemar_p"))


_DRAW = "('0x' || substr(md5('42|' || CAST(id // many AS VARCHAR) || '|' || CAST(id % many AS VARCHAR)), 1, 8))::BIGINT % many"


@query(f"""WITH {PAIRED_SQL}, s AS (SELECT Cluster, sum(a) AS sa, sum(b) AS sb, count(*) AS n, row_number() OVER (ORDER BY Cluster) - 1 AS k FROM paired GROUP BY Cluster), m AS (SELECT count(*) AS many FROM s),
 d AS (SELECT id // many AS r, {_DRAW} AS k FROM m, range(10000 * many) t(id)), x AS (SELECT r, (sum(sa) - sum(sb)) / sum(n) AS d FROM d JOIN s USING (k) GROUP BY r)
 SELECT round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi FROM x""")
def cluster_bootstrap(spark, sf_dir):
    return T.cluster_bootstrap(paired(spark, sf_dir), "Cluster", 10_000).select(*(F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")))


_DIFF = f"WITH {PAIRED_SQL}, q AS (SELECT QA_Type, Cluster, avg(a) - avg(b) AS d FROM paired GROUP BY ALL)"


@query(_DIFF + ", z AS (SELECT QA_Type, d, round(abs(d), 9) AS s FROM q WHERE round(d, 9) <> 0), r AS (SELECT *, rank() OVER (PARTITION BY QA_Type ORDER BY s) + (count(*) OVER (PARTITION BY QA_Type, s) - 1) / 2 AS k FROM z) SELECT QA_Type, count(*) AS n, coalesce(sum(k) FILTER (d > 0), 0) AS w_plus, coalesce(sum(k) FILTER (d < 0), 0) AS w_minus FROM r GROUP BY QA_Type")
def wilcoxon_w(spark, sf_dir):
    q = paired(spark, sf_dir).groupBy("QA_Type", "Cluster").agg(F.round(F.avg("a") - F.avg("b"), 9).alias("d"))
    return T.signed_ranks(q, "d", ["QA_Type"]).drop("ties")


@query(_DIFF + f", z AS (SELECT QA_Type, d, round(abs(d), 9) AS s FROM q WHERE round(d, 9) <> 0), r AS (SELECT *, rank() OVER (PARTITION BY QA_Type ORDER BY s) + (count(*) OVER (PARTITION BY QA_Type, s) - 1) / 2 AS k, count(*) OVER (PARTITION BY QA_Type, s) AS t FROM z), w AS (SELECT QA_Type, count(*) AS n, coalesce(sum(k) FILTER (d > 0), 0) AS w, sum(t * t - 1) AS ties FROM r GROUP BY QA_Type), u AS (SELECT QA_Type, n, w, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w) SELECT QA_Type, n, w AS w_plus, round(z, 6) AS z FROM u")
def wilcoxon_test(spark, sf_dir):
    """Signed-rank statistics; tests hold the p-values, exact and normal, against known ones."""
    q = paired(spark, sf_dir).groupBy("QA_Type", "Cluster").agg(F.round(F.avg("a") - F.avg("b"), 9).alias("d"))
    return T.wilcoxon(q, "d", ["QA_Type"]).select("QA_Type", "n", "w_plus", F.round("z", 6).alias("z"))


@query(_DIFF + " SELECT QA_Type, count(*) AS n, round(avg(d), 6) AS mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 5) AS t FROM q GROUP BY QA_Type")
def paired_t(spark, sf_dir):
    q = paired(spark, sf_dir).groupBy("QA_Type", "Cluster").agg((F.avg("a") - F.avg("b")).alias("d"))
    return T.paired_t(q, "d", ["QA_Type"]).select("QA_Type", "n", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"))


_CELLS = f"WITH {PAIRED_SQL}, x AS (SELECT QA_Type, Cluster, avg(a) - avg(b) AS d, (row_number() OVER (PARTITION BY QA_Type ORDER BY Cluster) + 9) * 0.05 AS pf FROM paired GROUP BY QA_Type, Cluster), c AS (SELECT * FROM x WHERE pf <= 1.0001)"


@query(_CELLS + " SELECT QA_Type, round(pf, 2) AS pass_frac, round(d, 6) AS d, sign(round(d, 9)) = max(CASE WHEN abs(pf - 0.75) < 1e-9 THEN sign(round(d, 9)) END) OVER (PARTITION BY QA_Type) AS same_leader FROM c")
def reference_cell(spark, sf_dir):
    """Whether a cell of a threshold grid has the leader that the reference threshold's cell has."""
    d = paired(spark, sf_dir).groupBy("QA_Type", "Cluster").agg((F.avg("a") - F.avg("b")).alias("d"))
    cells = d.withColumn("pass_frac", (F.row_number().over(W.partitionBy("QA_Type").orderBy("Cluster")) + 9) * F.lit(0.05)).where("pass_frac <= 1.0001")
    return T.same_leader(cells, ["QA_Type"], "pass_frac", 0.75, "d").select("QA_Type", F.round("pass_frac", 2).alias("pass_frac"), F.round("d", 6).alias("d"), "same_leader")


@query(_DIFF + f", g AS (SELECT QA_Type, count(*) FILTER (round(d, 9) > 0) AS b, count(*) FILTER (round(d, 9) < 0) AS c FROM q GROUP BY QA_Type) SELECT QA_Type, b AS n_plus, c AS n_minus, round({_BINOM}, 6) AS p FROM g")
def sign_test(spark, sf_dir):
    q = paired(spark, sf_dir).groupBy("QA_Type", "Cluster").agg(F.round(F.avg("a") - F.avg("b"), 9).alias("d"))
    g = q.groupBy("QA_Type").agg(F.count_if(F.col("d") > 0).alias("n_plus"), F.count_if(F.col("d") < 0).alias("n_minus"))
    return g.withColumn("p", F.round(ST.binomial_two_sided(F.col("n_plus"), F.col("n_minus")), 6))


@query(f"""WITH {PAIRED_SQL} SELECT QA_Type, round(100 * avg(a), 4) AS acc_all, round(100 * avg(a) FILTER (b = 1), 4) AS acc_gated, round(100 * (avg(a) FILTER (b = 1) - avg(a)), 4) AS lift_pp, round(100 * (avg(a) - avg(b)), 4) AS gap_pp FROM paired GROUP BY QA_Type""")
def accuracy_decomp(spark, sf_dir):
    """Accuracy before and after a gate, and the lift, in one pass."""
    a, b, gated = F.avg("a"), F.avg("b"), F.avg(F.when(F.col("b") == 1, F.col("a")))
    return paired(spark, sf_dir).groupBy("QA_Type").agg(F.round(100 * a, 4).alias("acc_all"), F.round(100 * gated, 4).alias("acc_gated"), F.round(100 * (gated - a), 4).alias("lift_pp"), F.round(100 * (a - b), 4).alias("gap_pp"))


@query(f"""WITH {PAIRED_SQL}, m AS (SELECT Cluster, coalesce(QA_Type, 'none') AS t, avg(a) AS x FROM paired GROUP BY ALL), n AS (SELECT Cluster, count(*) AS n FROM paired GROUP BY Cluster)
 SELECT n.Cluster, n, array_to_string(list(t || '=' || CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR) ORDER BY t), ',') AS means, round(100 * (max(x) - min(x)), 4) AS range_pp FROM m JOIN n ON m.Cluster IS NOT DISTINCT FROM n.Cluster GROUP BY n.Cluster, n""")
def pivot_means(spark, sf_dir):
    """Means by cluster and type, the types taken from the data (a handful), and the widest difference between two of them."""
    p = paired(spark, sf_dir).withColumn("t", F.coalesce("QA_Type", F.lit("none")))
    types = sorted(r[0] for r in p.select("t").distinct().collect())
    wide = p.groupBy("Cluster").pivot("t", types).agg(F.avg("a"))
    cells = F.array(*(F.struct(F.lit(t).alias("t"), F.col(f"`{t}`").alias("x")) for t in types))
    some = F.filter(cells, lambda c: c["x"].isNotNull())
    means = F.array_join(F.transform(some, lambda c: F.concat(c["t"], F.lit("="), F.round(c["x"] * 1_000_000).cast("long").cast("string"))), ",")
    values = F.transform(some, lambda c: c["x"])
    n = p.groupBy(F.col("Cluster").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return wide.join(n, F.col("Cluster").eqNullSafe(F.col("c"))).select("Cluster", "n", means.alias("means"), F.round(100 * (F.array_max(values) - F.array_min(values)), 4).alias("range_pp"))


@query(f"""WITH {PAIRED_SQL} SELECT coalesce(QA_Type, 'all') AS QA_Type, count(*) AS n, round(avg(a) FILTER (b = 1), 6) AS gated, round(avg(a), 6) AS plain, round(avg(a) FILTER (b = 1 AND Cluster <> 'src0'), 6) AS filtered, round(100 * (avg(a) FILTER (b = 1) - avg(a)), 4) AS first_pp,
 round(100 * (avg(a) FILTER (b = 1 AND Cluster <> 'src0') - avg(a) FILTER (b = 1)), 4) AS second_pp, round(stddev_samp(a), 6) AS std FROM paired GROUP BY GROUPING SETS ((QA_Type), ())""")
def staged_accuracy(spark, sf_dir):
    """Accuracy under three filters, one within the other, with the step of each, by type and in all."""
    a, gate = F.col("a"), F.col("b") == 1
    under = lambda f: F.avg(F.when(f, a))
    one, two, three = F.avg(a), under(gate), under(gate & (F.col("Cluster") != "src0"))
    agg = [F.count(F.lit(1)).alias("n"), F.round(two, 6).alias("gated"), F.round(one, 6).alias("plain"), F.round(three, 6).alias("filtered"), F.round(100 * (two - one), 4).alias("first_pp"), F.round(100 * (three - two), 4).alias("second_pp"), F.round(F.stddev_samp(a), 6).alias("std")]
    return paired(spark, sf_dir).rollup("QA_Type").agg(*agg).withColumn("QA_Type", F.coalesce("QA_Type", F.lit("all")))


@query(f"""WITH {PAIRED_SQL} SELECT a, b, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY a), 4) AS row_pct FROM paired GROUP BY a, b""")
def crosstab_pct(spark, sf_dir):
    cell = paired(spark, sf_dir).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return cell.withColumn("row_pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("a")), 4))
