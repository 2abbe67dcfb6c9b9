"""Grouped tests, corrections for many tests and resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qaloom.functions.statistics import binomial_two_sided, student_p, wilcoxon_p
from qaloom.operators.relations import positions
from qaloom.tables import written


def discordant(pairs: DataFrame, by: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """n, acc_a, acc_b, b (only the first right), c (only the second), mcnemar_p."""
    one, two = F.col(a) == 1, F.col(b) == 1
    got = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(a).cast("double")).alias("acc_a"), F.avg(F.col(b).cast("double")).alias("acc_b"), F.count_if(one & ~two).alias("b"), F.count_if(~one & two).alias("c"))
    return got.withColumn("mcnemar_p", binomial_two_sided(F.col("b"), F.col("c")))


def holm(tests: DataFrame, p: str, key: str, family: Sequence[str] = (), alpha: float = 0.05, strict: bool = False, stop: bool = True) -> DataFrame:
    """rank, threshold, rejected and adjusted p of each test of a family (a handful of tests each).

    strict: reject below the threshold, not at it.  stop: after the first that stays, none is rejected."""
    order = W.partitionBy(*family).orderBy(F.round(p, 9), key)  # sums of logarithms may differ in their last digits
    m = F.count(F.lit(1)).over(W.partitionBy(*family))
    ranked = tests.withColumn("rank", F.row_number().over(order)).withColumn("threshold", alpha / (m - F.col("rank") + 1)).withColumn("_m", m)
    below = F.col(p) < F.col("threshold") if strict else F.col(p) <= F.col("threshold")
    upto = W.partitionBy(*family).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    rejected = F.min(below.cast("int")).over(upto) == 1 if stop else below
    adjusted = F.least(F.lit(1.0), F.max((F.col("_m") - F.col("rank") + 1) * F.col(p)).over(upto))
    return ranked.withColumn("rejected", rejected).withColumn("adjusted", adjusted).drop("_m")


def cluster_bootstrap(pairs: DataFrame, cluster: str, replicates: int, a: str = "a", b: str = "b", seed: int = 42) -> DataFrame:
    """mean, lo, hi of the accuracy difference a - b over resampled clusters: one row.

    Clusters are summed first; a replicate draws as many as there are, each draw by the digest of seed, replicate and
    draw, so any engine draws alike.  Replicates x clusters rows are drawn from a range and joined to the clusters'
    numbers, so nothing is gathered."""
    spark = pairs.sparkSession
    sums = pairs.groupBy(cluster).agg(F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.count(F.lit(1)).alias("n"))
    numbered = written(positions(sums, [cluster], "k"), "clusters")
    many = numbered.count()
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("r").cast("string"), F.pmod("id", F.lit(max(many, 1))).cast("string")))
    picks = spark.range(replicates * many).withColumn("r", F.floor(F.col("id") / max(many, 1)).cast("long"))
    picks = picks.select("r", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(max(many, 1))).alias("k"))
    diffs = picks.join(numbered, "k").groupBy("r").agg(((F.sum("sa") - F.sum("sb")) / F.sum("n")).alias("d"))
    return diffs.agg(F.avg("d").alias("mean"), F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi"))


def signed_ranks(differences: DataFrame, d: str, by: Sequence[str]) -> DataFrame:
    """Wilcoxon's W+ and W-: zeros go, ties share their mean rank.  Ranks come from counts of equal sizes, not of rows."""
    used = differences.where(F.col(d) != 0).withColumn("_s", F.abs(F.col(d)))
    sizes = used.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col(d) > 0).alias("plus"))
    before = F.coalesce(F.sum("t").over(W.partitionBy(*by).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("rank", before + (F.col("t") + 1) / 2)
    return ranked.groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("t") - F.col("plus"))).alias("w_minus"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))


def wilcoxon(differences: DataFrame, d: str, by: Sequence[str]) -> DataFrame:
    """n, w_plus, w_minus, z and p: exact up to 50 differences without ties, else normal with the variance cut for ties."""
    n = F.col("n")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    ranks = signed_ranks(differences, d, by).withColumn("z", F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(variance)))
    return ranks.withColumn("p", wilcoxon_p(n, F.col("w_plus"), F.col("ties"), F.col("z"))).drop("ties")


def paired_t(differences: DataFrame, d: str, by: Sequence[str]) -> DataFrame:
    """n, mean, t and two-sided p of paired differences; t and p are null where nothing varies."""
    got = differences.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("_s"))
    t = F.try_divide(F.col("mean"), F.try_divide(F.col("_s"), F.sqrt("n")))
    return got.withColumn("t", t).withColumn("p", student_p(F.col("t"), F.col("n"))).drop("_s")


def same_leader(cells: DataFrame, family: Sequence[str], grid: str, reference: float, difference: str) -> DataFrame:
    """Adds same_leader: whether a cell's difference has the sign of its family's reference cell; null without either."""
    own = F.signum(F.round(difference, 9))
    base = F.max(F.when(F.abs(F.col(grid) - reference) < 1e-9, own)).over(W.partitionBy(*family))
    return cells.withColumn("same_leader", own == base)
