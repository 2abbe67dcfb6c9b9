"""Hypothesis tests as column expressions, and p-values that need special functions as Arrow UDFs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


#: Above so many of the rarer kind the sum of terms gives way to the normal tail.
MOST_TERMS = 10_000
# A rational-exponential fit of the complementary error function, good to 1.2e-7 of its value.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0."""
    t = 1 / (1 + 0.5 * x)
    power = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        power = power * t + c
    return t * F.exp(-x * x + power)


def binomial_two_sided(b: Column, c: Column) -> Column:
    """min(1, 2 P(X <= min(b, c))) for b + c fair draws; null without any.

    Up to MOST_TERMS terms are summed as logarithms; with more the tail is normal, corrected for continuity."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("long")
    start = F.struct((-n * math.log(2.0)).alias("term"), F.exp(-n * math.log(2.0)).alias("sum"))

    def step(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i)
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    few = k <= MOST_TERMS
    tail = F.aggregate(F.filter(F.sequence(F.lit(0).cast("long"), F.when(few, k).otherwise(0)), lambda i: i > 0), start, step, lambda acc: acc["sum"])
    z = F.greatest(F.abs(b - c).cast("double") - 1, F.lit(0.0)) / F.sqrt(n)
    return F.when(n > 0, F.least(F.lit(1.0), F.when(few, 2 * tail).otherwise(erfc(z / math.sqrt(2)))))


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Pooled two-sided z; null where a sample is empty or nothing varies."""
    p = F.try_divide(x1 + x2, n1 + n2)
    se = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return F.when(se > 0, F.try_divide(F.try_divide(x1, n1) - F.try_divide(x2, n2), se))


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def chi_square_one(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or math.isnan(v) else math.erfc(math.sqrt(max(v, 0) / 2)))


def mcnemar_auto(b: Column, c: Column) -> Column:
    """Exact below 25 discordant pairs, else the continuity-corrected chi-square."""
    x = F.try_divide(F.pow(F.abs(b - c) - 1, F.lit(2)), (b + c).cast("double"))
    return F.when(b + c < 25, binomial_two_sided(b, c)).otherwise(chi_square_one(x.cast("double")))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def signed_rank_two_sided(n: int, w: float) -> float:
    """Exact p of a signed rank sum without ties: subsets of 1..n by their sum."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for k in range(1, n + 1):
        for s in range(len(ways) - 1, k - 1, -1):
            ways[s] += ways[s - k]
    low = min(w, n * (n + 1) / 2 - w)
    return min(1.0, 2 * sum(ways[: math.floor(low) + 1]) / 2**n)


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if t_ is None or math.isnan(t_) or n_ < 2 else student_two_sided(t_, n_ - 1) for t_, n_ in zip(t, n, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def wilcoxon_p(n: pd.Series, w: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
    one = lambda n_, w_, t_, z_: signed_rank_two_sided(int(n_), w_) if n_ <= 50 and t_ == 0 else None if z_ is None or math.isnan(z_) else math.erfc(abs(z_) / math.sqrt(2))
    return pd.Series([one(*x) for x in zip(n, w, ties, z, strict=True)], dtype="float64")
