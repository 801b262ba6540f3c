"""Closed-form statistics as columns and windows, and special functions for p-values (Arrow UDFs over result rows)."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import c


def ppm(count: Column | str, total: Column | str) -> Column:
    return F.when(c(total) > 0, c(count) * 1e6 / c(total)).otherwise(0.0)


def pct_change(pre: Column | str, post: Column | str) -> Column:
    return F.when(c(pre) != 0, (c(post) - c(pre)) * 100.0 / F.abs(c(pre)))


def chi2_2x2(a: Column, b: Column, n1: Column, n2: Column, yates: bool = False) -> Column:
    """Pearson statistic of counts a of n1 and b of n2; 0 where a margin is empty."""
    a, b, n1, n2 = (x.cast("double") for x in (a, b, n1, n2))
    cc, d = n1 - a, n2 - b
    n = n1 + n2
    gap = F.abs(a * d - b * cc)
    if yates:
        gap = F.greatest(gap - n / 2, F.lit(0.0))
    margins = (a + b) * (cc + d) * n1 * n2
    return F.when(margins > 0, n * gap * gap / margins).otherwise(0.0)


def welch(stats: dict[str, Column]) -> tuple[Column, Column]:
    """Welch's t (post minus pre) and its degrees of freedom from m1, v1, n1 (pre) and m2, v2, n2 (post)."""
    s1, s2 = stats["v1"] / stats["n1"], stats["v2"] / stats["n2"]
    t = F.when(s1 + s2 > 0, (stats["m2"] - stats["m1"]) / F.sqrt(s1 + s2))
    df = F.when(s1 + s2 > 0, (s1 + s2) * (s1 + s2) / (s1 * s1 / (stats["n1"] - 1) + s2 * s2 / (stats["n2"] - 1)))
    return t, df


def benjamini_hochberg(df: DataFrame, p: str, within: list[str] = (), out: str = "p_adj", large: bool = False) -> DataFrame:
    """Adjusted p-values within groups; null p-values stay null and do not count.

    The rank of a value is the number of rows up to it, so equal p-values get equal results whatever their order.  The
    minimum over a value and all larger ones runs downwards: a frame that begins at the row and ends with the group
    would be gone through anew for each row.  ``large``: equal values are counted first, so that a group's window holds
    its distinct values, not its rows, and are joined back; df is then read twice.
    """
    known = F.col(p).isNotNull()
    level = df.where(known).groupBy(*within, p).agg(F.count("*").alias("__t")) if large else df.withColumn("__t", F.lit(1))
    w = Window.partitionBy(*([F.col(k) for k in within] or [F.lit(1)]), F.col(p).isNull())
    raw = F.col(p) * F.sum("__t").over(w) / F.sum("__t").over(w.orderBy(p))
    level = level.withColumn("__raw", F.when(known, raw))
    level = level.withColumn(out, F.when(known, F.least(F.lit(1.0), F.min("__raw").over(w.orderBy(F.desc(p)))))).drop("__t", "__raw")
    if not large:
        return level
    level = level.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(within)], F.col(p).alias("__p"), out)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(within)], F.col(p) == F.col("__p"))
    return df.join(level, same, "left").drop("__p", *[f"__k{i}" for i in range(len(within))])


def mann_whitney(df: DataFrame, group: list[str], side: str, value: str) -> DataFrame:
    """Per group: n1 (side true), n2, U of the true side, tie term, z and asymptotic p with continuity correction.

    Ranks need a total order inside a group only through equal values, so values are counted first and cumulated:
    a group's window holds its distinct values, not its rows.
    """
    flags = df.where(F.col(side).isNotNull() & F.col(value).isNotNull())
    per = flags.groupBy(*group, value).agg(F.count("*").alias("t"), F.count_if(F.col(side)).alias("t1"))
    w = Window.partitionBy(*group).orderBy(value)
    below = F.sum("t").over(w) - F.col("t")
    ranked = per.withColumn("rank", below + (F.col("t") + 1) / F.lit(2.0))
    out = ranked.groupBy(*group).agg(
        F.sum("t1").alias("n1"), (F.sum("t") - F.sum("t1")).alias("n2"),
        F.sum(F.col("rank") * F.col("t1")).alias("r1"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("tie_term"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("tie_term") / F.nullif(n * (n - 1), F.lit(0.0))))
    enough = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    z = F.when(enough & (sd > 0), F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) / sd)
    return out.select(*group, "n1", "n2", F.when(enough, u).alias("u"), "tie_term", z.alias("z")).withColumn("p_value", normal_p("z"))


# --- special functions -------------------------------------------------------------------------------------------


def erfc_p(x: float) -> float:
    """Two-sided normal tail of |x|."""
    return math.erfc(abs(x) / math.sqrt(2))


def chi2_1_sf(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, cc, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        cc = 1 + num / cc or tiny
        f *= cc * d
        if abs(1 - cc * d) < 1e-14:
            break
    return front * (f - 1)


def t_sf2(t: float, df: float) -> float:
    """Two-sided Student tail."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def chi2_sf(x: float, k: float) -> float:
    """Chi-square tail by the regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, x = k / 2, x / 2
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, tiny = x + 1 - a, 1e-300
    cc, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        cc = b + an / cc or tiny
        h *= d * cc
        if abs(d * cc - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _column(f, *xs: Column | str) -> Column:
    @F.pandas_udf("double")
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in vs) else f(*vs) for vs in zip(*cols)], dtype="float64")

    return run(*[c(x).cast("double") for x in xs])


def normal_p(z: Column | str) -> Column:
    return _column(erfc_p, z)


def chi2_p(x: Column | str) -> Column:
    return _column(chi2_1_sf, x)


def t_p(t: Column | str, df: Column | str) -> Column:
    return _column(t_sf2, t, df)


def stars(p: Column | str) -> Column:
    p = c(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
