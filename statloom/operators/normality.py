"""Shapiro-Wilk for variables of any size, and a moment test of normality."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.special import norm_ppf, norm_sf
from statloom.operators.naming import plain_names
from statloom.operators.ranks import counted, cumulative
from statloom.operators.skew import lookup_by_key
from statloom.session import settle


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p after Royston (1995); needs 3 to 5000 values."""
    x = np.sort(np.asarray(values, dtype=float))
    n = x.size
    if n < 3:
        return math.nan, math.nan
    if x[-1] == x[0]:
        return 1.0, 1.0
    x = x - np.median(x)
    m = norm_ppf((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    weights = np.zeros(n)
    if n == 3:
        weights[-1] = math.sqrt(0.5)
        weights[0] = -weights[-1]
    else:
        ssq = float(m @ m)
        u = 1 / math.sqrt(n)
        last = m[-1] / math.sqrt(ssq) + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0], u)
        if n <= 5:
            phi = (ssq - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            weights = m / math.sqrt(phi)
        else:
            second = m[-2] / math.sqrt(ssq) + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
            phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            weights = m / math.sqrt(phi)
            weights[-2], weights[1] = second, -second
        weights[-1], weights[0] = last, -last
    w = min(float(weights @ x) ** 2 / float(((x - x.mean()) ** 2).sum()), 1.0)
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(p, 0.0)
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mean = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        ln = math.log(n)
        mean = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, float(norm_sf((y - mean) / sd))


# Ranks at either end whose scores are taken one by one; between them sums over runs of ranks use a correction that is exact to about 1e-9 there.
ENDS = 64


def _scores(ranks: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Expected normal order statistics (Blom) of the ranks of samples of size n."""
    return norm_ppf((ranks - 0.375) / (n + 0.25))


def _sum_between(low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of the scores of the ranks low..high, none of them near an end: the integral of the quantile function and two correction terms."""
    total = np.zeros(len(low))
    for edge, sign in ((high + 0.5, 1.0), (low - 0.5, -1.0)):
        z = norm_ppf((edge - 0.375) / (n + 0.25))
        unit = (n + 0.25) * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        total += sign * (-unit - 1 / (24 * unit) + 7 / 5760 * (1 + 2 * z * z) / unit**3)
    return total


def score_sums(below: np.ndarray, ties: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of the scores of the `ties` ranks that follow `below`."""
    first, last = below + 1, below + ties
    total = np.zeros(len(first))
    # ranks near the ends one by one
    for start, stop in ((first, np.minimum(last, ENDS)), (np.maximum(first, np.maximum(n - ENDS + 1, ENDS + 1)), last)):
        for step in range(ENDS):
            own = np.flatnonzero(start + step <= stop)
            if not len(own):
                break
            total[own] += _scores(start[own] + step, n[own])
    low, high = np.maximum(first, ENDS + 1), np.minimum(last, n - ENDS)
    one = np.flatnonzero(low == high)
    total[one] += _scores(low[one], n[one])
    run = np.flatnonzero(low < high)
    total[run] += _sum_between(low[run], high[run], n[run])
    return total


def square_sum(n: int) -> float:
    """Sum of the squared scores of all ranks of a sample of size n."""
    ends = np.arange(1, min(ENDS, n // 2) + 1, dtype=float)
    total = 2 * float((_scores(ends, np.full(len(ends), float(n))) ** 2).sum())
    left = n - 2 * len(ends)
    if left <= ENDS:
        middle = np.arange(len(ends) + 1, n - len(ends) + 1, dtype=float)
        return total + float((_scores(middle, np.full(len(middle), float(n))) ** 2).sum())
    z = float(norm_ppf(np.array([(n - len(ends) + 0.5 - 0.375) / (n + 0.25)]))[0])
    density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    unit = (n + 0.25) * density
    inside = (n + 0.25) * (1 - 2 * float(norm_sf(np.array([z]))[0]) - 2 * z * density)
    return total + inside - 2 * (2 * z / unit) / 24 + 2 * 7 / 5760 * 2 * z * (4 + 2 * z * z) / unit**3


def w_and_p(n: int, product: float, squares: float, ends: tuple[float, float, float, float]) -> tuple[float, float]:
    """W and p of a sample of any size after Royston, from the sum of score times value, the sum of squares about the mean and the
    first, second, last but one and last value.

    Royston fitted the law of W up to 5,000 values; beyond it the same law is continued.
    """
    if n < 3:
        return math.nan, math.nan
    if not squares > 0:
        return 1.0, 1.0
    x1, x2, y2, y1 = ends
    spread, inner = y1 - x1, y2 - x2
    if n == 3:
        w = min(spread * spread / 2 / squares, 1.0)
        return w, max(6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))), 0.0)
    last, second = (float(v) for v in _scores(np.array([n, n - 1.0]), np.array([float(n)] * 2)))
    ssq = square_sum(n)
    u = 1 / math.sqrt(n)
    a1 = last / math.sqrt(ssq) + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0], u)
    if n <= 5:
        scale = math.sqrt((ssq - 2 * last**2) / (1 - 2 * a1**2))
        top = (product - last * spread) / scale + a1 * spread
    else:
        a2 = second / math.sqrt(ssq) + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
        scale = math.sqrt((ssq - 2 * last**2 - 2 * second**2) / (1 - 2 * a1**2 - 2 * a2**2))
        top = (product - last * spread - second * inner) / scale + a1 * spread + a2 * inner
    w = min(top * top / squares, 1.0)
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mean = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        ln = math.log(n)
        mean = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, float(norm_sf((y - mean) / sd))


@F.pandas_udf(T.DoubleType())
def _run_scores(below: pd.Series, ties: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(score_sums(below.to_numpy(float), ties.to_numpy(float), n.to_numpy(float)))


@F.pandas_udf(T.StructType().add("w", "double").add("p", "double"))
def _test(n: pd.Series, product: pd.Series, squares: pd.Series, x1: pd.Series, x2: pd.Series, y2: pd.Series, y1: pd.Series) -> pd.DataFrame:
    rows = [w_and_p(int(a), b, c, (d, e, f, g)) for a, b, c, d, e, f, g in zip(n, product, squares, x1, x2, y2, y1)]
    return pd.DataFrame(rows, columns=["w", "p"])


@plain_names("columns", "by", told=("variable",))
def shapiro_table(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """(by, variable, n, w, p): Shapiro-Wilk W and p (Royston) of whole variables of any size; null below three values.

    W is a correlation of the sorted values with normal scores. Values are counted; the cumulative counts tell which ranks a value holds, and
    the scores of its ranks are summed at once, so neither a sort in one task nor a row per rank is needed. All columns go together.
    """
    by = list(by)
    parts = [F.struct(F.lit(c).alias("variable"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")) for c in columns]
    key = [*by, "variable"]
    counts = settle(counted(df.select(*by, F.inline(F.array(*parts))), "value", key))
    sizes = counts.groupBy(*key).agg(F.sum("n").alias("size"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"))
    ranked = lookup_by_key(cumulative(counts, "value", key), sizes, key)
    ranked = ranked.withColumn("score", _run_scores(F.col("below"), F.col("tie"), F.col("size")))
    x = F.col("value") - F.col("mean")
    last = F.col("below") + F.col("tie")
    agg = ranked.groupBy(*key).agg(
        F.max("size").alias("n"), F.sum(x * F.col("score")).alias("product"), F.sum(x * x * F.col("n")).alias("squares"),
        F.min(x).alias("x1"), F.min(F.when(last >= 2, x)).alias("x2"), F.max(F.when(F.col("below") <= F.col("size") - 2, x)).alias("y2"), F.max(x).alias("y1"))
    tested = agg.withColumn("t", F.when(F.col("n") >= 3, _test("n", "product", "squares", "x1", "x2", "y2", "y1")))
    return tested.select(*key, "n", "t.w", "t.p")


@plain_names("columns", "by", told=("variable",))
def jarque_bera(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Whole-table normality test from skewness and kurtosis; no row limit and no Python. A constant passes."""
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.count(c).alias("n"), F.skewness(c).alias("g1"),
                              F.kurtosis(c).alias("g2")) for c in columns])
    agg = df.groupBy(*by).agg(rows.alias("_r")).select(*by, F.inline("_r"))
    moments = F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2") / 4
    jb = F.col("n") / 6 * F.when(F.isnan(moments), F.lit(0.0)).otherwise(F.coalesce(moments, F.lit(0.0)))
    return agg.select(*by, "variable", "n", jb.alias("jb"), F.exp(-jb / 2).alias("p"))
