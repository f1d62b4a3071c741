"""Metrics over a prediction relation. Undefined values are NULL: one class, no variance, too few rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.ranking import average_rank, quantiles, running_sums
from plumbline.shared import written


def _both(y: str, p: str) -> Column:
    return F.col(y).isNotNull() & F.col(p).isNotNull()


def r2(y: str, p: str, least: int = 1) -> Column:
    """1 - SSE/SST around the group's own mean; NULL below ``least`` rows or without variance."""
    ok = _both(y, p)
    yy = F.when(ok, F.col(y).cast("double"))
    sse = F.sum(F.when(ok, (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))))
    n = F.count(yy)
    return F.when((n >= least) & (F.var_pop(yy) > 0), 1 - F.try_divide(sse, F.var_pop(yy) * n))


def rmse(y: str, p: str) -> Column:
    return F.sqrt(F.avg(F.when(_both(y, p), (F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))))


def accuracy(y: str, p: str) -> Column:
    return F.avg(F.when(_both(y, p), (F.col(y) == F.col(p)).cast("double")))


def share_below(x: str, threshold: float = 0.0) -> Column:
    return F.avg((F.col(x) < threshold).cast("double"))


def wins(baseline: str, model: str) -> tuple[Column, Column, Column]:
    """(wins, units, win percent); a tie is a win of the baseline."""
    ok = _both(baseline, model)
    won, n = F.sum(F.when(ok, (F.col(baseline) >= F.col(model)).cast("long"))), F.sum(ok.cast("long"))
    return won, n, F.try_divide(100.0 * won, n)


def _counted(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Classes at and below each distinct score, from rows written once. Adding 0.0 makes -0.0 and 0.0 one score."""
    df = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).select(*keys, F.col(label).cast("double").alias("_y"), (F.col(score).cast("double") + F.lit(0.0)).alias("_s"))
    df = written(df, "scores")
    return running_sums(df, keys, "_s", {"_pos": (F.col("_y") > 0.5).cast("long"), "_neg": (F.col("_y") <= 0.5).cast("long")})


def auc(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """(keys, n_pos, n_neg, auc): the share of pairs in order, ties counting half. NULL if a class is missing."""
    at = _counted(df, keys, label, score)
    p, n = F.sum("_pos"), F.sum("_neg")
    won = F.sum(F.col("_pos") * (F.col("_neg_below") + F.col("_neg") / F.lit(2.0)))
    return at.groupBy(*keys).agg(p.alias("n_pos"), n.alias("n_neg"), F.try_divide(won, (p * n).cast("double")).alias("auc"))


def average_precision(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """(keys, n, n_pos, prevalence, ap, ap_lift): the step sum over falling scores; lift is ap over prevalence."""
    at = _counted(df, keys, label, score)
    total = at.groupBy(*keys).agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    joined = at.join(total, keys) if keys else at.join(total)
    tp, fp = F.col("_p") - F.col("_pos_below"), F.col("_n") - F.col("_neg_below")
    ap = F.sum(F.try_divide(F.col("_pos").cast("double"), F.col("_p")) * tp / (tp + fp))
    out = joined.groupBy(*keys).agg(ap.alias("ap"), F.max("_p").alias("n_pos"), F.max(F.col("_p") + F.col("_n")).alias("n"))
    share = F.col("n_pos") / F.col("n")
    return out.select(*keys, "n", "n_pos", share.alias("prevalence"), "ap", F.try_divide(F.col("ap"), share).alias("ap_lift"))


def macro_auc(df: DataFrame, keys: list[str], label: str, scores: dict[str, str]) -> DataFrame:
    """Mean of the one-versus-rest AUCs; ``scores`` names each class's score column."""
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("cls"), F.col(s).cast("double").alias("s"), (F.col(label) == c).cast("double").alias("y")) for c, s in scores.items())))
    long = df.select(*keys, parts.alias("o")).select(*keys, "o.*")
    return auc(long, [*keys, "cls"], "y", "s").groupBy(*keys).agg(F.avg("auc").alias("macro_auc"), F.count("auc").alias("n_classes"))


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, rho): correlation of average ranks over rows where both are known.

    Ranking reads its input several times, so it is written to the shared folder once.
    """
    df = written(df.filter(_both(a, b)).select(*keys, a, b), "ranked")
    df = average_rank(average_rank(df, keys, a, "_ra"), keys, b, "_rb")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when((F.stddev_pop("_ra") > 0) & (F.stddev_pop("_rb") > 0), F.corr("_ra", "_rb")).alias("rho"))


def kappa(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, agreement_pct, kappa) of two raters; rows without either rating are left out. NULL if chance agrees fully."""
    cells = df.filter(_both(a, b)).groupBy(*keys, F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    rows = cells.groupBy(*keys, "_a").agg(F.sum("_c").alias("_x")).withColumnRenamed("_a", "_k")
    cols = cells.groupBy(*keys, "_b").agg(F.sum("_c").alias("_y")).withColumnRenamed("_b", "_k")
    chance = rows.join(cols, [*keys, "_k"]).groupBy(*keys).agg(F.sum(F.col("_x") * F.col("_y")).alias("_xy"))
    seen = cells.groupBy(*keys).agg(F.sum("_c").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_c")).otherwise(0)).alias("_same"))
    out = seen.join(chance, keys, "left") if keys else seen.join(chance)
    po, pe = F.col("_same") / F.col("n"), F.coalesce(F.col("_xy"), F.lit(0)) / (F.col("n") * F.col("n"))
    return out.select(*keys, "n", (100 * po).alias("agreement_pct"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def confusion(truth: Column, said: Column) -> dict[str, Column]:
    """Counts of a binary rating against the truth; NULLs count nowhere."""
    cell = {"tp": truth & said, "fp": ~truth & said, "fn": truth & ~said, "tn": ~truth & ~said}
    return {k: F.count_if(v) for k, v in cell.items()}


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a proportion; NULL for n = 0."""
    p, z2 = F.try_divide(k.cast("double"), n), z * z
    mid, d = p + F.try_divide(F.lit(z2), 2 * n), 1 + F.try_divide(F.lit(z2), n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n))
    return F.greatest((mid - half) / d, F.lit(0.0)), F.least((mid + half) / d, F.lit(1.0))


def _binomial_tail(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X >= k) for X binomial, k from 1 to n: the regularised incomplete beta function of p with (k, n - k + 1).

    By its continued fraction (Lentz's method), from the side on which that converges fast; all rows at once.
    """
    from math import lgamma

    a, b = k.astype(float), (n - k + 1).astype(float)
    flip = p > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - p, p)
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / guard(1 + even * d), guard(1 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / guard(1 + odd * d), guard(1 + odd / c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    gamma = np.vectorize(lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    return np.where(flip, 1 - front * h, front * h)


def _beta_edge(k: np.ndarray, n: np.ndarray, level: float) -> np.ndarray:
    """p at which P(X >= k) reaches ``level``, by bisection."""
    low, high = np.zeros(len(k)), np.ones(len(k))
    for _ in range(60):
        mid = (low + high) / 2
        under = _binomial_tail(k, n, mid) < level
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


@F.pandas_udf(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
def clopper_pearson(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Exact 95 % interval of a proportion (no closed form in SQL)."""
    kk, nn = k.to_numpy(np.int64), n.to_numpy(np.int64)
    lo = np.where(kk <= 0, 0.0, _beta_edge(np.maximum(kk, 1), np.maximum(nn, 1), 0.025))
    hi = np.where(kk >= nn, 1.0, _beta_edge(np.minimum(kk + 1, np.maximum(nn, 1)), np.maximum(nn, 1), 0.975))
    return pd.DataFrame({"lo": lo, "hi": hi})


def describe(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """n, mean, sample sd, min, 5 %, median, 95 %, max. Exact percentiles; groups whose x is NULL throughout have none."""
    out = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = quantiles(df, keys, x, [0.05, 0.5, 0.95]).drop("n").withColumnsRenamed({"q": "_q", **{k: f"_k{i}" for i, k in enumerate(keys)}})
    out = out.join(q, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left") if keys else out.join(q, how="left")
    return out.select(*keys, "n", "mean", "sd", "min", F.col("_q")[0].alias("p05"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p95"), "max")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
