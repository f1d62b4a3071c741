import numpy as np
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import bootstrap, metrics, summary
from plumbline.operators.ranking import average_rank, row_rank, running_sums


def brute_auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    if not pos or not neg:
        return None
    return sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / len(pos) / len(neg)


def brute_ap(rows):
    p, total, tp, k = sum(y for y, _ in rows), 0.0, 0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        at = [y for y, v in rows if v == s]
        tp, k = tp + sum(at), k + len(at)
        total += sum(at) / p * tp / k
    return total


def test_auc_and_ap_with_ties_and_signed_zero(spark):
    rng = random.Random(1)
    rows = [(g, rng.randint(0, 1), rng.choice([-1.0, -0.0, 0.0, 0.5, 2.0, rng.random()])) for g in "ab" for _ in range(200)] + [("c", 1, 0.2)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = {r.g: r for r in metrics.auc(df, ["g"], "y", "s").collect()}
    ap = {r.g: r for r in metrics.average_precision(df, ["g"], "y", "s").collect()}
    for g in "ab":
        own = [(y, s) for k, y, s in rows if k == g]
        assert got[g].auc == pytest.approx(brute_auc(own), abs=1e-12)
        assert ap[g].ap == pytest.approx(brute_ap(own), abs=1e-12)
        assert ap[g].ap_lift == pytest.approx(ap[g].ap / ap[g].prevalence)
    assert got["c"].auc is None


def test_auc_of_reversed_scores(spark):
    df = spark.createDataFrame([(i % 3 == 0, float(i % 7)) for i in range(60)], "y boolean, s double").withColumn("r", -F.col("s"))
    a, b = (metrics.auc(df, [], "y", c).first().auc for c in ("s", "r"))
    assert a + b == pytest.approx(1)


def test_r2_guards(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.5), ("a", 4.0, 3.0), ("b", 1.0, 2.0), ("b", 1.0, 1.0), ("c", 1.0, None)], "g string, y double, p double")
    got = {r.g: r for r in df.groupBy("g").agg(metrics.r2("y", "p", 3).alias("r2"), metrics.rmse("y", "p").alias("rmse")).collect()}
    assert got["a"].r2 == pytest.approx(1 - 1.25 / (14 / 3)) and got["b"].r2 is None and got["c"].r2 is None and got["c"].rmse is None
    assert got["a"].rmse == pytest.approx(math.sqrt(1.25 / 3))


def test_kappa_extremes(spark):
    df = spark.createDataFrame([("same", "x", "x"), ("same", "y", "y"), ("chance", "x", "x"), ("chance", "x", "y"), ("chance", "y", "x"), ("chance", "y", "y"), ("one", "x", "x"), ("same", None, "x")], "g string, a string, b string")
    got = {r.g: r for r in metrics.kappa(df, ["g"], "a", "b").collect()}
    assert got["same"].kappa == 1 and got["chance"].kappa == 0 and got["one"].kappa is None and got["same"].n == 2


def test_proportion_intervals(spark):
    df = spark.createDataFrame([(6, 68), (2, 91), (0, 10), (10, 10)], "k long, n long")
    lo, hi = metrics.wilson(F.col("k"), F.col("n"))
    got = df.select("k", metrics.clopper_pearson("k", "n").alias("c"), lo.alias("lo"), hi.alias("hi")).collect()
    # exact limits of 6 of 68 and 2 of 91
    assert [round(100 * got[0].c.lo, 1), round(100 * got[0].c.hi, 1)] == [3.3, 18.2]
    assert [round(100 * got[1].c.lo, 2), round(100 * got[1].c.hi, 2)] == [0.27, 7.71]
    k, n = np.array([1, 3, 7, 250_000]), np.array([4, 9, 11, 1_000_000])
    from math import comb

    for p in (0.01, 0.3, 0.9):
        want = [sum(comb(int(b), x) * p**x * (1 - p) ** (int(b) - x) for x in range(int(a), int(b) + 1)) for a, b in zip(k[:3], n[:3])]
        assert np.allclose(metrics._binomial_tail(k[:3], n[:3], np.full(3, p)), want, rtol=1e-10)
    assert abs(metrics._binomial_tail(k, n, np.full(4, 0.25))[3] - 0.5) < 0.001
    assert got[2].c.lo == 0 and got[3].c.hi == 1 and all(0 <= r.lo <= r.k / 91 or r.k for r in got)


def test_spearman_equals_pearson_of_ranks(spark):
    rows = [(i, float((i * 7) % 13), float((i * 5) % 11)) for i in range(80)] + [(99, None, 1.0)]
    df = spark.createDataFrame(rows, "i int, a double, b double")
    got = metrics.spearman(df, [], "a", "b").first()

    def ranks(x):
        return [sum(v < w for v in x) + (sum(v == w for v in x) + 1) / 2 for w in x]

    a, b = ranks([r[1] for r in rows[:-1]]), ranks([r[2] for r in rows[:-1]])
    ma, mb = sum(a) / 80, sum(b) / 80
    rho = sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
    assert got.n == 80 and got.rho == pytest.approx(rho)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-3, 3)), min_size=1, max_size=60))
def test_distributed_ranks_equal_sorting(spark, rows):
    df = spark.createDataFrame([(i, g, float(x)) for i, (g, x) in enumerate(rows)], "i int, g string, x double")
    sums = {(r.g, r.x): (r.n, r.n_below) for r in running_sums(df, ["g"], "x", {"n": F.lit(1)}).collect()}
    mean = {r.i: r.k for r in average_rank(df, ["g"], "x", "k").collect()}
    number = {r.i: r.k for r in row_rank(df, ["g"], "x", ["i"], "k").collect()}
    for i, (g, x) in enumerate(rows):
        own = sorted((float(v), j) for j, (h, v) in enumerate(rows) if h == g)
        below, at = sum(v < x for v, _ in own), sum(v == x for v, _ in own)
        assert sums[g, float(x)] == (at, below) and mean[i] == below + (at + 1) / 2 and number[i] == own.index((float(x), i)) + 1


def test_bootstrap_keeps_pairs_and_contains_the_point(spark):
    df = spark.createDataFrame([("d", i, float(i), float(i) - 0.5) for i in range(15)], "d string, i int, a double, b double")
    got = bootstrap.interval(df, ["d"], "i", F.median("a") - F.median("b"), 200).first()
    assert got.lo == got.hi == 0.5
    one = bootstrap.interval(df, ["d"], "i", F.median("a"), 200).first()
    assert one.lo <= 7 <= one.hi and one.lo < one.hi


def test_summaries(spark):
    df = spark.createDataFrame([("random", 1, 0.9, 10), ("random", 2, 0.5, 30), ("spatial", 1, 0.4, 10), ("spatial", 2, None, 5)], "regime string, fold int, m double, n int")
    got = {r.regime: r for r in summary.fold_summary(df, ["regime"], "m", "n").collect()}
    assert got["random"].weighted_mean == pytest.approx(0.6) and got["spatial"].n_folds == 1 and got["spatial"].weighted_mean == pytest.approx(0.4)
    gap = summary.regime_gap(df, [], "regime", "m").first()
    assert gap.gap == pytest.approx(0.3)
    wide = summary.pivot_models(df, ["fold"], "regime", ["random", "spatial"], "m")
    assert [tuple(r) for r in wide.collect()] == [(1, 0.9, 0.4)]
    odd = spark.createDataFrame([(1.0, 0.0), (2.0, 2.0), (9.0, 3.0)], "a double, b double")
    r = summary.paired_medians(odd, [], "a", "b").first()
    assert (r.median_of_differences, r.difference_of_medians) == (1.0, 0.0)
    assert summary.cross_table(df, "regime", "fold").count() == 4
    tie = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None)], "m string, s double").withColumn("g", F.lit(1))
    assert summary.best_model(tie, ["g"], "m", "s").first().best == "a"
