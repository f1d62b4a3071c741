"""Logistic regression of all folds at once against one Newton iteration after the other in numpy."""

import numpy as np
import pytest

from plumbline.operators import logistic


def newton(x, y, w, alpha, steps):
    mean = (w[:, None] * x).sum(0) / w.sum()
    sd = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / w.sum()) + 1e-8
    z, theta = np.c_[np.ones(len(x)), (x - mean) / sd], np.zeros(x.shape[1] + 1)
    pen = np.array([0.0, *[alpha] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ theta))
        g = z.T @ (w * (y - p)) / w.sum() - pen * theta
        h = (z * (w * p * (1 - p))[:, None]).T @ z / w.sum() + np.diag(pen + logistic.FLOOR)
        theta = theta + np.linalg.solve(h, g)
    return lambda new: 1 / (1 + np.exp(-np.c_[np.ones(len(new)), (new - mean) / sd] @ theta)), np.abs(g).max()


@pytest.mark.parametrize("alpha, weighted", [(0.0, False), (0.05, True)])
def test_equals_one_fold_after_the_other(spark, alpha, weighted):
    rng = np.random.default_rng(2)
    n = 500
    x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [0, 5, -1]
    y = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0] + 0.2 * (x[:, 1] - 5)))).astype(int)
    w = rng.integers(1, 4, n).astype(float) if weighted else np.ones(n)
    key, fold = np.arange(n) % 2, np.arange(n) // 2 % 3
    rows = [(i, int(key[i]), int(fold[i]), *map(float, x[i]), int(y[i]), float(w[i])) for i in range(n)]
    more = [(n, 0, 1, None, 1.0, 2.0, 1, 1.0), (n + 1, 0, 1, 0.5, 1.0, 2.0, None, 1.0), (n + 2, 0, None, 0.5, 1.0, 2.0, 1, 1.0), (n + 3, 9, 1, 0.5, 1.0, 2.0, 1, 1.0)]
    df = spark.createDataFrame(rows + more, "id int, k int, fold int, a double, b double, c double, y int, w double")
    got = {r.id: r.pred for r in logistic.cross_fit_logistic(df, "fold", ["a", "b", "c"], "y", alpha, 9, ("k",), "w" if weighted else None).collect()}
    assert len(got) == n + 4 and got[n] is None and got[n + 1] is not None and got[n + 2] is None and got[n + 3] is None
    for k in range(2):
        for f in range(3):
            tr, te = (key == k) & (fold != f), (key == k) & (fold == f)
            model, slope = newton(x[tr], y[tr], w[tr], alpha, 9)
            assert slope < 1e-8  # nine steps are enough
            assert np.allclose([got[i] for i in np.flatnonzero(te)], model(x[te]), atol=1e-9)


def test_separable_and_empty(spark):
    df = spark.range(40).selectExpr("id", "id % 2 as fold", "cast(id as double) as x", "cast(id > 19 as int) as y", "1.0D as same")
    p = logistic.cross_fit_logistic(df, "fold", ["x", "same"], "y").collect()
    assert all((r.pred > 0.5) == (r.y == 1) for r in p if abs(r.id - 19.5) > 1)  # the line may lie on the two rows in the middle
    assert logistic.cross_fit_logistic(df.filter("id < 0"), "fold", ["x"], "y").count() == 0
    assert {r.pred for r in logistic.cross_fit_logistic(df.filter("fold = 0"), "fold", ["x"], "y").collect()} == {None}
