"""The perceptron's gradient against differences, its sums against one table in numpy, and what it learns."""

import numpy as np
import pytest

from plumbline.operators import perceptron


@pytest.mark.parametrize("hidden", [(), (5,), (4, 3)])
def test_gradient_equals_differences(hidden):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    w = perceptron.begin(3, hidden, 2) + 0.01 * rng.normal(size=len(perceptron.begin(3, hidden, 2)))
    g, _ = perceptron.gradient(w, x, y, hidden)
    for i in range(len(w)):
        step = np.zeros(len(w))
        step[i] = 1e-6
        up, down = (perceptron.gradient(w + s, x, y, hidden)[1] for s in (step, -step))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def alone(x, y, new, hidden, steps, rate, l2, seed):
    """One model on one table."""
    m, s, my, sy = x.mean(0), x.std(0) + 1e-8, y.mean(), y.std() + 1e-8
    w = perceptron.begin(x.shape[1], hidden, seed)
    a, b = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, steps + 1):
        g = perceptron.gradient(w, (x - m) / s, (y - my) / sy, hidden)[0] / len(x) + l2 * w
        a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
        w = w - rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return perceptron.forward(w, (new - m) / s, hidden)[-1][:, 0] * sy + my


@pytest.mark.parametrize("few", [16, 0])
def test_sums_over_tasks_equal_one_table(spark, monkeypatch, few):
    monkeypatch.setattr(perceptron, "FEW_TASKS", few)
    monkeypatch.setattr(perceptron, "AT_ONCE", 30)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 2)) * [3, 1] + [1, 0]
    y, fold = np.sin(x[:, 0]) + x[:, 1], np.arange(240) % 3
    rows = [(i, int(fold[i]), float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(240)]
    rows += [(240, None, 1.0, 1.0, 1.0), (241, 1, None, 1.0, 1.0), (242, 1, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id int, fold int, a double, b double, y double").repartition(5)
    got = {r.id: r.pred for r in perceptron.cross_fit_perceptron(df, "fold", ["a", "b"], "y", (6,), 8, 0.05).collect()}
    assert len(got) == 243 and got[240] is None and got[241] is None and got[242] is not None
    for f in range(3):
        want = alone(x[fold != f], y[fold != f], x[fold == f], (6,), 8, 0.05, 1e-4, 42 + f)
        assert np.allclose([got[int(i)] for i in np.flatnonzero(fold == f)], want, atol=1e-7)


def test_learns_a_curve_and_handles_little(spark):
    df = spark.range(400).selectExpr("cast(id % 2 as int) as fold", "(id - 200) / 100D as x", "sin((id - 200) / 60D) as y").repartition(2)
    r = perceptron.cross_fit_perceptron(df, "fold", ["x"], "y", (16,), 120, 0.05).selectExpr("1 - avg((y - pred) * (y - pred)) / var_pop(y) AS r2").first()
    assert r.r2 > 0.9
    assert {x.pred for x in perceptron.cross_fit_perceptron(df.filter("fold = 0"), "fold", ["x"], "y", (3,), 2).collect()} == {None}
    assert perceptron.cross_fit_perceptron(df.filter("fold > 5"), "fold", ["x"], "y", (3,), 2).count() == 0


def test_rows_that_do_not_count_add_nothing():
    rng = np.random.default_rng(4)
    x, y, counts = rng.normal(size=(50, 3)), rng.normal(size=50), np.arange(50) % 3 != 0
    w = perceptron.begin(3, (5, 4), 1)
    got, want = perceptron.gradient(w, x, y, (5, 4), counts), perceptron.gradient(w, x[counts], y[counts], (5, 4))
    assert np.allclose(got[0], want[0], atol=1e-12) and got[1] == pytest.approx(want[1])
