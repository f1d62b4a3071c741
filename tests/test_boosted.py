"""Boosting of all folds at once against one model after the other in numpy."""

import random

import numpy as np
import pytest

from plumbline.operators import boosted


def bins_of(v, edges):
    return np.array([0 if x is None else int(np.searchsorted(edges, x, side="left")) for x in v])


def one_tree(x, g, depth, bins, l2, least, one):
    """Recursive: a leaf is (gradient, rows), a node (feature, bin, left, right)."""
    total, n = int(g.sum()) / one, len(g)
    best = (1e-9, None)
    if depth and n >= 2 * least:
        for f in range(x.shape[1]):
            for b in range(bins - 1):
                left = x[:, f] <= b
                nl = int(left.sum())
                if nl < least or n - nl < least:
                    continue
                gl = int(g[left].sum()) / one
                gain = gl * gl / (nl + l2) + (total - gl) * (total - gl) / (n - nl + l2) - total * total / (n + l2)
                if gain > best[0]:
                    best = (gain, (f, b))
    if best[1] is None:
        return total / (n + l2) if n else 0.0
    f, b = best[1]
    left = x[:, f] <= b
    return f, b, one_tree(x[left], g[left], depth - 1, bins, l2, least, one), one_tree(x[~left], g[~left], depth - 1, bins, l2, least, one)


def value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def brute(rows, edges, rounds, depth, rate, bins, least):
    x = np.stack([bins_of([r[3] for r in rows], edges[0]), bins_of([r[4] for r in rows], edges[1])], 1)
    ys = [r[5] for r in rows if r[5] is not None and r[1] is not None]
    unit = boosted.ONE / max(max(ys) - min(ys), *map(abs, ys))
    out = {}
    for key, fold in {(r[2], r[1]) for r in rows if r[1] is not None}:
        train = [i for i, r in enumerate(rows) if r[2] == key and r[1] is not None and r[1] != fold and r[5] is not None]
        mine = [i for i, r in enumerate(rows) if r[2] == key and r[1] == fold]
        if not train:
            continue
        y = np.array([rows[i][5] for i in train])
        start = y.mean()
        pred, test = np.full(len(train), start), np.full(len(mine), start)
        for _ in range(rounds):
            g = np.rint((y - pred) * unit).astype(np.int64)
            tree = one_tree(x[train], g, depth, bins, 1.0, least, boosted.ONE)
            scale = rate / unit * boosted.ONE
            pred = pred + np.array([scale * value(tree, x[i]) for i in train])
            test = test + np.array([scale * value(tree, x[i]) for i in mine])
        out |= {rows[i][0]: p for i, p in zip(mine, test)}
    return out


def make_rows(n=240):
    rng = random.Random(3)
    out = []
    for i in range(n):
        a, b = rng.choice([None, *range(6)]), rng.gauss(0, 1)
        y = None if i % 31 == 0 else (a or 0) * 0.5 + (b > 0.3) * 2 + rng.random() * 0.1
        out.append((i, None if i % 37 == 0 else i % 3, "uv"[i % 5 == 0], None if a is None else float(a), b, y))
    return out


@pytest.mark.parametrize("rounds, depth, bins, least, every, few", [(5, 3, 8, 1, 2, 8), (4, 2, 64, 10, 10, 0), (6, 1, 3, 1, 3, 8)])
def test_equals_one_model_after_the_other(spark, monkeypatch, rounds, depth, bins, least, every, few):
    monkeypatch.setattr(boosted, "KEEP_EVERY", every)
    monkeypatch.setattr(boosted, "FEW_TASKS", few)
    rows = make_rows()
    df = spark.createDataFrame(rows, "id long, fold int, k string, a double, b double, y double").repartition(3)
    edges = boosted.bin_edges(df, ["a", "b"], bins)
    got = {r.id: r.pred for r in boosted.cross_fit_boosting(df, "fold", ["a", "b"], "y", rounds, depth, 0.3, least=least, bins=bins, keys=("k",)).collect()}
    want = brute(rows, edges, rounds, depth, 0.3, bins, least)
    assert len(got) == len(rows) and {i for i, p in got.items() if p is not None} == set(want)
    for i, p in want.items():
        assert abs(got[i] - p) < 1e-9, i


def test_learns_and_handles_little(spark):
    df = spark.range(600).selectExpr("id", "cast(id % 3 as int) as fold", "cast(id % 20 as double) as x", "cast(id % 20 > 9 as double) as y")
    p = boosted.cross_fit_boosting(df, "fold", ["x"], "y", 20, 2, 0.5).collect()
    assert max(abs(r.pred - r.y) for r in p) < 0.05
    one = boosted.cross_fit_boosting(df.filter("fold = 0"), "fold", ["x"], "y", 3, 2).collect()
    assert one and all(r.pred is None for r in one)
    assert boosted.cross_fit_boosting(df.filter("id < 0"), "fold", ["x"], "y", 3, 2).count() == 0
