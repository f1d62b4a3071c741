"""Neighbours in feature space against a comparison of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import metric_index


def brute(rows, k, apart):
    rows = [r for r in rows if None not in r[2:4] and (not apart or r[1] is not None)]
    train = [r for r in rows if r[4] is not None]
    out = []
    for q in rows:
        near = sorted(((q[2] - t[2]) * (q[2] - t[2]) + (q[3] - t[3]) * (q[3] - t[3]), t[0], t[4]) for t in train if not apart or t[1] != q[1])[:k]
        out += [(q[0], t, v, d, i) for i, (d, t, v) in enumerate(near, 1)]
    return sorted(out)


def rows(n, shape):
    rng = random.Random(n)
    place = {
        "spread": lambda i: (rng.gauss(0, 1), rng.gauss(0, 1)),
        "piles": lambda i: (float(i % 3 == 0), float(i % 2 == 0)) if i % 4 else (rng.random(), rng.random()),
        "ring": lambda i: (float(np.cos(i)), float(np.sin(i))),
        "one place": lambda i: (0.5, 0.5),
        "far apart": lambda i: (10.0 ** rng.randint(-6, 6), rng.choice([0.0, 1e9])),
    }[shape]
    return [(i, i % 3 if i % 50 else None, *place(i), float(rng.randint(0, 9)) if i % 17 else None) for i in range(n)] + [(n + 1, 0, None, 1.0, 2.0)]


@pytest.fixture(autouse=True)
def always_an_index(monkeypatch):
    monkeypatch.setattr(metric_index, "ONE_CELL", 0)


@pytest.mark.parametrize("shape", ["spread", "piles", "ring", "one place", "far apart"])
@pytest.mark.parametrize("apart", [None, "fold"])
def test_equals_all_pairs(spark, monkeypatch, shape, apart):
    monkeypatch.setattr(metric_index, "LEAST_CELL", 4)
    monkeypatch.setattr(metric_index, "MOST_RINGS", 3)
    monkeypatch.setattr(metric_index, "QUERY_ROWS", 20)
    data = rows(400, shape)
    df = spark.createDataFrame(data, "id long, fold long, a double, b double, y double")
    got = metric_index.nearest_rows(df, df, ["a", "b"], "y", "id", 5, apart).collect()
    assert sorted(map(tuple, got)) == brute(data, 5, apart)


def test_one_cell_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(metric_index, "ONE_CELL", 1000)
    data = rows(200, "piles")
    df = spark.createDataFrame(data, "id long, fold long, a double, b double, y double")
    assert sorted(map(tuple, metric_index.nearest_rows(df, df, ["a", "b"], "y", "id", 5, "fold").collect())) == brute(data, 5, "fold")


def test_own_part_around_the_query_and_too_few_rows(spark, monkeypatch):
    """All near rows are of the query's own part; and a part that holds nearly all rows leaves fewer than k."""
    data = [(i, i // 100, i // 100 + (i % 10) / 100, 0.0, 1.0 * i) for i in range(300)]
    df = spark.createDataFrame(data, "id long, fold long, a double, b double, y double")
    for most in (1 << 20, 0):
        monkeypatch.setattr(metric_index, "MOST_OWN", most)
        assert sorted(map(tuple, metric_index.nearest_rows(df, df, ["a", "b"], "y", "id", 7, "fold").collect())) == brute(data, 7, "fold")
    few = spark.createDataFrame(data[:3] + [(500, 9, 0.0, 0.0, 1.0)], df.schema)
    assert sorted(map(tuple, metric_index.nearest_rows(few, few, ["a", "b"], "y", "id", 7, "fold").collect())) == brute(data[:3] + [(500, 9, 0.0, 0.0, 1.0)], 7, "fold")


def test_pairs_grow_well_below_the_square(spark):
    def pairs(n):
        df = spark.range(n).select(F.col("id").alias("_k"), F.lit(0.0).alias("_y"), F.array(F.rand(1), F.rand(2)).alias("_v")).cache()
        held, cells = metric_index.build(df, 2, False)
        queries = df.select(F.col("_k").alias("_q"), F.col("_v").alias("_w"))
        first = metric_index.asked_cells(queries, cells, 8, 2, False)
        far = (8 / n / 3.14159) * 4  # about twice the distance of the 8th
        later = metric_index.asked_cells(queries.withColumn("_far", F.lit(far)), cells, 8, 2, True)
        met = sum(int(cells.n[r["_cell"]]) * r["n"] for d in (first, later) for r in d.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect())
        return met

    small, large = pairs(2_000), pairs(16_000)
    assert large < 0.1 * 16_000**2 and large / small < 8**1.7


@pytest.mark.parametrize("most", [0, 1000])
def test_no_rows(spark, monkeypatch, most):
    monkeypatch.setattr(metric_index, "ONE_CELL", most)
    df = spark.createDataFrame([], "id long, a double, y double")
    assert metric_index.nearest_rows(df, df, ["a"], "y", "id").count() == 0
    one = spark.createDataFrame([(1, 2.0, 3.0)], "id long, a double, y double")
    assert [tuple(r) for r in metric_index.nearest_rows(one, one, ["a"], "y", "id", 3).collect()] == [(1, 1, 3.0, 0.0, 1)]


def test_rows_deep_in_a_block_do_not_meet_the_block(spark, monkeypatch):
    from plumbline.operators import spatial

    n = 6000
    df = spark.range(n).select("id", (F.rand(1) * 40 + F.col("id") % 2 * 40).alias("lon"), (F.rand(2) * 40).alias("lat"), (F.col("id") % 2).alias("fold"), F.when(F.col("id") % 7 > 0, F.rand(3)).alias("y"))
    df = spark.createDataFrame(df.collect(), df.schema)
    ask, met = metric_index.asked_cells, []

    def asked(queries, cells, *args):
        out = ask(queries, cells, *args)
        met.append(sum(int(cells.n[r["_cell"]]) * r["n"] for r in out.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()))
        return out

    some = df.filter("id % 20 = 0")
    want = sorted(map(tuple, spatial.knn_join(some, df, 4, "id", "y", apart="fold").collect()))
    monkeypatch.setattr(metric_index, "asked_cells", asked)
    monkeypatch.setattr(spatial, "SMALL_PAIRS", 0)
    assert sorted(map(tuple, spatial.knn_join(some, df, 4, "id", "y", apart="fold").collect())) == want and len(want) == n // 20 * 4
    assert len(met) == 2 and sum(met) < 0.2 * n / 20 * n


def test_search_deals_its_work_out_and_starts_no_python_for_small_tables(spark):
    """Before, shuffles of few bytes were joined into one task, which then met all cells, and the first round was computed twice."""
    from plumbline.operators import logistic, spatial

    rows = [(i, float(i * 37 % 360 - 180), float(i * 53 % 180 - 90), float(i % 7), i % 3, int(i % 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double, y double, fold long, hit int")
    dealt, met, meet, asked = [], [], metric_index._meet, metric_index.asked_cells
    with pytest.MonkeyPatch.context() as m:
        m.setattr(metric_index, "ONE_CELL", 10)
        m.setattr(metric_index, "asked_cells", lambda q, *a, **kw: dealt.append(q.rdd.getNumPartitions()) or asked(q, *a, **kw))
        m.setattr(metric_index, "_meet", lambda a, *more: met.append("MapInArrow" in a._jdf.queryExecution().executedPlan().toString()) or meet(a, *more))
        near = spatial.knn_join(df.repartition(1), df, 3, "id", "y", apart="fold", small=False)
        assert near.count() == 1800
        plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert dealt[0] >= metric_index._tasks(spark) and met == [False, False] and "RepartitionByExpression" in plan
    plan = logistic.cross_fit_logistic(df, "fold", ["lon"], "hit")._jdf.queryExecution().optimizedPlan().toString()
    assert "ExternalRDD" not in plan and "Scan ExistingRDD" not in plan


def test_few_nearest_cells_hold_what_all_in_order_hold(monkeypatch):
    rng = np.random.default_rng(5)
    upper, left = rng.random((300, 90)), rng.integers(0, 3, (300, 90))
    left[:100] = np.where(rng.random((100, 90)) < 0.97, 0, 1)
    cells = metric_index.Cells(*[np.zeros((1, 1))] * 5, {})
    got = cells.first(upper, left, 8)
    monkeypatch.setattr(metric_index, "FEW", 90)
    assert (got == cells.first(upper, left, 8)).all() and (got[100:] * left[100:]).sum(1).min() >= 8


def test_a_block_of_distances_takes_few_megabytes():
    """Before, a Python worker held several arrays of two million distances each."""
    import tracemalloc

    import pyarrow as pa

    points = np.random.default_rng(1).random((10_000, 4))
    batch = pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), 4).cast(pa.list_(pa.float64()))], names=["_v"])
    tracemalloc.start()
    try:
        assert sum(len(b) for b in metric_index._homes(points[:300])(iter([batch]))) == len(points)
        assert tracemalloc.get_traced_memory()[1] < 12e6
    finally:
        tracemalloc.stop()
