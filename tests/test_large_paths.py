"""Queries give the same rows on the paths that large tables take."""

import pytest

import __spark_entry__ as entry
from plumbline.operators import metric_index, spatial

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q5_exceedance_recovery", "q6_three_regimes"])
def test_neighbours_by_pivots_give_the_same_rows(spark, monkeypatch, name):
    run, searched, whole = entry.queries()[name], [], spatial.search
    want = sorted(map(tuple, run(spark, SF).collect()))
    monkeypatch.setattr(spatial, "SMALL_PAIRS", 0)
    monkeypatch.setattr(metric_index, "ONE_CELL", 10)
    monkeypatch.setattr(spatial, "search", lambda *a, **kw: searched.append(1) or whole(*a, **kw))
    assert sorted(map(tuple, run(spark, SF).collect())) == want and searched


@pytest.mark.parametrize("most", [20_000_000, 500])
def test_draws_on_arrays_are_those_of_columns(spark, monkeypatch, most):
    import numpy as np
    from pyspark.sql import functions as F

    from plumbline.functions import draws
    from plumbline.operators import bootstrap

    monkeypatch.setattr(bootstrap, "TASK_DRAWS", most)
    rows = [(k, u, float(u * u % 31) if u % 5 else None) for k in ("a", None) for u in range(40)]
    df = spark.createDataFrame(rows, "k string, u long, v double").withColumn("_u", bootstrap._hashed("u"))
    every = df.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(60)))).withColumn("_c", draws.poisson(F.col("_u"), F.col("_b"), 3))
    got = every.select("_u", "_b", "_c").collect()
    assert draws.poissons(np.array([r[0] for r in got]), np.array([r[1] for r in got]), 3).tolist() == [r[2] for r in got]
    one = every.filter("_c > 0 and v is not null").select("k", "_b", "v", F.explode(F.sequence(F.lit(1), "_c")))
    want = one.groupBy("k", "_b").agg(F.median("v").alias("m"))
    key = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert key(bootstrap.weighted_medians(df, ["k"], "v", 60, 3)) == key(want)
    assert bootstrap._dealt(df, 60).rdd.getNumPartitions() == max(1, -(-80 * 60 // most))


def test_models_and_fold_sums_go_out_to_the_rows(spark, monkeypatch):
    """A join by fold alone sends all rows of a fold to one task."""
    import re

    from plumbline.operators import baselines, learners

    df = spark.range(200).selectExpr("id", "cast(id % 3 as int) as fold", "id % 40 as grp", "cast(id % 7 as double) as x", "cast(id % 11 as double) as y")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (learners.cross_fit_linear(df, "fold", ["x"], "y"), learners.cross_fit_single(df, "fold", ["x"], "y"), baselines.fold_group_mean(df, "fold", ["grp"], "y")):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"SortMergeJoin \[(fold#\d+)\], ", plan) and "BroadcastHashJoin [fold#" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_search_leaves_no_tables_behind(spark, monkeypatch):
    """Before, the cells and candidates of all three regimes stayed until the folder was cleared."""
    from pathlib import Path
    from urllib.parse import urlparse

    from plumbline.shared import folder

    there = Path(urlparse(folder(spark)).path)
    before = set(there.iterdir())
    monkeypatch.setattr(spatial, "SMALL_PAIRS", 0)
    monkeypatch.setattr(metric_index, "ONE_CELL", 10)
    entry.queries()["q6_three_regimes"](spark, SF)
    assert {p.name.split("-")[0] for p in set(there.iterdir()) - before} == {"near"}
