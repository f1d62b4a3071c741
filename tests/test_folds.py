from pyspark.sql import functions as F

from plumbline.operators import baselines, folds, panel, spatial


def nine(spark):
    rows = [(i, float(i % 3) - 1.5, float(i // 3) - 1.5, float(i)) for i in range(9)] + [(9, -1.5, -1.5, 100.0)]
    return spark.createDataFrame(rows, "id long, lon double, lat double, y double")


def test_blocks_cover_the_rows_once(spark):
    b = folds.with_block(nine(spark), "lon", "lat", 2.0)
    assert b.count() == 10 and {r.fold for r in b.select("fold").distinct().collect()} == {"-1_-1", "-1_0", "0_-1", "0_0"}
    assert [(r.fold, r.n_test) for r in folds.eligible_folds(b, [], cap=2).orderBy(F.desc("n_test"), "fold").collect()] == [("-1_-1", 5), ("-1_0", 2)]
    screened = folds.screened_scales(nine(spark), "lon", "lat", [1.0, 90.0], 1).orderBy("block_deg").collect()
    assert [(r.n_folds, r.status) for r in screened] == [(9, "used"), (4, "too few folds")]


def test_chunks_differ_by_one(spark):
    got = sorted(r["count"] for r in folds.chunk_folds(nine(spark), "id", 4, 5).groupBy("fold").count().collect())
    assert got == [2, 2, 3, 3]


def test_stratified_folds_follow_the_smallest_class(spark):
    df = spark.range(40).select("id", (F.col("id") < 3).cast("int").alias("y"))
    f = folds.stratified_folds(df, "id", "y", 5)
    assert f.select("fold").distinct().count() == 3
    assert {r["count"] for r in f.filter("y = 1").groupBy("fold").count().collect()} == {1}


def test_group_folds_keep_groups_whole_and_balance(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 8), ("b", 5), ("c", 4), ("d", 3)) for i in range(n)], "g string, i int")
    got = {r.g: r.fold for r in folds.group_folds(df, "g", 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert folds.group_folds(df.filter("g in ('a', 'b')"), "g", 2).count() == 0
    many = spark.range(60_000).select(F.when(F.col("id") < 20_000, -1).otherwise(F.col("id") % 5000).alias("g"))
    loads = {r["fold"]: r["count"] for r in many.join(folds.group_folds(many, "g", 4), "g").groupBy("fold").count().collect()}
    assert loads.pop(0) == 20_000 and sorted(loads) == [1, 2, 3] and max(loads.values()) < 1.1 * min(loads.values())


def test_splits(spark):
    df = nine(spark)
    assert folds.permutation_split(df, "id", 0.8, 1).filter("is_test").count() == 2
    tr, te = df.filter("id < 5"), df.filter("id >= 5")
    assert folds.smoke_subset(df, "id", 4).count() == 4 and folds.matched_k(df) == 10 and folds.matched_k(df.limit(2)) == 5
    assert folds.overlap_count(tr, te, ["id"]).first()[0] == 0
    flags = spark.createDataFrame([("TRUE",), ("no",), (None,), (" Test ",)], "f string")
    assert [r[0] for r in flags.select(folds.author_holdout(F.col("f"))).collect()] == [True, False, False, True]
    series = spark.createDataFrame([("a", t) for t in range(50)] + [("b", t) for t in range(12)], "u string, t int")
    tail = folds.tail_split(series, "u", "t", 5, 0.2, 30)
    assert tail.filter("is_test").agg(F.min("t"), F.count("t")).first() == (40, 10) and tail.filter("u = 'b'").count() == 0
    ym = spark.createDataFrame([(200001,), (200002,), (200012,), (200101,), (200101,)], "ym int")
    assert folds.chronological_cutoff(ym, "ym", 0.8).first().cutoff == 200047


def test_overlap_greedy(spark):
    rows = [("c", "a", p) for p in range(10)] + [("c", "b", p) for p in range(2, 12)] + [("c", "x", p) for p in range(30, 33)]
    got = folds.overlap_greedy_units(spark.createDataFrame(rows, "cell string, unit string, p int"), "cell", "unit", "p", 8).collect()
    assert [(r.unit, r.n_common) for r in got] == [("a", 8), ("b", 8)]


def test_overlap_greedy_equals_set_intersections(spark):
    import random

    rng = random.Random(1)
    rows = sorted({(c, u, rng.randint(0, 25)) for c in range(6) for u in range(rng.randint(1, 9)) for _ in range(rng.randint(5, 40))})
    got = sorted(tuple(r) for r in folds.overlap_greedy_units(spark.createDataFrame(rows, "cell int, unit int, p int"), "cell", "unit", "p", 9).collect())
    want = []
    for c in range(6):
        held = {}
        for k, u, p in rows:
            if k == c:
                held.setdefault(u, set()).add(p)
        while len(held) > 1:
            common = set.intersection(*held.values())
            if len(common) >= 9:
                want += [(c, u, len(common)) for u in held]
                break
            gain = {u: len(set.intersection(*(s for v, s in held.items() if v != u))) for u in held}
            del held[max(held, key=lambda u: (gain[u], -len(held[u]), u))]
    assert got == sorted(want) and want


def test_neighbours_outside_the_own_fold(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = [(i, rng.choice([0, 0, 1, 2, None]), *rng.choice([(rng.uniform(-180, 180), rng.uniform(-90, 90)), (10.0, 20.0)]), float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, fold int, lon double, lat double, y double")
    key = lambda d: sorted((r.test_key, r.rn, r.train_key, round(r.dist, 12)) for r in d.collect())
    names = df.select("fold").distinct().filter("fold is not null")
    copies = df.withColumnRenamed("fold", "own").join(names, F.col("own") != F.col("fold"))
    want = key(spatial.knn_join(df.filter("fold is not null"), copies, 4, "id", "y", keys=("fold",)))
    assert key(spatial.knn_join(df, df, 4, "id", "y", apart="fold")) == want and want
    monkeypatch.setattr(spatial, "SMALL_PAIRS", 0)
    assert key(spatial.knn_join(df, df, 4, "id", "y", apart="fold")) == want


def test_neighbours_and_weights(spark):
    df = nine(spark)
    te, tr = df.filter("id = 0"), df.filter("id > 0")
    near = spatial.knn_join(te, tr, 8, "id", "y")
    one = spatial.idw(near, ks=(1,)).first()
    assert one.pred == 100.0  # the coincident row
    few = spatial.knn_join(te, tr, 50, "id", "y")
    assert few.count() == 9 and few.select("train_key").distinct().count() == 9
    assert near.filter("rn in (2, 3)").select("train_key").orderBy("train_key").collect() == [(1,), (3,)]
    within = spatial.nearest_and_density(te, tr, 120, "id").first()
    assert within.nearest_km == 0 and within.n_within == 3
    bins = spatial.quantile_bins(df, "y", 5).groupBy("bin").count()
    assert bins.agg(F.sum("count")).first()[0] == 10 and bins.filter("bin > 5 or bin < 1").count() == 0


def test_grid_neighbours_equal_comparing_all(spark, monkeypatch):
    import random

    rng = random.Random(2)
    rows = [(i, i % 3, *rng.choice([(rng.uniform(-180, 180), rng.uniform(-90, 90)), (91.0 + rng.gauss(0, 0.2), 26.0), (10.0, 20.0)]), float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, fold int, lon double, lat double, y double")
    te, tr = df.filter("id % 5 = 0"), df.filter("id % 5 <> 0")
    key = lambda d: sorted((r.fold, r.test_key, r.rn, r.train_key, round(r.dist, 12)) for r in d.collect())
    full = key(spatial.knn_join(te, tr, 4, "id", "y", keys=("fold",)))
    monkeypatch.setattr(spatial, "SMALL_PAIRS", 0)
    assert key(spatial.knn_join(te, tr, 4, "id", "y", keys=("fold",))) == full and len(full) == 320


def test_complement_means_equal_direct_ones(spark):
    df = spark.createDataFrame([(i, i % 3, "ab"[i % 2], float(i * i % 17)) for i in range(30)] + [(99, 2, "only here", 5.0)], "id int, fold int, g string, y double")
    got = {r.id: (r.pred, r.seen) for r in baselines.fold_group_mean(df, "fold", ["g"], "y").collect()}
    rows = [tuple(r) for r in df.collect()]
    for i, f, g, _ in rows:
        own = [y for _, k, h, y in rows if k != f and h == g]
        rest = [y for _, k, _, y in rows if k != f]
        want = sum(own) / len(own) if own else sum(rest) / len(rest)
        assert abs(got[i][0] - want) < 1e-9 and got[i][1] == bool(own)


def test_nothing_after_the_cutoff_reaches_training(spark):
    rows = [("u", t, float((t * 37) % 11)) for t in range(30)]

    def frame(data):
        df = spark.createDataFrame(data, "u string, t int, v double")
        z = panel.train_zscore(df, "u", "t", "v", 20)
        s = panel.supervised(z, "u", "t", "z", 3, [1, 2], 20)
        return {(r.t, r.horizon): tuple(r) for r in s.filter("not is_test").collect()}, s

    before, s = frame(rows)
    after, _ = frame([(u, t, v + 1000 * (t > 20)) for u, t, v in rows])
    assert before == after and max(t + h for t, h in before) == 20
    assert s.filter("is_test").agg(F.min("target_period")).first()[0] == 21
    crossing = s.filter("t = 20 and horizon = 1").first()
    assert crossing.is_test and crossing.target_period == 21


def test_lag_is_by_row_and_season_by_calendar(spark):
    df = spark.createDataFrame([("u", 200001, 1.0), ("u", 200002, 2.0), ("u", 200101, 5.0), ("u", 200103, 7.0)], "u string, ym int, z double")
    s = panel.supervised(df, "u", "ym", "z", 1, [1], 0)
    out = {r.ym: (r.target_period, r.target, r.seasonal) for r in baselines.seasonal(s, df, "u", "target_period", "ym", "z").collect()}
    assert out == {200001: (200002, 2.0, None), 200002: (200101, 5.0, 1.0), 200101: (200103, 7.0, None)}


def test_trailing_mean_and_common_periods(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0), ("b", 1, 5.0), ("b", 3, 6.0)], "u string, t int, x double")
    got = {(r.u, r.t): r.trailing for r in panel.trailing_mean(df, ["u"], "t", "x").collect()}
    assert got == {("a", 1): None, ("a", 2): None, ("a", 3): 2.0, ("b", 1): None, ("b", 3): 5.5}
    assert sorted(r.t for r in panel.common_periods(df, "u", "t").collect()) == [1, 3]
