import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import contracts, encode, learners, relational


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.0] + 0.5 + 0.1 * rng.normal(size=300)
    rows = [(i, i % 5, *map(float, x[i]), float(y[i])) for i in range(300)]
    return spark.createDataFrame(rows, "id long, fold int, a double, b double, c double, y double"), x, y


def test_cross_fitting_by_subtraction_equals_refitting(spark, data):
    df, x, y = data
    got = {r.id: r.pred for r in learners.cross_fit_linear(df, "fold", ["a", "b", "c"], "y", 1.0).collect()}
    for f in range(5):
        tr = np.arange(300) % 5 != f
        m, s = x[tr].mean(0), x[tr].std(0) + 1e-8
        z = (x[tr] - m) / s
        beta = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y[tr] - y[tr].mean()))
        for i in np.flatnonzero(~tr)[:10]:
            assert got[int(i)] == pytest.approx(float((x[i] - m) / s @ beta + y[tr].mean()), abs=1e-9)


def test_elastic_net_meets_its_optimality_conditions(spark, data):
    df, x, y = data
    for ratio in (1.0, 0.5):
        beta, a = learners.fit_linear(df, ["a", "b", "c"], "y", alpha=0.05, l1_ratio=ratio)
        grad = x.T @ (y - x @ beta - a) / 300 - 0.05 * (1 - ratio) * beta
        for b, g in zip(beta, grad):
            assert abs(g) <= 0.05 * ratio + 1e-8 if b == 0 else g == pytest.approx(0.05 * ratio * np.sign(b), abs=1e-8)


def test_ols_and_proxy(spark, data):
    df, x, y = data
    beta, a = learners.fit_linear(df, ["a", "b"], "y")
    want = np.linalg.lstsq(np.c_[x[:, :2], np.ones(300)], y, rcond=None)[0]
    assert np.allclose([*beta, a], want)
    assert learners.single_proxy(df, ["a", "b", "c"], "y", F.lit(True)).first().feature == "b"


def test_discriminant_and_knn(spark, data):
    df, x, y = data
    d = df.withColumn("k", (F.col("y") > 0).cast("int"))
    scored = learners.lda_scores(d, ["a", "b", "c"], learners.fit_lda(d, ["a", "b", "c"], "k"))
    assert scored.filter("pred = k").count() > 270
    te, tr = df.filter("id < 20"), df.filter("id >= 20")
    got = {r.test_key: r.pred for r in learners.knn_features(te, tr, ["a", "b"], "y", "id", 4).collect()}
    for i in range(20):
        dist = ((x[20:, :2] - x[i, :2]) ** 2).sum(1)
        assert got[i] == pytest.approx(y[20:][np.argsort(dist, kind="stable")[:4]].mean())


def test_failed_fit_is_a_row(spark):
    out = learners.fit_or_status(lambda: spark.table("no_such_table"), spark, "r2 double", model="x").first()
    assert (out.status, out.r2, out.model) == ("failed", None, "x")
    ok = learners.fit_or_status(lambda: spark.createDataFrame([(0.5,)], "r2 double"), spark, "r2 double", model="x").first()
    assert (ok.status, ok.r2) == ("ok", 0.5)


def test_forest_predicts(spark, data):
    df, _, _ = data
    p = learners.fit_predict(learners.forest(10, 4), df.filter("fold > 0"), df.filter("fold = 0"), ["a", "b", "c"], "y")
    assert p.count() == 60 and p.filter("pred is null").count() == 0


def test_encoding(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "c string, i int")
    hot = encode.one_hot(df, "c").orderBy("i").collect()
    assert [(r.c_x, r.c_y, r.c_NA) for r in hot] == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    back = encode.one_hot_decode(spark.createDataFrame([(0, 1), (1, 1), (0, 0)], "a int, b int"), ["a", "b"], "k")
    assert [r.k for r in back.collect()] == ["b", "a"]
    leak = {r.column: r.reason for r in encode.leakage_relation(spark.createDataFrame([(1, 1, 1, 1)], "NO3 int, `NO3-N (mg)` int, pH int, id int"), "NO3", {}, ["id"]).collect()}
    assert leak == {"NO3": "target", "NO3-N (mg)": "derivative", "pH": None, "id": "structural"}
    wide = spark.createDataFrame([("s", 1, 2)], "s string, v int, `v.1` int")
    assert sorted(r.v for r in encode.stack_blocks(wide, ["s"]).collect()) == [1, 2]
    assert encode.first_valid(spark.createDataFrame([(None, 2), (1, 3)], "a int, b int"), ["a", "b", "zz"], "v").collect() == [(2,), (1,)]


def test_outer_merge_matches_null_keys(spark):
    a = spark.createDataFrame([(1, "p"), (None, "q")], "k int, x string")
    b = spark.createDataFrame([(None, 5, "other"), (2, 6, "other")], "k int, y int, x string")
    got = sorted((tuple(r) for r in relational.outer_merge([a, b], ["k"]).collect()), key=str)
    assert got == [(1, "p", None), (2, None, 6), (None, "q", 5)]


def test_resume_and_last_row(spark):
    work = spark.createDataFrame([(1, None), (1, 2), (2, 2)], "a int, b int")
    assert relational.not_yet_done(work, spark.createDataFrame([(1, None), (2, 2)], "a int, b int"), ["a", "b"]).collect() == [(1, 2)]
    rows = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "x")], "k int, seq int, v string")
    assert sorted(r.v for r in relational.keep_last(rows, ["k"], ["seq"]).collect()) == ["new", "x"]
    assert relational.grid(spark, {"h": [1, 3, 3], "m": ["a", "b"]}).count() == 4


def test_contracts(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (2, 3.0)], "k int, v double")
    status = lambda d: d.first().status
    assert status(contracts.row_count(df, "n", 3)) == "ok" and status(contracts.row_count(df, "n", 2, F.col("v").isNotNull())) == "ok"
    assert status(contracts.unique(df, "u", ["k"])) == "failed" and status(contracts.every(df, "v", F.col("v") > 0)) == "failed"
    assert status(contracts.forbidden_columns(df, "f", ["V"])) == "failed" and status(contracts.same_keys(df, df.limit(2), "s", ["k"])) == "failed"
    assert status(contracts.same_keys(df, df, "s", ["k"])) == "ok" and status(contracts.parts_sum(df, "p", "v", 3.5)) == "ok"
    assert status(contracts.same_count(df, df, "c")) == "ok" and status(contracts.same_count(df, df.limit(1), "c")) == "failed"
    drift = {r.k: r.status for r in contracts.drift(spark.createDataFrame([(1, 0.51), (2, 1.0), (3, 1.0)], "k int, v double"), spark.createDataFrame([(1, 0.5), (2, 2.0), (4, 1.0)], "k int, v double"), ["k"], "v", 0.02).collect()}
    assert drift == {1: "ok", 2: "drifted", 3: "new", 4: "missing"}
    assert contracts.missing_cells(df, {"k": [1, 2, 3]}).collect() == [(3,)]


def test_learners_by_name(spark):
    rows = [(i, float(i % 7), float(i % 5), 2.0 * (i % 7) - (i % 5) + 1.0, int(i % 7 > 3)) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double, c int")
    tr, te = df.filter("id % 5 <> 0"), df.filter("id % 5 = 0")
    for name in ("ols", "ridge", "lasso", "elastic_net", "knn"):
        got = learners.predicted(name, tr, te, ["a", "b"], "y", "id").collect()
        assert len(got) == 14 and max(abs(r.pred - r.y) for r in got) < (1e-9 if name == "ols" else 3.0)
    got = learners.predicted("discriminant", tr, te, ["a", "b"], "c", "id").collect()
    assert sum(r.pred == r.c for r in got) >= 12


def test_single_proxies_of_all_folds(spark):
    rows = [(i, i % 3, float(i % 7), float((i * i) % 11), 3.0 * (i % 7) + 0.01 * ((i * i) % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, fold int, a double, b double, y double")
    got = learners.cross_fit_single(df, "fold", ["b", "a"], "y").collect()
    one = {k: learners.single_proxy(df, ["a", "b"], "y", df.fold != k).first() for k in (0, 1, 2)}
    assert len(got) == 60 and all(abs(r.pred - (one[r.fold].intercept + one[r.fold].slope * r[one[r.fold].feature])) < 1e-9 for r in got)
