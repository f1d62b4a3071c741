"""Learners against baselines on the same folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.draws import draw_sql, fold_of
from plumbline.operators import baselines, folds, learners, metrics, perceptron
from plumbline.plans.sql import ridge_sql
from plumbline.plans.tables import CUSTOMERS, POINTS, customers, points, registered, rounded, table

_LINES = f"""lines AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST({draw_sql('l_orderkey', 1)} % 5 AS INTEGER) AS fold, CAST(l_quantity AS DOUBLE) / 10 AS q,
  CAST(l_discount AS DOUBLE) * 10 AS d, CAST(l_tax AS DOUBLE) * 10 AS t, CAST(l_extendedprice AS DOUBLE) / 10000 AS y FROM lineitem)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with folds by order, so that lines of one order stay together."""
    c = lambda n: F.col(n).cast("double")
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), fold_of(F.col("l_orderkey"), 5, 1).alias("fold"), (c("l_quantity") / 10).alias("q"), (c("l_discount") * 10).alias("d"), (c("l_tax") * 10).alias("t"), (c("l_extendedprice") / 10000).alias("y"))


@registered(f"WITH {_LINES} SELECT round(regr_slope(y, q), 6) + 0 AS slope, round(regr_intercept(y, q), 6) + 0 AS intercept FROM lines")
def l2_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    beta, a = learners.fit_linear(lines(spark, sf_dir), ["q"], "y")
    return rounded(spark.createDataFrame([(float(beta[0]), float(a))], "slope double, intercept double"))


_RIDGE = f"""WITH {_LINES}, s AS (
  SELECT k.fold, count(*) AS n, avg(q) AS mq, avg(d) AS md, avg(y) AS my, avg(q * q) AS qq, avg(d * d) AS dd, avg(q * d) AS qd, avg(q * y) AS qy,
  avg(d * y) AS dy
  FROM lines l JOIN (SELECT DISTINCT fold FROM lines) k ON l.fold <> k.fold GROUP BY 1),
c AS (SELECT *, sqrt(qq - mq * mq) + 1e-8 AS sq, sqrt(dd - md * md) + 1e-8 AS sd FROM s),
m AS (SELECT *, (qq - mq * mq) / (sq * sq) * n + 1 AS a11, (dd - md * md) / (sd * sd) * n + 1 AS a22, (qd - mq * md) / (sq * sd) * n AS a12,
  (qy - mq * my) / sq * n AS b1, (dy - md * my) / sd * n AS b2 FROM c),
w AS (SELECT fold, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) / sq AS wq, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) / sd AS wd, my, mq, md
  FROM m),
p AS (SELECT l.fold, y, my + wq * (q - mq) + wd * (d - md) AS pred FROM lines l JOIN w USING (fold))"""


@registered(f"{_RIDGE} SELECT fold, count(*) AS n, round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) + 0 AS r2, round(sqrt(avg((y - pred) * (y - pred))), 6) + 0 AS rmse FROM p GROUP BY 1")
def l1_ridge_cross_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = learners.cross_fit_linear(lines(spark, sf_dir), "fold", ["q", "d"], "y", alpha=1.0)
    return rounded(p.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), metrics.r2("y", "pred").alias("r2"), metrics.rmse("y", "pred").alias("rmse")))


@registered()
def l3_elastic_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, rows = lines(spark, sf_dir), []
    for name, ratio in (("lasso", 1.0), ("elastic net", 0.5)):
        beta, a = learners.fit_linear(df, ["q", "d", "t"], "y", alpha=0.001, l1_ratio=ratio)
        rows += [(name, f, float(b)) for f, b in zip(["q", "d", "t"], beta)] + [(name, "intercept", float(a))]
    return rounded(spark.createDataFrame(rows, "model string, term string, value double"))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf_dir).withColumn("fold", fold_of(F.col("vec_id"), 5, 7))
    return p.filter("fold <> 0"), p.filter("fold = 0")


def _scored(pred: DataFrame, model: str, y: str) -> DataFrame:
    return pred.agg(F.lit(model).alias("model"), F.count(F.lit(1)).alias("n"), metrics.r2(y, "pred").alias("r2"), metrics.rmse(y, "pred").alias("rmse"))


@registered()
def l6_tree_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr, te = _split(spark, sf_dir)
    out = []
    for name, make in (("forest", learners.forest), ("boosting", learners.boosting)):
        out.append(_scored(learners.fit_predict(make(), tr, te, ["lon", "lat", "x1", "x2"], "y"), name, "y"))
    return rounded(out[0].unionByName(out[1]), 4)


@registered()
def l4_classifier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr, te = _split(spark, sf_dir)
    tr, f, out = learners.balance_weights(tr, "hit"), ["lon", "lat", "x1", "x2"], []
    panel = {"logistic": learners.logistic(0.01, "weight"), "forest": learners.forest_classifier(), "boosting": learners.boosting_classifier(), "perceptron": learners.perceptron([4, 8, 2])}
    for name, m in panel.items():
        out.append(metrics.auc(learners.fit_predict(m, tr, te, f, "hit"), [], "hit", "pred").withColumn("model", F.lit(name)))
    total = out[0]
    for o in out[1:]:
        total = total.unionByName(o)
    return rounded(total, 4)


@registered()
def l11_perceptron_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 of a neural network beside ridge on a formula index (log terms of quantity, price and discount), every fold fitted on all others."""
    f = ["q", "y", "d"]
    df = lines(spark, sf_dir).select("fold", *(F.col(c).alias(f"x{i}") for i, c in enumerate(f)), (F.log("q") + F.log("y") + F.log(1 - F.col("d") / 10)).alias("y"))
    f = ["x0", "x1", "x2"]
    both = perceptron.cross_fit_perceptron(learners.cross_fit_linear(df, "fold", f, "y", 1.0, name="ridge"), "fold", f, "y", (16,), 60, 0.05)
    return rounded(both.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), metrics.r2("y", "pred").alias("r2"), metrics.r2("y", "ridge").alias("ridge_r2")), 4)


@registered()
def l5_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr, te = _split(spark, sf_dir)
    scored = learners.lda_scores(te, ["lon", "lat", "x1", "x2"], learners.fit_lda(tr, ["lon", "lat", "x1", "x2"], "label"))
    return rounded(scored.agg(F.count(F.lit(1)).alias("n"), metrics.accuracy("label", "pred").alias("accuracy")), 4)


@registered(f"""WITH {POINTS}, f AS (SELECT *, {draw_sql('vec_id', 7)} % 5 AS fold FROM points), d AS (SELECT a.vec_id AS test_key, b.y,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2), b.vec_id) AS r FROM f a
  JOIN f b ON a.fold <> b.fold)
SELECT test_key, round(avg(y), 6) + 0 AS pred FROM d WHERE r <= 8 GROUP BY 1""")
def l10_knn_learner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's neighbours outside its fold, found in one search."""
    p = points(spark, sf_dir).withColumn("fold", fold_of(F.col("vec_id"), 5, 7))
    return rounded(learners.knn_features(p, p, ["x1", "x2"], "y", "vec_id", apart="fold"))


@registered(f"""WITH {CUSTOMERS}, f AS (SELECT *, CAST({draw_sql('o_orderkey', 8)} % 5 AS INTEGER) = 0 AS is_test, y / 100000 AS v FROM customers),
m AS (SELECT unit, avg(v) AS m FROM f WHERE NOT is_test GROUP BY 1), o AS (SELECT avg(v) AS o FROM f WHERE NOT is_test)
SELECT region, count(*) AS n, round(avg(CAST(m IS NOT NULL AS INTEGER)), 6) + 0 AS seen_share, round(sqrt(avg((v - coalesce(m, o)) * (v - coalesce(m,
  o)))), 6) + 0 AS rmse FROM f LEFT JOIN m USING (unit), o WHERE is_test GROUP BY 1""")
def b8_same_unit_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir).withColumns({"is_test": fold_of(F.col("o_orderkey"), 5, 8) == 0, "v": F.col("y") / 100000})
    p = baselines.group_mean(c.filter("not is_test"), c.filter("is_test"), ["unit"], "v")
    return rounded(p.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("seen").cast("double")).alias("seen_share"), metrics.rmse("v", "pred").alias("rmse")))


_REGION = lambda g: f"""SELECT '{g}' AS groups, round(sqrt(avg((v - pred) * (v - pred))), 6) + 0 AS rmse FROM f JOIN (  -- noqa
  SELECT c.fold, c.{g}, coalesce((g.s - c.s) / nullif(g.n - c.n, 0), (t.s - p.s) / nullif(t.n - p.n, 0)) AS pred
  FROM (SELECT fold, {g}, sum(v) AS s, count(v) AS n FROM f GROUP BY 1, 2) c JOIN (SELECT {g}, sum(v) AS s, count(v) AS n FROM f
  GROUP BY 1) g USING ({g})
  JOIN (SELECT fold, sum(v) AS s, count(v) AS n FROM f GROUP BY 1) p USING (fold), (SELECT sum(v) AS s, count(v) AS n FROM f) t) USING (fold, {g})"""  # noqa: E731


@registered(f"WITH {CUSTOMERS}, f AS (SELECT *, CAST({draw_sql('o_orderkey', 8)} % 5 AS INTEGER) AS fold, y / 100000 AS v FROM customers) {_REGION('nation')} UNION ALL {_REGION('region')}".replace("  -- noqa", ""))
def b7_group_granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir).select("nation", "region", fold_of(F.col("o_orderkey"), 5, 8).alias("fold"), (F.col("y") / 100000).alias("v"))
    one = [baselines.fold_group_mean(c, "fold", [g], "v").agg(F.lit(g).alias("groups"), metrics.rmse("v", "pred").alias("rmse")) for g in ("nation", "region")]
    return rounded(one[0].unionByName(one[1]))


@registered(f"""WITH {CUSTOMERS}, f AS (SELECT region AS fold, o_orderstatus AS g, y / 100000 AS v FROM customers), c AS (SELECT fold, g, sum(v) AS s, count(*) AS n
  FROM f GROUP BY 1, 2), t AS (SELECT g, sum(s) AS s, sum(n) AS n FROM c GROUP BY 1),
m AS (SELECT c.fold, c.g, (t.s - c.s) / (t.n - c.n) AS pred FROM c JOIN t USING (g))
SELECT fold, count(*) AS n, round(1 - sum((v - pred) * (v - pred)) / (var_pop(v) * count(*)), 6) + 0 AS r2 FROM f JOIN m USING (fold, g) GROUP BY 1""")
def f5_leave_region_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir).select(F.col("region").alias("fold"), F.col("o_orderstatus").alias("g"), (F.col("y") / 100000).alias("v"))
    s = baselines.fold_group_mean(c, "fold", ["g"], "v")
    return rounded(s.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), metrics.r2("v", "pred").alias("r2")))


@registered(f"""WITH RECURSIVE {CUSTOMERS}, s AS (SELECT nation, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, nation) AS i FROM customers GROUP BY 1),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load, 0 AS fold UNION ALL
  SELECT s.i, list_transform(load, lambda x, j: CASE WHEN j = list_position(load, list_min(load)) THEN x + n ELSE x END), CAST(list_position(load,
  list_min(load)) - 1 AS INTEGER) FROM g JOIN s ON s.i = g.i + 1)
SELECT fold, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_groups FROM g JOIN s USING (i) GROUP BY 1""")
def f12_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    f = folds.group_folds(c, "nation", 5)
    return c.join(f, "nation").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("nation").alias("n_groups"))


@registered(f"""WITH {_LINES}, tr AS (SELECT * FROM lines WHERE fold <> 0), a AS (
  SELECT 'q' AS feature, regr_slope(y, q) AS slope, regr_intercept(y, q) AS intercept, corr(y, q) ** 2 AS r FROM tr
  UNION ALL SELECT 'd', regr_slope(y, d), regr_intercept(y, d), corr(y, d) ** 2 FROM tr
  UNION ALL SELECT 't', regr_slope(y, t), regr_intercept(y, t), corr(y, t) ** 2 FROM tr)
SELECT feature, round(slope, 6) + 0 AS slope, round(intercept, 6) + 0 AS intercept, round(r, 6) + 0 AS train_r2 FROM a ORDER BY r DESC, feature LIMIT 1""")
def b11_single_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learners.single_proxy(lines(spark, sf_dir), ["q", "d", "t"], "y", F.col("fold") != 0))


_INDEX = f"""ix AS (SELECT CAST({draw_sql('l_orderkey', 1)} % 5 AS INTEGER) AS fold, ln(CAST(l_quantity AS DOUBLE)) AS lq,
  ln(CAST(l_extendedprice AS DOUBLE)) AS lp, ln(1 - CAST(l_discount AS DOUBLE)) AS ld FROM lineitem),
v AS (SELECT *, lq + lp + ld AS y FROM ix), x AS (SELECT k.fold, lq, lp, ld, y FROM v JOIN (SELECT DISTINCT fold FROM v) k ON v.fold <> k.fold)"""


def _left_out_sql(gone: str | None) -> str:
    f = [c for c in ("lq", "lp", "ld") if c != gone]
    pred = "my + " + " + ".join(f"w{i} * ({c} - m{i})" for i, c in enumerate(f))
    return f"""SELECT * FROM (WITH {_INDEX}, {ridge_sql('w', 'x', 'fold', f, 'y', 0.0, False)}, p AS (SELECT y, {pred} AS pred FROM v JOIN w USING (fold))
SELECT '{gone or 'none'}' AS left_out, round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) + 0 AS r2 FROM p)"""


@registered(" UNION ALL ".join(map(_left_out_sql, (None, "lq", "lp", "ld"))))
def q18_leave_one_component_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a formula index each component carries: OLS on log terms, whole and without each one."""
    raw = table(spark, sf_dir, "lineitem")
    d = lambda c: F.col(c).cast("double")
    idx = raw.select(fold_of(F.col("l_orderkey"), 5, 1).alias("fold"), F.log(d("l_quantity")).alias("lq"), F.log(d("l_extendedprice")).alias("lp"), F.log(1 - d("l_discount")).alias("ld"), (F.log(d("l_quantity")) + F.log(d("l_extendedprice")) + F.log(1 - d("l_discount"))).alias("y"))
    parts, out = ["lq", "lp", "ld"], []
    for gone in [None, *parts]:
        p = learners.cross_fit_linear(idx, "fold", [x for x in parts if x != gone], "y", alpha=0.0, standardise=False)
        out.append(p.agg(F.lit(gone or "none").alias("left_out"), metrics.r2("y", "pred").alias("r2")))
    total = out[0]
    for o in out[1:]:
        total = total.unionByName(o)
    return rounded(total)
