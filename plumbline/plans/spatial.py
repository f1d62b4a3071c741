"""Spatial axis: neighbours, blocks, gaps between random and spatial validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.draws import draw, draw_sql, fold_of
from plumbline.functions.skill import recovery_pct
from plumbline.operators import baselines, folds, metrics, spatial, summary
from plumbline.plans.tables import POINTS, points, registered, rounded, table

#: Points with a random fold; fold 0 is the test side of the neighbour queries.
FOLDED = f"{POINTS}, f AS (SELECT *, CAST({draw_sql('vec_id', 7)} % 5 AS INTEGER) AS fold FROM points)"
_XYZ = "cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y3, sin(radians(lat)) AS z"
NEAR = f"""{FOLDED}, g AS (SELECT *, {_XYZ} FROM f),
d AS (
  SELECT te.vec_id AS test_key, tr.vec_id AS train_key, te.y AS truth, te.hit AS truth_hit, tr.y AS value, CAST(tr.hit AS DOUBLE) AS value_hit,
         sqrt((te.x - tr.x) * (te.x - tr.x) + (te.y3 - tr.y3) * (te.y3 - tr.y3) + (te.z - tr.z) * (te.z - tr.z)) AS dist
  FROM g te JOIN g tr ON te.fold = 0 AND tr.fold <> 0
), r AS (SELECT *, row_number() OVER (PARTITION BY test_key ORDER BY dist, train_key) AS rn FROM d)"""


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumn("fold", fold_of(F.col("vec_id"), 5, 7))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _folded(spark, sf_dir)
    return p.filter("fold = 0"), p.filter("fold <> 0")


def _near(spark: SparkSession, sf_dir: str, k: int, value: str = "y") -> DataFrame:
    te, tr = _sides(spark, sf_dir)
    return spatial.knn_join(te, tr, k, "vec_id", value)


@registered(f"WITH {NEAR} SELECT test_key, train_key, CAST(rn AS INTEGER) AS rn, round(dist, 6) + 0 AS dist FROM r WHERE rn <= 3")
def j5_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_near(spark, sf_dir, 3).select("test_key", "train_key", "rn", "dist"))


@registered(f"WITH {NEAR} SELECT test_key, round(value, 6) + 0 AS pred FROM r WHERE rn = 1")
def b2_nearest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.idw(_near(spark, sf_dir, 1), ks=(1,)).select("test_key", "pred"))


@registered(f"WITH {NEAR} SELECT test_key, round(sum(value / greatest(dist, 1e-6)) / sum(1 / greatest(dist, 1e-6)), 6) + 0 AS pred FROM r WHERE rn <= 8 GROUP BY 1")
def b3_idw8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.idw(_near(spark, sf_dir, 8)).select("test_key", "pred"))


@registered(f"WITH {NEAR} SELECT test_key, round(sum(value / greatest(dist, 1e-6)) / sum(1 / greatest(dist, 1e-6)), 6) + 0 AS pred FROM r WHERE rn <= 8 GROUP BY 1")
def b3_idw8_on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As b3_idw8, by the way that large tables take."""
    te, tr = _sides(spark, sf_dir)
    return rounded(spatial.idw(spatial.knn_join(te, tr, 8, "vec_id", "y", small=False)).select("test_key", "pred"))


@registered(f"WITH {NEAR} SELECT test_key, round(sum(value / greatest(dist * 6371.0, 1e-4)) / sum(1 / greatest(dist * 6371.0, 1e-4)), 6) + 0 AS pred FROM r WHERE rn <= 8 GROUP BY 1")
def b4_idw_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.idw(_near(spark, sf_dir, 8), floor=1e-4, scale=6371.0).select("test_key", "pred"))


@registered(f"""WITH {NEAR}, p AS (
  SELECT test_key, any_value(truth_hit) AS hit, sum(value_hit / greatest(dist, 1e-6)) / sum(1 / greatest(dist, 1e-6)) AS pred FROM r WHERE rn <= 8
  GROUP BY 1
), q AS (SELECT hit, round(pred, 9) AS pred FROM p)
SELECT count(*) FILTER (hit = 1) AS n_pos, count(*) FILTER (hit = 0) AS n_neg,
       round((SELECT sum(CASE WHEN a.pred > b.pred THEN 1.0 WHEN a.pred = b.pred THEN 0.5 ELSE 0.0 END) FROM q a, q b WHERE a.hit = 1 AND b.hit = 0)
             / (count(*) FILTER (hit = 1) * count(*) FILTER (hit = 0)), 6) + 0 AS auc
FROM q""")
def b5_idw_freq_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    te, _ = _sides(spark, sf_dir)
    pred = spatial.idw(_near(spark, sf_dir, 8, "hit")).withColumn("pred", F.round("pred", 9))
    return rounded(metrics.auc(te.join(pred, te.vec_id == pred.test_key), [], "hit", "pred"))


@registered(f"""WITH {NEAR}, k AS (SELECT unnest([1, 4, 8, 16]) AS k), p AS (
  SELECT k, test_key, any_value(truth) AS y, sum(value / greatest(dist, 1e-6)) / sum(1 / greatest(dist, 1e-6)) AS pred FROM r JOIN k ON rn <= k
  GROUP BY 1, 2)
SELECT k, count(*) AS n, round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) + 0 AS r2, round(sqrt(avg((y - pred) * (y - pred))),
  6) + 0 AS rmse FROM p GROUP BY k""")
def b6_k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    te, _ = _sides(spark, sf_dir)
    pred = spatial.idw(_near(spark, sf_dir, 16), ks=(1, 4, 8, 16))
    both = te.join(pred, te.vec_id == pred.test_key)
    return rounded(both.groupBy("k").agg(F.count(F.lit(1)).alias("n"), metrics.r2("y", "pred").alias("r2"), metrics.rmse("y", "pred").alias("rmse")))


_BLOCK = lambda deg: f"concat(CAST(CAST(floor(lon / CAST({deg} AS DOUBLE)) AS BIGINT) AS VARCHAR), '_', CAST(CAST(floor(lat / CAST({deg} AS DOUBLE)) AS BIGINT) AS VARCHAR))"


@registered(f"WITH {POINTS} SELECT {_BLOCK(20)} AS fold, count(*) AS n_test FROM points GROUP BY 1")
def f1_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.eligible_folds(folds.with_block(points(spark, sf_dir), "lon", "lat", 20), []).select("fold", "n_test")


_BLOCK_SCORE = f"""WITH {POINTS}, b AS (SELECT *, {_BLOCK(20)} AS fold FROM points),
c AS (SELECT fold, label, sum(y) AS s, count(y) AS n FROM b GROUP BY 1, 2), g AS (SELECT label, sum(s) AS s, sum(n) AS n FROM c GROUP BY 1),
p AS (SELECT fold, sum(s) AS s, sum(n) AS n FROM c GROUP BY 1), t AS (SELECT sum(s) AS s, sum(n) AS n FROM c),
m AS (SELECT c.fold, c.label, coalesce((g.s - c.s) / nullif(g.n - c.n, 0), (t.s - p.s) / nullif(t.n - p.n, 0)) AS pred
      FROM c JOIN g USING (label) JOIN p USING (fold), t)"""


@registered(f"""{_BLOCK_SCORE}
SELECT fold, count(*) AS n_test, round(CASE WHEN count(*) >= 3 AND var_pop(y) > 0 THEN 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) END,
  6) + 0 AS r2
FROM b JOIN m USING (fold, label) GROUP BY fold HAVING count(*) >= 10""")
def f2_block_group_mean_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = folds.with_block(points(spark, sf_dir), "lon", "lat", 20)
    scored = baselines.fold_group_mean(b, "fold", ["label"], "y")
    return rounded(scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), metrics.r2("y", "pred", 3).alias("r2")).filter("n_test >= 10"))


@registered(f"WITH {POINTS} SELECT {_BLOCK(20)} AS fold, count(*) AS n_test, CAST(sum(hit) AS BIGINT) AS n_pos FROM points GROUP BY 1 HAVING count(*) >= 8 AND sum(hit) >= 3 AND count(*) - sum(hit) >= 3")
def f3_positive_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.eligible_folds(folds.with_block(points(spark, sf_dir), "lon", "lat", 20), [], least=8, label="hit", least_pos=3, least_neg=3)


@registered(f"WITH {POINTS}, c AS (SELECT {_BLOCK(20)} AS fold, count(*) AS n_test FROM points GROUP BY 1) SELECT fold, n_test FROM (SELECT *, row_number() OVER (ORDER BY n_test DESC, fold) AS r FROM c) WHERE r <= 6")
def f4_largest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.eligible_folds(folds.with_block(points(spark, sf_dir), "lon", "lat", 20), [], cap=6).select("fold", "n_test")


_SWEEP = f"WITH {POINTS}, s AS (SELECT points.*, block_deg FROM points, (SELECT unnest([1.0, 5.0, 10.0, 20.0, 45.0])::DOUBLE AS block_deg)), b AS (SELECT block_deg, {_BLOCK('block_deg')} AS fold, y FROM s), c AS (SELECT block_deg, fold, count(*) AS n, avg(y) AS m FROM b GROUP BY 1, 2)"


@registered(f"{_SWEEP} SELECT block_deg, count(*) AS n_folds, CAST(sum(n) AS BIGINT) AS pooled_n, round(median(m), 6) + 0 AS median, round(sum(m * n) / sum(n), 6) + 0 AS weighted_mean FROM c WHERE n >= 5 AND block_deg > 1 GROUP BY 1")
def f17_block_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = folds.block_sweep(points(spark, sf_dir), "lon", "lat", [5.0, 10.0, 20.0, 45.0])
    per = b.groupBy("block_deg", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m")).filter("n >= 5")
    return rounded(summary.fold_summary(per, ["block_deg"], "m", "n"))


@registered(f"{_SWEEP}, k AS (SELECT block_deg, count(*) AS n FROM c WHERE n >= 5 GROUP BY 1) SELECT block_deg, coalesce(n, 0) AS n_folds, CASE WHEN coalesce(n, 0) >= 5 THEN 'used' ELSE 'too few folds' END AS status FROM (SELECT unnest([1.0, 5.0, 10.0, 20.0, 45.0])::DOUBLE AS block_deg) LEFT JOIN k USING (block_deg)")
def f18_screened_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.screened_scales(points(spark, sf_dir), "lon", "lat", [1.0, 5.0, 10.0, 20.0, 45.0], 5)


_MECH = f"""{NEAR}, m AS (
  SELECT test_key, any_value(truth) AS y, min(2 * 6371.0 * asin(least(1.0, dist / 2))) AS nearest_km,
  count(*) FILTER (dist <= 2 * sin(2000 / (2 * 6371.0))) AS n_within,
         sum(CASE WHEN rn <= 8 THEN value / greatest(dist, 1e-6) END) / sum(CASE WHEN rn <= 8 THEN 1 / greatest(dist, 1e-6) END) AS pred
  FROM r GROUP BY 1), e AS (SELECT *, abs(y - pred) AS err FROM m)"""


@registered(f"WITH {_MECH} SELECT test_key, round(nearest_km, 4) + 0 AS nearest_km, n_within FROM m")
def m14_nearest_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    te, tr = _sides(spark, sf_dir)
    return rounded(spatial.nearest_and_density(te, tr, 2000, "vec_id"), 4)


def _mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    te, tr = _sides(spark, sf_dir)
    pred = spatial.idw(spatial.knn_join(te, tr, 8, "vec_id", "y")).select("test_key", "pred")
    near = spatial.nearest_and_density(te, tr, 2000, "vec_id")
    return near.join(pred, "test_key").join(te.select(F.col("vec_id").alias("test_key"), "y"), "test_key").withColumn("err", F.abs(F.col("y") - F.col("pred")))


@registered(f"""WITH {_MECH}, q AS (SELECT list_distinct(quantile_cont(nearest_km, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS ed FROM e),
b AS (SELECT e.*, least(len(list_filter(ed, lambda v: v <= nearest_km)), greatest(len(ed) - 1, 1)) AS bin FROM e, q)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(nearest_km), 4) + 0 AS mean_km, round(avg(err), 6) + 0 AS mean_error FROM b GROUP BY 1
  HAVING count(*) >= 5""")
def w10_distance_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spatial.quantile_bins(_mechanism(spark, sf_dir), "nearest_km")
    out = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("nearest_km"), 4).alias("mean_km"), F.avg("err").alias("mean_error"))
    return rounded(out.filter("n >= 5"))


@registered(f"""WITH {_MECH}, k AS (
  SELECT rank() OVER (ORDER BY n_within) + (count(*) OVER (PARTITION BY n_within) - 1) / 2.0 AS ra,
  rank() OVER (ORDER BY err) + (count(*) OVER (PARTITION BY err) - 1) / 2.0 AS rb FROM e)
SELECT count(*) AS n, round(corr(ra, rb), 6) + 0 AS rho FROM k""")
def m15_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.spearman(_mechanism(spark, sf_dir), [], "n_within", "err"))


_GAP = f"""{FOLDED}, u AS (
  SELECT 'random' AS regime, CAST(fold AS VARCHAR) AS fold, y, label FROM f UNION ALL SELECT 'spatial', {_BLOCK(45)}, y, label FROM f
), c AS (SELECT regime, fold, label, sum(y) AS s, count(y) AS n FROM u GROUP BY ALL), g AS (SELECT regime, label, sum(s) AS s, sum(n) AS n FROM c
  GROUP BY ALL),
p AS (SELECT regime, fold, sum(s) AS s, sum(n) AS n FROM c GROUP BY ALL), t AS (SELECT regime, sum(s) AS s, sum(n) AS n FROM c GROUP BY ALL),
m AS (SELECT c.regime, c.fold, c.label, coalesce((g.s - c.s) / nullif(g.n - c.n, 0), (t.s - p.s) / nullif(t.n - p.n, 0)) AS pred
      FROM c JOIN g USING (regime, label) JOIN p USING (regime, fold) JOIN t USING (regime)),
w AS (SELECT regime, fold, count(*) AS n, 1 - sum((y - pred) * (y - pred)) / nullif(var_pop(y) * count(*), 0) AS r2 FROM u
  JOIN m USING (regime, fold, label) GROUP BY ALL HAVING count(*) >= 10)"""


def _regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold scores of the class-mean baseline under random and spatial folds."""
    p = _folded(spark, sf_dir).withColumn("fold", F.col("fold").cast("string"))
    out = []
    for regime, rows in (("random", p), ("spatial", folds.with_block(p.drop("fold"), "lon", "lat", 45))):
        s = baselines.fold_group_mean(rows, "fold", ["label"], "y")
        out.append(s.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), metrics.r2("y", "pred").alias("r2")).filter("n >= 10").withColumn("regime", F.lit(regime)))
    return out[0].unionByName(out[1])


@registered(f"WITH {_GAP} SELECT round(median(r2) FILTER (regime = 'random'), 6) + 0 AS random_median, round(median(r2) FILTER (regime = 'spatial'), 6) + 0 AS spatial_median, round(median(r2) FILTER (regime = 'random') - median(r2) FILTER (regime = 'spatial'), 6) + 0 AS gap FROM w")
def m10_regime_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.regime_gap(_regimes(spark, sf_dir), [], "regime", "r2"))


@registered(f"WITH {_GAP} SELECT regime, count(r2) AS n_folds, CAST(sum(n) AS BIGINT) AS pooled_n, round(median(r2), 6) + 0 AS median, round(sum(r2 * n) / sum(n), 6) + 0 AS weighted_mean FROM w GROUP BY 1")
def a1_fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.fold_summary(_regimes(spark, sf_dir), ["regime"], "r2", "n"))


@registered(f"WITH {_GAP} SELECT regime, round(avg(CAST(r2 < 0 AS INTEGER)), 6) + 0 AS share_negative, round(min(r2), 6) + 0 AS least, round(max(r2), 6) + 0 AS most, bool_and(r2 > 0) AS all_positive FROM w GROUP BY 1")
def a11_range_and_negative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _regimes(spark, sf_dir)
    flags = summary.range_flags(s, ["regime"], "r2").drop("n")
    return rounded(s.groupBy("regime").agg(metrics.share_below("r2").alias("share_negative")).join(flags, "regime"))


_MODELS = f"""{NEAR}, p AS (
  SELECT test_key, any_value(truth) AS y, CAST({draw_sql('test_key', 3)} % 6 AS INTEGER) AS fold,
         sum(CASE WHEN rn <= 8 THEN value / greatest(dist, 1e-6) END) / sum(CASE WHEN rn <= 8 THEN 1 / greatest(dist, 1e-6) END) AS idw8,
  max(CASE WHEN rn = 1 THEN value END) AS nn1
  FROM r GROUP BY 1), s AS (
  SELECT fold, count(*) AS n, sqrt(avg((y - idw8) * (y - idw8))) AS idw8, sqrt(avg((y - nn1) * (y - nn1))) AS nn1 FROM p GROUP BY 1)"""


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE of two baselines on the same folds of the test points."""
    te, _ = _sides(spark, sf_dir)
    pred = spatial.idw(_near(spark, sf_dir, 8), ks=(1, 8)).join(te.select(F.col("vec_id").alias("test_key"), "y"), "test_key")
    model = F.when(F.col("k") == 1, "nn1").otherwise("idw8").alias("model")
    return pred.groupBy(fold_of(F.col("test_key"), 6, 3).alias("fold"), model).agg(F.count(F.lit(1)).alias("n"), metrics.rmse("y", "pred").alias("rmse"))


@registered(f"WITH {_MODELS} SELECT fold, round(idw8, 6) + 0 AS idw8, round(nn1, 6) + 0 AS nn1 FROM s")
def a8_pivot_fold_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.pivot_models(_models(spark, sf_dir), ["fold"], "model", ["idw8", "nn1"], "rmse"))


@registered(f"WITH {_MODELS} SELECT count(*) AS n, round(median(nn1 - idw8), 6) + 0 AS median_of_differences, round(median(nn1) - median(idw8), 6) + 0 AS difference_of_medians FROM s")
def a_paired_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = summary.pivot_models(_models(spark, sf_dir), ["fold"], "model", ["idw8", "nn1"], "rmse")
    return rounded(summary.paired_medians(wide, [], "nn1", "idw8"))


@registered(f"WITH {_MODELS}, l AS (SELECT fold, 'idw8' AS model, idw8 AS rmse FROM s UNION ALL SELECT fold, 'nn1', nn1 FROM s) SELECT fold, model AS best, round(rmse, 6) + 0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY rmse DESC, model) AS r FROM l) WHERE r = 1")
def a9_best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.best_model(_models(spark, sf_dir), ["fold"], "model", "rmse"))


@registered(f"WITH {_MODELS} SELECT CAST(sum(CAST(idw8 <= nn1 AS INTEGER)) AS BIGINT) AS wins, count(*) AS units, round(100.0 * sum(CAST(idw8 <= nn1 AS INTEGER)) / count(*), 6) + 0 AS win_pct, round(median(1 - idw8 / nn1), 6) + 0 AS rmse_skill FROM s")
def m12_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = summary.pivot_models(_models(spark, sf_dir), ["fold"], "model", ["idw8", "nn1"], "rmse").select((-F.col("idw8")).alias("a"), (-F.col("nn1")).alias("b"), "idw8", "nn1")
    won, n, pct = metrics.wins("a", "b")
    return rounded(wide.agg(won.alias("wins"), n.alias("units"), pct.alias("win_pct"), F.median(1 - F.col("idw8") / F.col("nn1")).alias("rmse_skill")))


@registered(f"""WITH {POINTS}, d AS (SELECT *, {draw_sql('vec_id', 11)} AS d FROM points), r AS (SELECT *, row_number() OVER (ORDER BY d, vec_id) AS r,
  count(*) OVER () AS n FROM d)
SELECT is_test, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS key_sum FROM (SELECT vec_id, r > floor(n * 0.8) AS is_test FROM r) GROUP BY 1""")
def f9_permutation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.permutation_split(points(spark, sf_dir), "vec_id", 0.8, 11).groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("key_sum"))


@registered(f"""WITH {POINTS}, d AS (SELECT *, {draw_sql('vec_id', 11)} AS d FROM points), r AS (SELECT *, row_number() OVER (ORDER BY d, vec_id) - 1 AS r,
  count(*) OVER () AS n FROM d),
c AS (SELECT vec_id, CASE WHEN r < (n % 7) * (n // 7 + 1) THEN r // (n // 7 + 1) ELSE n % 7 + (r - (n % 7) * (n // 7 + 1)) // (n // 7) END AS fold
  FROM r)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS key_sum FROM c GROUP BY 1""")
def f7_chunk_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.chunk_folds(points(spark, sf_dir), "vec_id", 7, 11).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("key_sum"))


@registered(f"SELECT CAST({draw_sql('vec_id', 5)} % 10 AS INTEGER) AS fold, count(*) AS n FROM embeddings GROUP BY 1")
def f6_random_fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.random_folds(points(spark, sf_dir), "vec_id", 10, 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@registered(f"""WITH {POINTS}, r AS (SELECT label, hit, vec_id, row_number() OVER (PARTITION BY label ORDER BY {draw_sql('vec_id', 2)}, vec_id) AS r FROM points),
k AS (SELECT least(5, greatest(min(c), 1)) AS k FROM (SELECT count(*) AS c FROM points GROUP BY label))
SELECT label, CAST((r - 1) % k AS INTEGER) AS fold, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS key_sum FROM r, k GROUP BY 1, 2""")
def f11_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.stratified_folds(points(spark, sf_dir), "vec_id", "label", 5, 2).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("key_sum"))


@registered(f"WITH s AS (SELECT vec_id, seed FROM embeddings, (SELECT unnest([1, 2, 3]) AS seed)) SELECT seed, {draw_sql('vec_id', 'seed')} % 10000 < 2000 AS is_test, count(*) AS n FROM s GROUP BY 1, 2")
def f15_repeated_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.repeated_holdout(points(spark, sf_dir), "vec_id", [1, 2, 3], 0.2).groupBy("seed", "is_test").agg(F.count(F.lit(1)).alias("n"))


@registered(f"""WITH {POINTS}, c AS (SELECT hit, count(*) AS c FROM points GROUP BY 1), t AS (SELECT sum(c) AS t FROM c),
q AS (SELECT hit, CASE WHEN t <= 200 THEN c ELSE greatest(CAST(floor(c * 200.0 / t) AS BIGINT),
  CASE WHEN hit = 1 THEN least(30, c) ELSE 0 END) END AS q FROM c, t),
r AS (SELECT vec_id, hit, row_number() OVER (PARTITION BY hit ORDER BY {draw_sql('vec_id', 9)}, vec_id) AS r FROM points)
SELECT hit, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS key_sum FROM r JOIN q USING (hit) WHERE r <= q GROUP BY 1""")
def f20_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = folds.stratified_sample(points(spark, sf_dir), "vec_id", "hit", 200, 30, 9)
    return s.groupBy("hit").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("key_sum"))


@registered(f"WITH {FOLDED} SELECT count(*) AS n_overlap FROM (SELECT vec_id FROM f WHERE fold = 0 INTERSECT SELECT vec_id FROM f WHERE fold <> 0)")
def f22_train_test_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    te, tr = _sides(spark, sf_dir)
    return folds.overlap_count(tr, te, ["vec_id"])


@registered(f"WITH {_MODELS} SELECT round(100 * (1 - median(idw8)) / (1 - median(nn1)), 6) + 0 AS recovery FROM s")
def m9_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = summary.pivot_models(_models(spark, sf_dir), ["fold"], "model", ["idw8", "nn1"], "rmse")
    m = wide.agg((1 - F.median("idw8")).alias("a"), (1 - F.median("nn1")).alias("b"))
    return rounded(m.select(recovery_pct(F.col("a"), F.col("b")).alias("recovery")))
