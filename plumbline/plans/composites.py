"""Whole analyses: learners beside zero-learning baselines on the same folds, reduced to medians, gaps and recovery."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.draws import draw_sql, fold_of
from plumbline.operators import baselines, boosted, bootstrap, encode, folds, learners, logistic, metrics, panel, spatial, summary
from plumbline.plans.spatial import FOLDED
from plumbline.plans.sql import auc_sql, logistic_sql, median_interval_sql, ridge_sql
from plumbline.plans.tables import CUSTOMERS, CUTOFF, DAILY, POINTS, customers, daily, points, registered, rounded, table
from plumbline.shared import written

_BLOCK = "concat(CAST(CAST(floor(lon / CAST(45 AS DOUBLE)) AS BIGINT) AS VARCHAR), '_', CAST(CAST(floor(lat / CAST(45 AS DOUBLE)) AS BIGINT) AS VARCHAR))"


def _regimes(p: DataFrame, deg: float = 45.0, k: int = 5) -> dict[str, DataFrame]:
    """The same rows under random folds and under spatial blocks, as membership columns."""
    return {"random": p.withColumn("fold", fold_of(F.col("vec_id"), k, 7).cast("string")), "spatial": folds.with_block(p, "lon", "lat", deg)}


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _at_once(calls: list[Callable[[], DataFrame]]) -> list[DataFrame]:
    """The results in order. Fits of different folds wait for the driver most of the time, so eight run beside each other."""
    with ThreadPoolExecutor(8) as pool:
        return list(pool.map(lambda call: call(), calls))


@registered(f"""WITH {FOLDED}, u AS (SELECT 'random' AS regime, CAST(fold AS VARCHAR) AS fold, y, x1 FROM f UNION ALL SELECT 'spatial', {_BLOCK}, y, x1 FROM f),
c AS (SELECT regime, fold, count(*) AS n, sum(x1) AS sx, sum(y) AS sy, sum(x1 * x1) AS sxx, sum(x1 * y) AS sxy FROM u GROUP BY 1, 2),
t AS (SELECT regime, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM c GROUP BY 1),
d AS (SELECT c.regime, c.fold, t.n - c.n AS n, t.sx - c.sx AS sx, t.sy - c.sy AS sy, t.sxx - c.sxx AS sxx, t.sxy - c.sxy AS sxy FROM c
  JOIN t USING (regime)),
w AS (SELECT regime, fold, sx / n AS mx, sy / n AS my, sqrt(sxx / n - (sx / n) * (sx / n)) + 1e-8 AS s, sxx / n - (sx / n) * (sx / n) AS vx,
  sxy / n - (sx / n) * (sy / n) AS cxy, n FROM d),
b AS (SELECT regime, fold, mx, my, (cxy / s * n) / (vx / (s * s) * n + 1) / s AS beta FROM w),
k AS (SELECT regime, fold, count(*) AS n, 1 - sum((y - (my + beta * (x1 - mx))) * (y - (my + beta * (x1 - mx)))) / nullif(var_pop(y) * count(*),
  0) AS ridge, 1 - sum((y - my) * (y - my)) / nullif(var_pop(y) * count(*), 0) AS mean FROM u JOIN b USING (regime, fold) GROUP BY 1, 2
  HAVING count(*) >= 10)
SELECT regime, count(*) AS n_folds, round(median(ridge), 6) + 0 AS ridge, round(median(mean), 6) + 0 AS mean, round(median(ridge - mean),
  6) + 0 AS paired_increment, round(median(ridge) - median(mean), 6) + 0 AS increment FROM k GROUP BY 1""")
def q2_spatial_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ridge learner and the training mean under random and spatial folds."""
    out = []
    for regime, p in _regimes(points(spark, sf_dir)).items():
        s = baselines.fold_group_mean(learners.cross_fit_linear(p, "fold", ["x1"], "y", 1.0, name="ridge_p").withColumn("all", F.lit(1)), "fold", ["all"], "y")
        k = s.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), metrics.r2("y", "ridge_p").alias("ridge"), metrics.r2("y", "pred").alias("mean")).filter("n >= 10")
        out.append(k.agg(F.lit(regime).alias("regime"), F.count(F.lit(1)).alias("n_folds"), F.median("ridge").alias("ridge"), F.median("mean").alias("mean"), F.median(F.col("ridge") - F.col("mean")).alias("paired_increment"), (F.median("ridge") - F.median("mean")).alias("increment")))
    return rounded(_stack(out))


_EXCEED = f"""WITH {POINTS}, b AS MATERIALIZED (SELECT vec_id, 1 AS k, hit, lon, lat, x1, x2, {_BLOCK} AS fold FROM points),
ok AS (SELECT fold FROM b GROUP BY 1 HAVING count(*) >= 20 AND sum(hit) >= 5 AND count(*) - sum(hit) >= 5),
{logistic_sql('w', 'b', 'k', ['lon', 'lat', 'x1', 'x2'], 'hit', 0.01)},
g AS MATERIALIZED (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y3, sin(radians(lat)) AS z FROM b),
d AS (SELECT te.vec_id, tr.hit, tr.vec_id AS train_key,
  sqrt((te.x - tr.x) * (te.x - tr.x) + (te.y3 - tr.y3) * (te.y3 - tr.y3) + (te.z - tr.z) * (te.z - tr.z)) AS dist FROM g te JOIN g tr ON te.fold <> tr.fold),
nn AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, train_key) AS rn FROM d),
base AS (SELECT vec_id, sum(hit / greatest(dist, 1e-6)) / sum(1 / greatest(dist, 1e-6)) AS base FROM nn WHERE rn <= 8 GROUP BY 1),
s AS MATERIALIZED (SELECT fold, hit, round(pred, 9) AS m, round(base, 9) AS b FROM w JOIN base USING (vec_id) SEMI JOIN ok USING (fold)),
a AS (SELECT m.auc AS m, b.auc AS b FROM ({auc_sql('s', 'fold', 'hit', 'm')}) m JOIN ({auc_sql('s', 'fold', 'hit', 'b')}) b USING (fold)),
t AS (SELECT count(*) AS n, median(m) - 0.5 AS model_skill, median(b) - 0.5 AS baseline_skill FROM a HAVING count(*) > 0)"""


@registered(f"""{_EXCEED} SELECT n, round(model_skill, 6) + 0 AS model_skill, round(baseline_skill, 6) + 0 AS baseline_skill,
  round(model_skill - baseline_skill, 6) + 0 AS increment, round(CASE WHEN model_skill > 0 THEN 100 * greatest(0.0, baseline_skill) / model_skill END, 4) + 0 AS recovery_pct FROM t""")
def q5_exceedance_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of a logistic learner and of neighbour frequency on the same held-out blocks, with recovery. Both score every fold in one pass."""
    p = written(folds.with_block(points(spark, sf_dir), "lon", "lat", 45), "blocks")
    ok = folds.eligible_folds(p, [], least=20, label="hit", least_pos=5, least_neg=5).select("fold")
    idw = spatial.idw(spatial.knn_join(p, p, 8, "vec_id", "hit", apart="fold")).select(F.col("test_key").alias("vec_id"), F.round("pred", 9).alias("base"))
    model = logistic.cross_fit_logistic(p, "fold", ["lon", "lat", "x1", "x2"], "hit", 0.01, name="model").withColumn("model", F.round("model", 9))
    both = written(model.join(idw, "vec_id").join(ok, "fold", "left_semi"), "scored")
    m, b = (metrics.auc(both, ["fold"], "hit", c).select("fold", F.col("auc").alias(c)) for c in ("model", "base"))
    out = summary.recovery_table(m.join(b, "fold"), [], "model", "base", 0.5, floor=True).filter("n > 0")
    return rounded(out.withColumn("recovery_pct", F.round("recovery_pct", 4)))


@registered(f"""WITH {FOLDED}, s AS (SELECT f.*, block_deg FROM f, (SELECT unnest([20.0, 45.0, 90.0])::DOUBLE AS block_deg)),
b AS (SELECT block_deg, concat(CAST(CAST(floor(lon / block_deg) AS BIGINT) AS VARCHAR), '_',
  CAST(CAST(floor(lat / block_deg) AS BIGINT) AS VARCHAR)) AS fold, y FROM s),
c AS (SELECT block_deg, fold, count(*) AS n, avg(y) AS m FROM b GROUP BY 1, 2 HAVING count(*) >= 5),
{median_interval_sql('ci', 'c', 'block_deg', 'fold', ['m'], 'm0', 2)}
SELECT block_deg, n_folds, round(median, 6) + 0 AS median, round(lo, 6) + 0 AS lo, round(hi, 6) + 0 AS hi
  FROM (SELECT block_deg, count(*) AS n_folds, median(m) AS median FROM c GROUP BY 1) JOIN ci USING (block_deg)""")
def q7_scale_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block means by block size, with bootstrap intervals of the median."""
    b = folds.block_sweep(points(spark, sf_dir), "lon", "lat", [20.0, 45.0, 90.0])
    c = b.groupBy("block_deg", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m")).filter("n >= 5")
    ci = bootstrap.median_interval(c, ["block_deg"], "fold", ["m"], seed=2)
    return rounded(c.groupBy("block_deg").agg(F.count(F.lit(1)).alias("n_folds"), F.median("m").alias("median")).join(ci, "block_deg"))


@registered()
def q9_learner_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of learners under both regimes, every eligible fold; a failed fit is a row with its reason.

    Ridge, neighbours in feature space and boosting score all folds of a regime at once (boosting those of both); forests are fitted fold by fold.
    """
    f, regimes = ["lon", "lat", "x1", "x2"], _regimes(points(spark, sf_dir), 90.0, 2)
    both = written(_stack([p.withColumn("regime", F.lit(r)) for r, p in regimes.items()]), "regimes")
    ok = written(folds.eligible_folds(both, ["regime"], least=20).select("regime", "fold"), "eligible")
    schema, out = "regime string, fold string, r2 double", []

    def scored(pred: DataFrame) -> DataFrame:
        per = pred.join(ok, ["regime", "fold"], "left_semi").groupBy("regime", "fold")
        return per.agg(metrics.r2("y", "pred", 3).alias("r2")).select("regime", "fold", "r2")

    def near(p: DataFrame) -> DataFrame:
        pred = learners.knn_features(p, p, f, "y", "vec_id", 8, "fold")
        return p.join(pred.withColumnRenamed("test_key", "vec_id"), "vec_id")

    def grown(regime: str, fold: str) -> DataFrame:
        p = both.filter(F.col("regime") == regime)
        return scored(learners.fit_predict(learners.forest(), p.filter(F.col("fold") != fold), p.filter(F.col("fold") == fold), f, "y"))

    whole = {"ridge": lambda p: learners.cross_fit_linear(p, "fold", f, "y", 1.0), "neighbours": near}
    for name, fit in whole.items():
        for r in regimes:
            out.append(lambda r=r, fit=fit, name=name: learners.fit_or_status(lambda: scored(fit(both.filter(F.col("regime") == r))), spark, schema, model=name))
    for r in ok.orderBy("regime", "fold").collect():
        out.append(lambda r=r: learners.fit_or_status(lambda: grown(r.regime, r.fold), spark, schema, model="forest"))
    out.append(lambda: learners.fit_or_status(lambda: scored(boosted.cross_fit_boosting(both, "fold", f, "y", keys=("regime",))), spark, schema, model="boosting"))
    m = lambda r: F.median(F.when(F.col("regime") == r, F.col("r2")))
    rows = written(_stack(_at_once(out)), "scores").groupBy("model")
    return rounded(rows.agg(m("random").alias("random_median"), m("spatial").alias("spatial_median"), F.count_if(F.col("status") == "failed").alias("n_failed")), 4)


def _driven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel with drivers known at the cutoff row, one step ahead."""
    cut = F.lit(CUTOFF).cast("date")
    z = panel.train_zscore(daily(spark, sf_dir), "unit", "day", "value", cut)
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg((F.count_if(F.col("event_type") == "error") / 100).alias("errors"), (F.count_if(F.col("event_type") == "click") / 100).alias("clicks"))
    lagged = panel.driver_lags(z.join(e, "day", "left"), "unit", "day", ["errors", "clicks"], 1)
    ext = [c for c in lagged.columns if "_lag_" in c]
    sup = panel.supervised(z, "unit", "day", "z", 2, [1], cut)
    return sup.join(lagged.select("unit", "day", *ext), ["unit", "day"], "left").dropna(subset=ext)


_CUT = f"DATE '{CUTOFF}'"
_DRIVEN = f"""{DAILY}, st AS (SELECT unit, avg(value) FILTER (day <= {_CUT}) AS m, stddev_pop(value) FILTER (day <= {_CUT}) AS s,
  count(value) FILTER (day <= {_CUT}) AS c FROM daily GROUP BY 1),
e AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') / CAST(100 AS DOUBLE) AS errors,
  count(*) FILTER (event_type = 'click') / CAST(100 AS DOUBLE) AS clicks FROM events GROUP BY 1),
l AS (SELECT unit, day, (value - m) / s AS lag_0, lag((value - m) / s) OVER o AS lag_1, lead((value - m) / s) OVER o AS target,
  lead(day) OVER o > {_CUT} AS is_test, errors AS e0, lag(errors) OVER o AS e1, clicks AS c0, lag(clicks) OVER o AS c1
  FROM daily JOIN st USING (unit) LEFT JOIN e USING (day) WHERE c >= 5 AND s > 0 WINDOW o AS (PARTITION BY unit ORDER BY day)),
v AS (SELECT * FROM l WHERE lag_1 IS NOT NULL AND target IS NOT NULL AND e0 IS NOT NULL AND e1 IS NOT NULL AND c0 IS NOT NULL AND c1 IS NOT NULL),
  tr AS (SELECT 1 AS k, * FROM v WHERE NOT is_test)"""


def _ablation_sql(which: str, features: list[str]) -> str:
    pred = "my + " + " + ".join(f"w{i} * ({f} - m{i})" for i, f in enumerate(features))
    r2 = lambda p: f"CASE WHEN var_pop(target) > 0 THEN 1 - sum((target - {p}) * (target - {p})) / (var_pop(target) * count(*)) END"
    return f"""SELECT * FROM (WITH {_DRIVEN}, {ridge_sql('w', 'tr', 'k', features, 'target')}, p AS (SELECT unit, target, lag_0, {pred} AS pred FROM v, w
  WHERE is_test),
u AS (SELECT unit, {r2('pred')} AS model, {r2('lag_0')} AS base FROM p GROUP BY 1 HAVING count(*) >= 3)
SELECT '{which}' AS features, count(*) AS n_units, round(median(model), 6) + 0 AS model, round(median(base), 6) + 0 AS persistence,
  CAST(sum(CAST(base >= model AS INTEGER)) AS BIGINT) AS persistence_wins FROM u)"""


@registered(" UNION ALL ".join(_ablation_sql(n, f) for n, f in (("own", ["lag_0", "lag_1"]), ("drivers", ["e0", "e1", "c0", "c1"]), ("both", ["lag_0", "lag_1", "e0", "e1", "c0", "c1"]))))
def q15_driver_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own lags, drivers, or both: a ridge learner beside persistence on targets after the cutoff, per-unit medians."""
    s, drivers = _driven(spark, sf_dir), ["errors", "clicks"]
    out = []
    for which in ("own", "drivers", "both"):
        f = panel.feature_columns(s.columns, drivers, which)
        beta, a = learners.fit_linear(s.filter("not is_test"), f, "target", 1.0)
        t = s.filter("is_test").withColumn("pred", learners.linear_column(f, beta, a))
        per = t.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), metrics.r2("target", "pred", 3).alias("model"), metrics.r2("target", "lag_0", 3).alias("base")).filter("n >= 3")
        out.append(per.agg(F.lit(which).alias("features"), F.count(F.lit(1)).alias("n_units"), F.median("model").alias("model"), F.median("base").alias("persistence"), F.sum((F.col("base") >= F.col("model")).cast("long")).alias("persistence_wins")))
    return rounded(_stack(out))


@registered(f"""WITH {DAILY}, f AS (SELECT unit, day, value, CAST({draw_sql('unit', 1)} % 3 AS INTEGER) AS cell
  FROM daily) SELECT cell, count(DISTINCT unit) AS n_units, count(*) AS n_rows, min(day) AS first_day, max(day) AS last_day FROM f GROUP BY 1""")
def q13_panel_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).withColumn("cell", fold_of(F.col("unit"), 3, 1))
    return d.groupBy("cell").agg(F.count_distinct("unit").alias("n_units"), F.count(F.lit(1)).alias("n_rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


_GROUPS = f"""WITH {CUSTOMERS}, u AS (SELECT 'random' AS regime, CAST(CAST({draw_sql('o_orderkey', 4)} % 2 AS INTEGER) AS VARCHAR) AS fold, * FROM customers
  UNION ALL SELECT 'spatial', region, * FROM customers),
c AS MATERIALIZED (SELECT regime, fold, CAST(y > 250000 AS INTEGER) AS hit, CAST(unit % 97 AS DOUBLE) AS x, CAST(o_orderstatus = 'F' AS DOUBLE) AS f1,
  CAST(o_orderstatus = 'O' AS DOUBLE) AS f2 FROM u),
ok AS (SELECT regime, fold FROM c GROUP BY 1, 2 HAVING sum(hit) >= 5 AND count(*) - sum(hit) >= 5),
{logistic_sql('w', 'c', 'regime', ['x', 'f1', 'f2'], 'hit', 0.0)},
s AS MATERIALIZED (SELECT regime, fold, hit, round(pred, 9) AS p FROM w SEMI JOIN ok USING (regime, fold)), a AS ({auc_sql('s', 'regime, fold', 'hit', 'p')})"""


@registered(f"""{_GROUPS} SELECT round(median(auc) FILTER (regime = 'random'), 6) + 0 AS random_median, round(median(auc) FILTER (regime = 'spatial'), 6) + 0 AS spatial_median,
  round(median(auc) FILTER (regime = 'random') - median(auc) FILTER (regime = 'spatial'), 6) + 0 AS gap FROM a""")
def q3_group_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier under random folds and leave-one-region-out: AUC medians and the gap. Regimes and folds share every pass."""
    c = customers(spark, sf_dir)
    c = encode.one_hot(c.withColumns({"hit": (F.col("y") > 250_000).cast("int"), "x": F.col("unit") % 97}), "o_orderstatus", ["F", "O", "P"])
    regimes = {"random": fold_of(F.col("o_orderkey"), 2, 4).cast("string"), "spatial": F.col("region")}
    p = _stack([c.select(F.lit(r).alias("regime"), f.alias("fold"), "hit", "x", "o_orderstatus_F", "o_orderstatus_O") for r, f in regimes.items()])
    p = written(p, "regimes")
    ok = folds.eligible_folds(p, ["regime"], label="hit", least_pos=5, least_neg=5).select("regime", "fold")
    pred = logistic.cross_fit_logistic(p, "fold", ["x", "o_orderstatus_F", "o_orderstatus_O"], "hit", keys=("regime",))
    pred = pred.withColumn("pred", F.round("pred", 9)).join(ok, ["regime", "fold"], "left_semi")
    return rounded(summary.regime_gap(metrics.auc(pred, ["regime", "fold"], "hit", "pred"), [], "regime", "auc"))
