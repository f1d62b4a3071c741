"""Whole studies whose learner is linear, so that SQL can express them: regimes, forecast curves, drivers, memory, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.draws import draw, draw_sql, fold_of
from plumbline.functions.skill import recovery_pct
from plumbline.operators import baselines, bootstrap, folds, learners, metrics, panel, spatial, summary
from plumbline.plans.learning import lines
from plumbline.plans.sql import median_interval_sql
from plumbline.plans.tables import CUSTOMERS, DAILY, MONTHLY, POINTS, customers, daily, monthly, points, registered, rounded, table
from plumbline.shared import scratch, written


def _block_sql(deg: int) -> str:
    at = lambda c: f"CAST(CAST(floor({c} / CAST({deg} AS DOUBLE)) AS BIGINT) AS VARCHAR)"
    return f"concat({at('lon')}, '_', {at('lat')})"


def _r2_sql(y: str, p: str, least: int = 1) -> str:
    ok = f"FILTER ({y} IS NOT NULL AND {p} IS NOT NULL)"
    return (
        f"CASE WHEN count(*) {ok} >= {least} AND var_pop({y}) {ok} > 0 "
        f"THEN 1 - sum(({y} - {p}) * ({y} - {p})) {ok} / (var_pop({y}) {ok} * count(*) {ok}) END"
    )


def _cross_ridge1(rows: str, keys: str, x: str, y: str) -> str:
    """CTEs ``b``: for each (keys, fold) of ``rows`` the ridge line (alpha 1) of y on x over all other folds: mx, my, beta."""
    own = f"SELECT {keys}, fold, count(*) AS n, sum({x}) AS sx, sum({y}) AS sy, sum({x} * {x}) AS sxx, sum({x} * {y}) AS sxy FROM {rows} GROUP BY ALL"
    diff = ", ".join(f"t.{c} - c.{c} AS {c}" for c in ("n", "sx", "sy", "sxx", "sxy"))
    return f"""c AS ({own}), t AS (SELECT {keys}, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM c GROUP BY ALL),
d AS (SELECT {keys}, c.fold, {diff} FROM c JOIN t USING ({keys})),
w AS (SELECT {keys}, fold, n, sx / n AS mx, sy / n AS my, sxx / n - (sx / n) * (sx / n) AS vx, sxy / n - (sx / n) * (sy / n) AS cxy FROM d),
b AS (SELECT {keys}, fold, mx, my, (cxy / (sqrt(vx) + 1e-8) * n) / (vx / ((sqrt(vx) + 1e-8) * (sqrt(vx) + 1e-8)) * n + 1) / (sqrt(vx) + 1e-8) AS beta
  FROM w)"""


def _ridge2(name: str, rows: str, keys: str, f1: str, f2: str, y: str) -> str:
    """CTE ``name``: by keys the ridge plane (alpha 1) of y on two features: wa, wb, ma, mb, my."""
    return f"""{name}_s AS (SELECT {keys}, count(*) AS n, avg({f1}) AS ma, avg({f2}) AS mb, avg({y}) AS my, avg({f1} * {f1}) AS aa, avg({f2} * {f2}) AS bb,
  avg({f1} * {f2}) AS ab,
  avg({f1} * {y}) AS y1, avg({f2} * {y}) AS y2 FROM {rows} GROUP BY ALL),
{name}_c AS (SELECT *, sqrt(greatest(aa - ma * ma, 0)) + 1e-8 AS sa, sqrt(greatest(bb - mb * mb, 0)) + 1e-8 AS sb FROM {name}_s),
{name}_m AS (SELECT *, (aa - ma * ma) / (sa * sa) * n + 1 AS a11, (bb - mb * mb) / (sb * sb) * n + 1 AS a22, (ab - ma * mb) / (sa * sb) * n AS a12,
  (y1 - ma * my) / sa * n AS b1, (y2 - mb * my) / sb * n AS b2 FROM {name}_c),
{name} AS (SELECT {keys}, ma, mb, my, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) / sa AS wa,
  (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) / sb AS wb FROM {name}_m)"""


# Q4: one exceedance target under three ways of holding out, with the lift of rare events


@registered(f"""WITH {POINTS}, u AS (SELECT 'random' AS regime, CAST(CAST({draw_sql('vec_id', 7)} % 5 AS INTEGER) AS VARCHAR) AS fold, hit, x1 FROM points
UNION ALL SELECT 'continent', CAST(vec_id % 6 AS VARCHAR), hit, x1 FROM points UNION ALL SELECT 'block', {_block_sql(45)}, hit, x1 FROM points),
{_cross_ridge1('u', 'regime', 'x1', 'hit')}, s AS (SELECT regime, fold, hit, my + beta * (x1 - mx) AS s FROM u JOIN b USING (regime, fold)),
g AS (SELECT regime, fold, s, sum(hit) AS pos, count(*) AS c FROM s GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER down AS tp, sum(c) OVER down AS seen, sum(pos) OVER (PARTITION BY regime, fold) AS p, sum(c) OVER (PARTITION BY regime,
  fold) AS n,
  sum(c - pos) OVER (PARTITION BY regime, fold ORDER BY s) - (c - pos) AS below FROM g WINDOW down AS (PARTITION BY regime, fold ORDER BY s DESC)),
k AS (SELECT regime, fold, any_value(n) AS n, sum(pos * (below + (c - pos) / 2.0)) / (any_value(p) * (any_value(n) - any_value(p))) AS auc,
  sum(pos / p * tp / seen) / (any_value(p) / any_value(n)) AS lift FROM r WHERE p >= 5 AND n - p >= 5 GROUP BY ALL),
m AS (SELECT regime, count(*) AS n_folds, median(auc) AS a, sum(auc * n) / sum(n) AS wa, min(auc) AS la, median(lift) AS li FROM k GROUP BY 1)
SELECT regime, n_folds, round(a, 6) + 0 AS median_auc, round(wa, 6) + 0 AS weighted_auc, round(la, 6) + 0 AS min_auc, round(li,
  6) + 0 AS median_ap_lift,
  round((SELECT a FROM m WHERE regime = 'random') - a, 6) + 0 AS gap FROM m""")
def q4_exceedance_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC and lift of a linear score under random folds, left-out continents and spatial blocks, and the gaps to random folds."""
    p = points(spark, sf_dir)
    regimes = {
        "random": p.withColumn("fold", fold_of(F.col("vec_id"), 5, 7).cast("string")),
        "continent": p.withColumn("fold", (F.col("vec_id") % 6).cast("string")),
        "block": folds.with_block(p, "lon", "lat", 45),
    }
    scored = None
    for name, df in regimes.items():
        s = learners.cross_fit_linear(df, "fold", ["x1"], "hit", 1.0, name="s").select(F.lit(name).alias("regime"), "fold", "hit", "s")
        scored = s if scored is None else scored.unionByName(s)
    ok = folds.eligible_folds(scored, ["regime"], label="hit", least_pos=5, least_neg=5).select("regime", "fold")
    scored = scored.join(ok, ["regime", "fold"])
    both = metrics.auc(scored, ["regime", "fold"], "hit", "s").join(metrics.average_precision(scored, ["regime", "fold"], "hit", "s").drop("n_pos"), ["regime", "fold"])
    m = both.groupBy("regime").agg(
        F.count(F.lit(1)).alias("n_folds"), F.median("auc").alias("median_auc"), summary.weighted_mean("auc", "n").alias("weighted_auc"),
        F.min("auc").alias("min_auc"), F.median("ap_lift").alias("median_ap_lift"),
    )
    base = m.filter("regime = 'random'").select(F.col("median_auc").alias("_r"))
    return rounded(m.join(base).withColumn("gap", F.col("_r") - F.col("median_auc")).drop("_r"))  # base is one row


# Q6: several models under three regimes, beside a published prediction

_Q6 = f"""{POINTS}, p AS (SELECT *, y * CAST(0.5 AS DOUBLE) + x2 * CAST(0.5 AS DOUBLE) AS published, vec_id % 4 = 0 AS flag, {_block_sql(45)} AS block
  FROM points),
ok AS (SELECT block FROM p GROUP BY 1 HAVING count(*) >= 20), nk AS (SELECT greatest(2, count(*)) AS k FROM ok),
u AS (SELECT 'spatial_block' AS regime, block AS fold, block IN (SELECT block FROM ok) AS scored, p.* FROM p
  UNION ALL SELECT 'random_kfold', CAST({draw_sql('vec_id', 7)} % k AS VARCHAR), true, p.* FROM p, nk
  UNION ALL SELECT 'authors_holdout', CASE WHEN flag THEN 'holdout' ELSE 'train' END, flag, p.* FROM p)"""
_XYZ = "cos(radians(lat)) * cos(radians(lon)) AS gx, cos(radians(lat)) * sin(radians(lon)) AS gy, sin(radians(lat)) AS gz"


@registered(f"""WITH {_Q6}, {_cross_ridge1('u', 'regime', 'x1', 'y')},
g AS (SELECT regime, fold, scored, vec_id, y, {_XYZ} FROM u), q AS (SELECT a.regime, a.fold, a.vec_id, a.y, z.y AS v, z.vec_id AS k,
  sqrt((a.gx - z.gx) * (a.gx - z.gx) + (a.gy - z.gy) * (a.gy - z.gy) + (a.gz - z.gz) * (a.gz - z.gz)) AS dist
  FROM g a JOIN g z ON a.regime = z.regime AND a.fold <> z.fold WHERE a.scored),
nn AS (SELECT regime, fold, y, sum(v / greatest(dist, 1e-6)) / sum(1 / greatest(dist, 1e-6)) AS pred
  FROM (SELECT *, row_number() OVER (PARTITION BY regime, vec_id ORDER BY dist, k) AS rn FROM q) WHERE rn <= 8 GROUP BY regime, fold, vec_id, y),
e AS (SELECT regime, fold, 'ridge' AS model, y, my + beta * (x1 - mx) AS pred FROM u JOIN b USING (regime, fold) WHERE scored
  UNION ALL SELECT regime, fold, 'idw_k8', y, pred FROM nn
  UNION ALL SELECT regime, fold, 'published', y, published FROM u WHERE regime = 'authors_holdout' AND scored),
k AS (SELECT regime, model, fold, count(*) AS n, {_r2_sql('y', 'pred')} AS r2, sqrt(avg((y - pred) * (y - pred))) AS rmse FROM e GROUP BY 1, 2, 3)
SELECT regime, model, count(*) AS n_folds, CAST(sum(n) AS BIGINT) AS pooled_n, round(median(r2), 6) + 0 AS median_r2,
  round(sum(r2 * n) / sum(n) FILTER (r2 IS NOT NULL), 6) + 0 AS weighted_r2, round(median(rmse), 6) + 0 AS median_rmse FROM k GROUP BY 1, 2""")
def q6_three_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge, weighted neighbours and a published prediction: the authors' holdout, random folds as many as there are usable blocks, blocks."""
    p = points(spark, sf_dir).withColumns({"published": F.col("y") * 0.5 + F.col("x2") * 0.5, "flag": F.when(F.col("vec_id") % 4 == 0, "TEST").otherwise("train")})
    p = folds.with_block(p, "lon", "lat", 45, "block")
    usable = folds.eligible_folds(p, [], "block", least=20)
    k = max(2, usable.count())
    held = folds.author_holdout(F.col("flag"))
    regimes = {
        "spatial_block": p.join(usable.select("block", F.lit(True).alias("scored")), "block", "left").withColumn("fold", F.col("block")),
        "random_kfold": p.withColumns({"fold": fold_of(F.col("vec_id"), k, 7).cast("string"), "scored": F.lit(True)}),
        "authors_holdout": p.withColumns({"fold": F.when(held, "holdout").otherwise("train"), "scored": held}),
    }
    out = None
    for regime, df in regimes.items():
        df = df.withColumn("scored", F.coalesce("scored", F.lit(False))).select("fold", "scored", "vec_id", "lon", "lat", "y", "x1", "published")
        test = learners.cross_fit_linear(df, "fold", ["x1"], "y", 1.0, name="ridge").filter("scored")
        with scratch(spark):  # the search's tables and shuffles go before the next regime's come
            near = spatial.idw(spatial.knn_join(df.filter("scored"), df, 8, "vec_id", "y", apart="fold"))
            near = written(near.select(F.col("test_key").alias("vec_id"), F.col("pred").alias("idw_k8")), "near", hold=True)
        models = ["ridge", "idw_k8"] + (["published"] if regime == "authors_holdout" else [])
        long = test.join(near, "vec_id", "left").select("fold", "y", *models).unpivot(["fold", "y"], models, "model", "pred").filter("pred is not null")
        long = long.withColumn("regime", F.lit(regime))
        out = long if out is None else out.unionByName(long)
    per = out.groupBy("regime", "model", "fold").agg(F.count(F.lit(1)).alias("n"), metrics.r2("y", "pred").alias("r2"), metrics.rmse("y", "pred").alias("rmse"))
    return rounded(per.groupBy("regime", "model").agg(
        F.count(F.lit(1)).alias("n_folds"), F.sum("n").alias("pooled_n"), F.median("r2").alias("median_r2"), summary.weighted_mean("r2", "n").alias("weighted_r2"), F.median("rmse").alias("median_rmse"),
    ))


# Q12, Q13, Q14: panels


def _z_sql(daily_cte: str, rows: str, period: str, value: str, cut: str) -> str:
    return f"""{daily_cte}, st AS (SELECT unit, avg({value}) FILTER ({period} <= {cut}) AS m, stddev_pop({value}) FILTER ({period} <= {cut}) AS s,
  count({value}) FILTER ({period} <= {cut}) AS c FROM {rows} GROUP BY 1),
z AS (SELECT r.unit, {period} AS t, ({value} - m) / s AS z FROM {rows} r JOIN st USING (unit) WHERE c >= 5 AND s > 0)"""


def _sup_sql(lags: int, horizons: list[int], cut: str, name: str = "sup") -> str:
    leads = ", ".join(f"lead(z, {h}) OVER o AS t{h}, lead(t, {h}) OVER o AS d{h}" for h in horizons)
    lag = ", ".join(f"lag(z, {j}) OVER o AS lag_{j}" for j in range(1, 2))
    need = " AND ".join(f"lag_{j} IS NOT NULL" for j in range(lags))
    each = " UNION ALL ".join(f"SELECT unit, t, lag_0, lag_1, {h} AS horizon, t{h} AS target, d{h} AS target_t, d{h} > {cut} AS is_test FROM {name}_l WHERE {need} AND t{h} IS NOT NULL" for h in horizons)
    return f"{name}_l AS (SELECT unit, t, z AS lag_0, {lag}, {leads} FROM z WINDOW o AS (PARTITION BY unit ORDER BY t)), {name} AS ({each})"


_PER_UNIT = lambda model: f"""count(*) AS n_units, round(median({model}), 6) + 0 AS median_r2, round(median({model} - base), 6) + 0 AS median_gain, CAST(sum(CAST(base >= {model} AS INTEGER)) AS BIGINT) AS persistence_wins"""

_CUT_YM = "(SELECT floor(quantile_cont(ym, 0.8)) FROM (SELECT DISTINCT ym FROM monthly))"


@registered(f"""WITH {_z_sql(MONTHLY, 'monthly', 'ym', 'value', _CUT_YM)}, {_sup_sql(2, [1, 3, 12], _CUT_YM)}, tr AS (SELECT * FROM sup
  WHERE NOT is_test), {_ridge2('m', 'tr', 'horizon', 'lag_0', 'lag_1', 'target')},
e AS (SELECT s.horizon, s.unit, target, lag_0 AS persistence, my + wa * (lag_0 - ma) + wb * (lag_1 - mb) AS ridge, q.z AS seasonal FROM sup s
  JOIN m USING (horizon) LEFT JOIN z q ON q.unit = s.unit AND q.t = s.target_t - 100 WHERE is_test),
k AS (SELECT horizon, unit, count(*) AS n, {_r2_sql('target', 'persistence', 3)} AS base, {_r2_sql('target', 'ridge', 3)} AS ridge,
  {_r2_sql('target', 'seasonal', 3)} AS seasonal FROM e GROUP BY 1, 2 HAVING count(*) >= 5),
p AS (SELECT horizon, {_r2_sql('target', 'persistence')} AS pb, {_r2_sql('target', 'ridge')} AS pr, {_r2_sql('target', 'seasonal')} AS ps FROM e
  GROUP BY 1),
o AS (SELECT horizon, 'persistence' AS model, base AS r2, base FROM k UNION ALL SELECT horizon, 'ridge', ridge, base FROM k
  UNION ALL SELECT horizon, 'seasonal', seasonal, base FROM k)
SELECT CAST(horizon AS INTEGER) AS horizon, model, round(any_value(CASE model WHEN 'persistence' THEN pb WHEN 'ridge' THEN pr ELSE ps END),
  6) + 0 AS pooled_r2, {_PER_UNIT('r2')} FROM o JOIN p USING (horizon) GROUP BY horizon, model""")
def q12_forecast_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill by horizon of the last value, the same month a year before and a ridge learner, pooled and as the median over units."""
    m = monthly(spark, sf_dir)
    cut = int(folds.chronological_cutoff(m, "ym", 0.8).first()[0])
    z = panel.train_zscore(m, "unit", "ym", "value", cut)
    s = panel.supervised(z, "unit", "ym", "z", 2, [1, 3, 12], cut)
    s = baselines.seasonal(s, z, "unit", "target_period", "ym", "z").withColumn("persistence", F.col("lag_0"))
    out = None
    for h in (1, 3, 12):
        own = s.filter(F.col("horizon") == h)
        t = learners.predicted("ridge", own.filter("not is_test"), own.filter("is_test"), ["lag_0", "lag_1"], "target", "unit", "ridge")
        out = t if out is None else out.unionByName(t)
    models = ["persistence", "ridge", "seasonal"]
    pooled = out.groupBy("horizon").agg(*(metrics.r2("target", c).alias(c) for c in models)).unpivot(["horizon"], models, "model", "pooled_r2")
    per = out.groupBy("horizon", "unit").agg(F.count(F.lit(1)).alias("n"), *(metrics.r2("target", c, 3).alias(c) for c in models)).filter("n >= 5")
    long = per.withColumn("base", F.col("persistence")).unpivot(["horizon", "unit", "base"], models, "model", "r2")
    return rounded(pooled.join(_per_unit(long, ["horizon", "model"]), ["horizon", "model"]))


def _per_unit(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_units"), F.median("r2").alias("median_r2"), F.median(F.col("r2") - F.col("base")).alias("median_gain"),
        F.sum((F.col("base") >= F.col("r2")).cast("long")).alias("persistence_wins"),
    )


_SWEEP = [(lags, day) for lags in (1, 2) for day in ("2024-01-20", "2024-01-24")]


def _panel_sql(lags: int, day: str) -> str:
    cut = f"DATE '{day}'"
    second = "lag_1" if lags == 2 else "0.0"
    return f"""SELECT * FROM (WITH {_z_sql(DAILY, 'daily', 'day', 'value', cut)}, {_sup_sql(lags, [1, 3], cut)}, tr AS (SELECT * FROM sup
  WHERE NOT is_test), {_ridge2('m', 'tr', 'horizon', 'lag_0', second, 'target')},
e AS (SELECT horizon, unit, target, lag_0, my + wa * (lag_0 - ma) + wb * ({second} - mb) AS ridge FROM sup JOIN m USING (horizon) WHERE is_test),
k AS (SELECT horizon, unit, {_r2_sql('target', 'lag_0', 3)} AS base, {_r2_sql('target', 'ridge', 3)} AS r2 FROM e GROUP BY 1, 2 HAVING count(*) >= 3),
n AS (SELECT horizon, count(*) FILTER (NOT is_test) AS n_train, count(*) FILTER (is_test) AS n_test FROM sup
  GROUP BY 1), p AS (SELECT horizon, round({_r2_sql('target', 'ridge')}, 6) + 0 AS pooled_r2 FROM e GROUP BY 1)
SELECT {lags} AS lags, {cut} AS cutoff, CAST(horizon AS INTEGER) AS horizon, n_train, n_test, pooled_r2, {_PER_UNIT('r2')} FROM k
  JOIN n USING (horizon) JOIN p USING (horizon) GROUP BY horizon, n_train, n_test, pooled_r2)"""


@registered(" UNION ALL ".join(_panel_sql(*x) for x in _SWEEP))
def q13_rolling_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ridge learner beside persistence over a sweep of lags, cutoffs and horizons: pooled skill, medians over units, gains, wins."""
    d, out = daily(spark, sf_dir), None
    for lags, day in _SWEEP:
        cut = F.lit(day).cast("date")
        s = panel.supervised(panel.train_zscore(d, "unit", "day", "value", cut), "unit", "day", "z", lags, [1, 3], cut)
        sizes = s.groupBy("horizon").agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"))
        for h in (1, 3):
            own = s.filter(F.col("horizon") == h)
            t = learners.predicted("ridge", own.filter("not is_test"), own.filter("is_test"), [f"lag_{j}" for j in range(lags)], "target", "unit", "ridge")
            pooled = t.groupBy("horizon").agg(metrics.r2("target", "ridge").alias("pooled_r2"))
            per = t.groupBy("horizon", "unit").agg(F.count(F.lit(1)).alias("n"), metrics.r2("target", "lag_0", 3).alias("base"), metrics.r2("target", "ridge", 3).alias("r2")).filter("n >= 3")
            one = sizes.join(pooled, "horizon").join(_per_unit(per, ["horizon"]), "horizon").select(F.lit(lags).alias("lags"), cut.alias("cutoff"), "*")
            out = one if out is None else out.unionByName(one)
    return rounded(out)


_SAME = f"""{DAILY}, l AS (SELECT unit, day, value AS lag_0, lead(value, 1) OVER (PARTITION BY unit ORDER BY day) AS target FROM daily),
f AS (SELECT l.*, seed, {draw_sql('unit * 100 + day(day)', 'seed')} % 5 = 0 AS is_test FROM l, (SELECT unnest([1, 2, 3]) AS seed)
  WHERE target IS NOT NULL),
m AS (SELECT unit, seed, count(*) AS n, regr_slope(target, lag_0) FILTER (NOT is_test) AS b, regr_intercept(target, lag_0) FILTER (NOT is_test) AS a
  FROM f GROUP BY 1, 2 HAVING count(*) FILTER (NOT is_test) >= 5),
k AS (SELECT unit, seed, any_value(n) AS n, {_r2_sql('target', 'lag_0', 3)} AS base, {_r2_sql('target', '(a + b * lag_0)', 3)} AS r2 FROM f
  JOIN m USING (unit, seed) WHERE is_test GROUP BY 1, 2),
u AS (SELECT unit, any_value(n) AS n_rows, count(r2) AS n_seeds, avg(base) AS base, avg(r2) AS r2, stddev_samp(r2) AS seed_sd FROM k GROUP BY 1)"""


def _same_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).withColumn("z", F.col("value"))
    s = panel.supervised(d, "unit", "day", "z", 1, [1], F.lit("2100-01-01").cast("date")).drop("is_test")
    s = s.select("*", F.explode(F.array(*map(F.lit, [1, 2, 3]))).alias("seed")).withColumn("is_test", draw(F.col("unit") * 100 + F.dayofmonth("day"), F.col("seed")) % 5 == 0)
    early = lambda c: F.when(~F.col("is_test"), F.col(c))
    m = s.groupBy("unit", "seed").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("is_test")).alias("n_train"), F.regr_slope(early("target"), early("lag_0")).alias("b"), F.regr_intercept(early("target"), early("lag_0")).alias("a"))
    t = s.filter("is_test").join(m.filter("n_train >= 5"), ["unit", "seed"]).withColumn("ols", F.col("a") + F.col("b") * F.col("lag_0"))
    k = t.groupBy("unit", "seed").agg(F.max("n_rows").alias("n_rows"), metrics.r2("target", "lag_0", 3).alias("base"), metrics.r2("target", "ols", 3).alias("r2"))
    return k.groupBy("unit").agg(F.max("n_rows").alias("n_rows"), F.count("r2").alias("n_seeds"), F.avg("base").alias("base"), F.avg("r2").alias("r2"), F.stddev_samp("r2").alias("seed_sd"))


@registered(f"WITH {_SAME} SELECT unit, n_rows, n_seeds, round(base, 6) + 0 AS persistence_r2, round(r2, 6) + 0 AS ols_r2, round(seed_sd, 6) + 0 AS seed_sd FROM u")
def q13_same_fold_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's own line and persistence on the same random test rows, as means over seeds."""
    return rounded(_same_folds(spark, sf_dir).withColumnsRenamed({"base": "persistence_r2", "r2": "ols_r2"}))


@registered(f"""WITH {_SAME}, g AS (SELECT unit, r2 - base AS gain FROM u WHERE r2 - base IS NOT NULL),
{median_interval_sql('ci', 'g', '', 'unit', ['gain'], 'm0', 3)}
SELECT count(*) AS n_units, round(median(gain), 6) + 0 AS median_gain, round(any_value(lo), 6) + 0 AS lo, round(any_value(hi), 6) + 0 AS hi,
  CAST(sum(CAST(gain <= 0 AS INTEGER)) AS BIGINT) AS persistence_wins FROM g, ci""")
def q13_gain_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median gain over persistence with its bootstrap interval over units."""
    g = _same_folds(spark, sf_dir).withColumn("gain", F.col("r2") - F.col("base")).filter("gain is not null")
    ci = bootstrap.median_interval(g, [], "unit", ["gain"], seed=3)
    own = g.agg(F.count(F.lit(1)).alias("n_units"), F.median("gain").alias("median_gain"), F.sum((F.col("gain") <= 0).cast("long")).alias("persistence_wins"))
    return rounded(own.join(ci).select("n_units", "median_gain", "lo", "hi", "persistence_wins"))  # one row each


_TAIL_DRIVERS = f"""{DAILY}, z AS (SELECT unit, day AS t, value AS z FROM daily), {_sup_sql(2, [1, 7], "DATE '2100-01-01'")},
dr AS (SELECT CAST(ts AS DATE) AS t, count(*) FILTER (event_type = 'error') / CAST(100 AS DOUBLE) AS drv FROM events WHERE day(ts) % 3 <> 0
  GROUP BY 1),
s AS (SELECT sup.* EXCLUDE (is_test), drv, row_number() OVER (PARTITION BY horizon, unit
  ORDER BY sup.t DESC) AS r, count(*) OVER (PARTITION BY horizon, unit) AS c FROM sup LEFT JOIN dr USING (t)),
w AS (SELECT *, r <= greatest(3, CAST(ceil(c * 0.2) AS BIGINT)) AS is_test FROM s WHERE c > greatest(3, CAST(ceil(c * 0.2) AS BIGINT)) + 5),
mean AS (SELECT horizon, avg(drv) FILTER (NOT is_test) AS md FROM w GROUP BY 1), v AS (SELECT w.*, coalesce(drv, md) AS d FROM w
  JOIN mean USING (horizon)), tr AS (SELECT * FROM v WHERE NOT is_test)"""


@registered(f"""WITH {_TAIL_DRIVERS}, {_ridge2('m', 'tr', 'horizon', 'lag_0', 'd', 'target')}, e AS (SELECT horizon, unit, target, lag_0, drv,
  my + wa * (lag_0 - ma) + wb * (d - mb) AS model FROM v JOIN m USING (horizon) WHERE is_test),
k AS (SELECT horizon, unit, {_r2_sql('target', 'lag_0', 3)} AS base, {_r2_sql('target', 'model', 3)} AS r2 FROM e GROUP BY 1, 2
  HAVING count(*) >= 3), q AS (SELECT horizon, count(*) AS n_units, median(r2) AS m, median(base) AS b FROM k GROUP BY 1)
SELECT CAST(horizon AS INTEGER) AS horizon, n_units, round(avg(CAST(drv IS NULL AS INTEGER)), 6) + 0 AS missing_share, round(any_value(m),
  6) + 0 AS model, round(any_value(b), 6) + 0 AS persistence, round(any_value(m - b), 6) + 0 AS increment,
  round(any_value(CASE WHEN m > 0 THEN 100 * greatest(0.0, b) / m END), 4) + 0 AS recovery_pct FROM e JOIN q USING (horizon) GROUP BY horizon, n_units""")
def q14_driver_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own last value and a driver that may be missing (then the training mean) beside persistence, on each unit's last rows."""
    d = daily(spark, sf_dir).withColumn("z", F.col("value"))
    s = panel.supervised(d, "unit", "day", "z", 2, [1, 7], F.lit("2100-01-01").cast("date")).drop("is_test")
    drv = table(spark, sf_dir, "events").filter(F.dayofmonth("ts") % 3 != 0).groupBy(F.to_date("ts").alias("day")).agg((F.count_if(F.col("event_type") == "error") / F.lit(100.0)).alias("drv"))
    out = None
    for h in (1, 7):
        own = folds.tail_split(s.filter(F.col("horizon") == h).join(drv, "day", "left"), "unit", "day", 3, 0.2, 5)
        mean = own.agg(F.avg(F.when(~F.col("is_test"), F.col("drv"))).alias("_m"))
        own = own.join(mean).withColumn("d", F.coalesce("drv", "_m"))  # one row
        t = learners.predicted("ridge", own.filter("not is_test"), own.filter("is_test"), ["lag_0", "d"], "target", "unit", "model")
        t = t.select("horizon", "unit", "target", "lag_0", "drv", "model")
        out = t if out is None else out.unionByName(t)
    per = out.groupBy("horizon", "unit").agg(F.count(F.lit(1)).alias("n"), metrics.r2("target", "lag_0", 3).alias("base"), metrics.r2("target", "model", 3).alias("r2")).filter("n >= 3")
    k = per.groupBy("horizon").agg(F.count(F.lit(1)).alias("n_units"), F.median("r2").alias("model"), F.median("base").alias("persistence"))
    gaps = out.groupBy("horizon").agg(F.avg(F.col("drv").isNull().cast("double")).alias("missing_share"))
    both = k.join(gaps, "horizon").withColumns({"increment": F.col("model") - F.col("persistence"), "recovery_pct": recovery_pct(F.col("persistence"), F.col("model"), True)})
    return rounded(both.withColumn("recovery_pct", F.round("recovery_pct", 4)))


# Q11: neighbours and a learner under both regimes


@registered(f"""WITH {POINTS}, u AS (SELECT 'random' AS regime, CAST(CAST({draw_sql('vec_id', 7)} % 5 AS INTEGER) AS VARCHAR) AS fold, * FROM points
  UNION ALL SELECT 'spatial', {_block_sql(45)}, * FROM points),
x AS (SELECT u.regime, k.fold, x1, x2, y FROM u JOIN (SELECT DISTINCT regime, fold
  FROM u) k ON u.regime = k.regime AND u.fold <> k.fold), {_ridge2('m', 'x', 'regime, fold', 'x1', 'x2', 'y')},
g AS (SELECT *, {_XYZ} FROM u), q AS (SELECT a.regime, a.vec_id, z.y AS v, z.vec_id AS k,
  sqrt((a.gx - z.gx) * (a.gx - z.gx) + (a.gy - z.gy) * (a.gy - z.gy) + (a.gz - z.gz) * (a.gz - z.gz)) AS dist FROM g a
  JOIN g z ON a.regime = z.regime AND a.fold <> z.fold),
nn AS (SELECT regime, vec_id, max(CASE WHEN rn = 1 THEN v END) AS p1, sum(v / greatest(dist, 1e-6)) / sum(1 / greatest(dist, 1e-6)) AS p8
  FROM (SELECT *, row_number() OVER (PARTITION BY regime, vec_id ORDER BY dist, k) AS rn FROM q) WHERE rn <= 8 GROUP BY 1, 2)
SELECT regime, round(sqrt(avg((y - p1) * (y - p1))), 6) + 0 AS nearest, round(sqrt(avg((y - p8) * (y - p8))), 6) + 0 AS idw8,
  round(sqrt(avg((y - (my + wa * (x1 - ma) + wb * (x2 - mb))) * (y - (my + wa * (x1 - ma) + wb * (x2 - mb))))), 6) + 0 AS ridge
FROM u JOIN m USING (regime, fold) JOIN nn USING (regime, vec_id) GROUP BY 1""")
def q11_depth_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest value, weighted neighbours and a ridge learner under random and spatial folds: RMSE per regime."""
    p, out = points(spark, sf_dir), None
    for regime, df in (("random", p.withColumn("fold", fold_of(F.col("vec_id"), 5, 7).cast("string"))), ("spatial", folds.with_block(p, "lon", "lat", 45))):
        near = spatial.knn_join(df, df, 8, "vec_id", "y", apart="fold")
        wide = spatial.idw(near, (), (1, 8)).groupBy(F.col("test_key").alias("vec_id")).pivot("k", [1, 8]).agg(F.first("pred"))
        s = learners.cross_fit_linear(df, "fold", ["x1", "x2"], "y", 1.0, name="ridge").join(wide, "vec_id")
        one = s.agg(F.lit(regime).alias("regime"), metrics.rmse("y", "1").alias("nearest"), metrics.rmse("y", "8").alias("idw8"), metrics.rmse("y", "ridge").alias("ridge"))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


# Q16, Q17: proxies and memory under random and group holdout

_LINES = f"""base AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS grp, CAST({draw_sql('l_orderkey', 1)} % 5 AS INTEGER) AS gf,
  CAST({draw_sql('l_orderkey * 10 + l_linenumber', 3)} % 5 AS INTEGER) AS rf,
  CAST(l_quantity AS DOUBLE) / 10 AS q, CAST(l_discount AS DOUBLE) * 10 AS d, CAST(l_extendedprice AS DOUBLE) / 10000 AS y FROM lineitem),
u AS (SELECT 'random' AS regime, rf AS fold, * FROM base UNION ALL SELECT 'group', gf, * FROM base)"""


@registered(f"""WITH {_LINES}, x AS (SELECT u.regime, k.fold, q, d, y FROM u JOIN (SELECT DISTINCT regime, fold
  FROM u) k ON u.regime = k.regime AND u.fold <> k.fold), {_ridge2('m', 'x', 'regime, fold', 'q', 'd', 'y')},
px AS (SELECT regime, fold, corr(y, q) ** 2 AS rq, corr(y, d) ** 2 AS rd, regr_slope(y, q) AS bq, regr_intercept(y, q) AS aq, regr_slope(y, d) AS bd,
  regr_intercept(y, d) AS ad FROM x GROUP BY 1, 2),
c AS (SELECT regime, fold, grp, sum(y) AS s, count(y) AS n FROM u GROUP BY 1, 2, 3), g AS (SELECT regime, grp, sum(s) AS s, sum(n) AS n FROM c
  GROUP BY 1, 2), pt AS (SELECT regime, fold, sum(s) AS s, sum(n) AS n FROM c GROUP BY 1, 2), tt AS (SELECT regime, sum(s) AS s, sum(n) AS n FROM c
  GROUP BY 1),
o AS (SELECT c.regime, c.fold, c.grp, (g.s - c.s) / nullif(g.n - c.n, 0) AS own, (tt.s - pt.s) / nullif(tt.n - pt.n, 0) AS rest FROM c
  JOIN g USING (regime, grp) JOIN pt USING (regime, fold) JOIN tt USING (regime)),
e AS (SELECT u.regime, u.fold, u.y, my + wa * (q - ma) + wb * (d - mb) AS ridge,
  CASE WHEN rq >= rd THEN aq + bq * q ELSE ad + bd * d END AS single, coalesce(own, rest) AS mem, own IS NOT NULL AS seen
  FROM u JOIN m USING (regime, fold) JOIN px USING (regime, fold) JOIN o USING (regime, fold, grp)),
k AS (SELECT regime, fold, {_r2_sql('y', 'ridge')} AS ridge, {_r2_sql('y', 'single')} AS single, {_r2_sql('y', 'mem')} AS mem,
  avg(CAST(seen AS INTEGER)) AS seen FROM e GROUP BY 1, 2)
SELECT regime, count(*) AS n_folds, round(median(ridge), 6) + 0 AS ridge, round(median(single), 6) + 0 AS single_proxy, round(median(mem),
  6) + 0 AS same_unit_mean, round(avg(seen), 6) + 0 AS seen_share,
  round(CASE WHEN median(ridge) > 0 THEN 100 * median(single) / median(ridge) END, 4) + 0 AS recovery_pct FROM k GROUP BY 1""")
def q16_proxy_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random against whole-order folds, all of them: a ridge learner, the single proxy that fits the training rows best, the order's own mean."""
    base = lines(spark, sf_dir).withColumn("grp", F.floor(F.col("id") / 10))
    out = None
    for regime, df in (("random", base.withColumn("fold", fold_of(F.col("id"), 5, 3))), ("group", base)):
        p = learners.cross_fit_linear(df, "fold", ["q", "d"], "y", 1.0, name="ridge")
        p = learners.cross_fit_single(p, "fold", ["d", "q"], "y", name="single")
        p = baselines.fold_group_mean(p, "fold", ["grp"], "y")
        k = p.groupBy("fold").agg(metrics.r2("y", "ridge").alias("ridge"), metrics.r2("y", "single").alias("single"), metrics.r2("y", "pred").alias("mem"), F.avg(F.col("seen").cast("double")).alias("seen"))
        one = k.agg(F.lit(regime).alias("regime"), F.count(F.lit(1)).alias("n_folds"), F.median("ridge").alias("ridge"), F.median("single").alias("single_proxy"), F.median("mem").alias("same_unit_mean"), F.avg("seen").alias("seen_share"))
        out = one if out is None else out.unionByName(one)
    return rounded(out.withColumn("recovery_pct", F.round(recovery_pct(F.col("single_proxy"), F.col("ridge")), 4)))


@registered(f"""WITH {CUSTOMERS}, u AS (SELECT 'random' AS regime, CAST({draw_sql('o_orderkey', 8)} % 5 AS INTEGER) AS fold, unit, y / 100000 AS v FROM customers
  UNION ALL SELECT 'unit', CAST({draw_sql('unit', 8)} % 5 AS INTEGER), unit, y / 100000 FROM customers),
c AS (SELECT regime, fold, unit, sum(v) AS s, count(v) AS n FROM u GROUP BY 1, 2, 3), g AS (SELECT regime, unit, sum(s) AS s, sum(n) AS n FROM c
  GROUP BY 1, 2), p AS (SELECT regime, fold, sum(s) AS s, sum(n) AS n FROM c GROUP BY 1, 2), t AS (SELECT regime, sum(s) AS s, sum(n) AS n FROM c
  GROUP BY 1),
o AS (SELECT c.regime, c.fold, c.unit, (g.s - c.s) / nullif(g.n - c.n, 0) AS own, (t.s - p.s) / nullif(t.n - p.n, 0) AS rest FROM c
  JOIN g USING (regime, unit) JOIN p USING (regime, fold) JOIN t USING (regime)),
k AS (SELECT regime, sqrt(avg((v - coalesce(own, rest)) * (v - coalesce(own, rest)))) AS rmse, avg(CAST(own IS NOT NULL AS INTEGER)) AS seen,
  count(*) AS n FROM u JOIN o USING (regime, fold, unit) GROUP BY 1)
SELECT a.n, round(a.rmse, 6) + 0 AS random_rmse, round(b.rmse, 6) + 0 AS unit_rmse, round(a.seen, 6) + 0 AS random_seen, round(b.seen,
  6) + 0 AS unit_seen, round(1 - a.rmse / b.rmse, 6) + 0 AS memory_skill FROM k a JOIN k b ON a.regime = 'random' AND b.regime = 'unit'""")
def q17_memory_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a unit's own mean is worth: orders held out at random, where their customer is known, against whole customers held out."""
    c, parts = customers(spark, sf_dir).select("o_orderkey", "unit", (F.col("y") / 100000).alias("v")), []
    for name, key in (("random", "o_orderkey"), ("unit", "unit")):
        p = baselines.fold_group_mean(c.withColumn("fold", fold_of(F.col(key), 5, 8)), "fold", ["unit"], "v")
        parts.append(p.agg(F.count(F.lit(1)).alias("n"), metrics.rmse("v", "pred").alias(f"{name}_rmse"), F.avg(F.col("seen").cast("double")).alias(f"{name}_seen")))
    both = parts[0].join(parts[1].drop("n"))  # one row each
    from plumbline.functions.skill import rmse_skill

    return rounded(both.withColumn("memory_skill", rmse_skill(F.col("random_rmse"), F.col("unit_rmse"))))


# Q18: how an index that is a formula of its parts is recovered

_INDEX = "ix AS (SELECT l_orderkey * 10 + l_linenumber AS id, ln(CAST(l_quantity AS DOUBLE)) AS lq, ln(CAST(l_extendedprice AS DOUBLE)) AS lp, ln(1 - CAST(l_discount AS DOUBLE)) AS ld FROM lineitem), v AS (SELECT *, lq + lp + ld AS y FROM ix)"


@registered(f"""WITH {_INDEX}, a AS (SELECT 'noise' AS axis, noise AS level, y, lp + noise * ({draw_sql('id', 5)} / CAST(2147483629 AS DOUBLE) - 0.5) AS x
  FROM v, (SELECT unnest([0.0, 0.5, 2.0])::DOUBLE AS noise)
UNION ALL SELECT 'size', share, y, lp FROM v, (SELECT unnest([0.1, 0.5, 1.0])::DOUBLE AS share) WHERE {draw_sql('id', 6)} % 1000 < share * 1000
  UNION ALL SELECT 'class', 0.0, CAST(y > 12 AS DOUBLE), lp FROM v
UNION ALL SELECT 'part', 1.0, y, lq FROM v UNION ALL SELECT 'part', 2.0, y, lp FROM v UNION ALL SELECT 'part', 3.0, y, ld FROM v)
SELECT axis, level, count(*) AS n, round(regr_slope(y, x), 6) + 0 AS slope, round(corr(y, x) ** 2, 6) + 0 AS r2 FROM a GROUP BY 1, 2""")
def q18_robustness_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a formula index that one part explains: with noise on it, on fewer rows, as a class, and by each part."""
    d = lambda c: F.col(c).cast("double")
    ix = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.log(d("l_quantity")).alias("lq"), F.log(d("l_extendedprice")).alias("lp"), F.log(1 - d("l_discount")).alias("ld"))
    v = ix.withColumn("y", F.col("lq") + F.col("lp") + F.col("ld"))
    level = lambda xs: F.explode(F.array(*(F.lit(float(x)) for x in xs))).alias("level")
    noise = v.select("*", level([0.0, 0.5, 2.0])).withColumn("x", F.col("lp") + F.col("level") * (draw(F.col("id"), 5) / F.lit(2147483629.0) - 0.5))
    size = v.select("*", level([0.1, 0.5, 1.0])).filter(draw(F.col("id"), 6) % 1000 < F.col("level") * 1000).withColumn("x", F.col("lp"))
    parts = [noise.select(F.lit("noise").alias("axis"), "level", "y", "x"), size.select(F.lit("size").alias("axis"), "level", "y", "x"), v.select(F.lit("class").alias("axis"), F.lit(0.0).alias("level"), (F.col("y") > 12).cast("double").alias("y"), F.col("lp").alias("x"))]
    parts += [v.select(F.lit("part").alias("axis"), F.lit(float(i)).alias("level"), "y", F.col(c).alias("x")) for i, c in enumerate(("lq", "lp", "ld"), 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out.groupBy("axis", "level").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.pow(F.corr("y", "x"), 2).alias("r2")))


# Q19, Q20: the audit and the relations behind figures

_W = "1.959963984540054"


@registered(f"""WITH a AS (SELECT quality, toxic, lang FROM labels LEFT JOIN documents USING (doc_id)), r AS (SELECT 'good' AS rate,
  count(*) FILTER (quality = 1) AS k, count(*) AS n FROM a UNION ALL SELECT 'toxic', count(*) FILTER (toxic = 1), count(*) FROM a
UNION ALL SELECT 'good, not toxic', count(*) FILTER (quality = 1 AND toxic = 0), count(*) FROM a
  UNION ALL SELECT 'with a language', count(*) FILTER (lang IS NOT NULL), count(*) FROM a
  UNION ALL SELECT 'toxic of the good', count(*) FILTER (quality = 1 AND toxic = 1), count(*) FILTER (quality = 1) FROM a),
w AS (SELECT *, k / n AS p, {_W} * {_W} AS z2 FROM r)
SELECT rate, k, n, round(100 * p, 4) + 0 AS pct,
  round(100 * greatest(((p + z2 / (2 * n)) - {_W} * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 0), 4) + 0 AS lo,
  round(100 * least(((p + z2 / (2 * n)) + {_W} * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 1), 4) + 0 AS hi FROM w""")
def q19_audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the labelled documents with their denominators and intervals."""
    a = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "left")
    good, toxic, every = F.col("quality") == 1, F.col("toxic") == 1, F.lit(True)
    rates = {"good": (good, every), "toxic": (toxic, every), "good, not toxic": (good & ~toxic, every), "with a language": (F.col("lang").isNotNull(), every), "toxic of the good": (good & toxic, good)}
    one = a.agg(*(F.struct(F.count_if(k).alias("k"), F.count_if(n).alias("n")).alias(f"r{i}") for i, (k, n) in enumerate(rates.values())))
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("rate"), F.col(f"r{i}.k").alias("k"), F.col(f"r{i}.n").alias("n")) for i, name in enumerate(rates)))).alias("o")
    out = one.select(rows).select("o.*")
    lo, hi = metrics.wilson(F.col("k"), F.col("n"))
    return rounded(out.select("rate", "k", "n", (F.lit(100.0) * F.try_divide("k", "n")).alias("pct"), (100 * lo).alias("lo"), (100 * hi).alias("hi")), 4)


@registered(f"""WITH {POINTS}, s AS (SELECT points.*, block_deg FROM points, (SELECT unnest([10.0, 20.0, 45.0])::DOUBLE AS block_deg)), b AS (SELECT block_deg,
  concat(CAST(CAST(floor(lon / block_deg) AS BIGINT) AS VARCHAR), '_', CAST(CAST(floor(lat / block_deg) AS BIGINT) AS VARCHAR)) AS fold, y FROM s),
c AS (SELECT block_deg, fold, avg(y) AS m FROM b GROUP BY 1, 2 HAVING count(*) >= 5) SELECT block_deg, count(*) AS n_folds, round(min(m),
  6) + 0 AS least, round(quantile_cont(m, 0.25), 6) + 0 AS q25, round(median(m), 6) + 0 AS median, round(quantile_cont(m, 0.75), 6) + 0 AS q75,
  round(max(m), 6) + 0 AS most FROM c GROUP BY 1""")
def q20_fold_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of fold scores by block size, as a figure would draw it."""
    b = folds.block_sweep(points(spark, sf_dir), "lon", "lat", [10.0, 20.0, 45.0])
    c = b.groupBy("block_deg", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m")).filter("n >= 5")
    q = lambda x: F.percentile("m", F.lit(x))
    return rounded(c.groupBy("block_deg").agg(F.count(F.lit(1)).alias("n_folds"), F.min("m").alias("least"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), F.max("m").alias("most")))
