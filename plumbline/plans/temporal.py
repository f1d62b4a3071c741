"""Temporal axis: panels, lags, persistence and seasonal baselines, chronological splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.draws import draw_sql
from plumbline.operators import baselines, encode, folds, metrics, panel, relational, summary
from plumbline.plans.tables import CUTOFF, DAILY, MONTHLY, daily, monthly, registered, rounded, table

_Z = f"""{DAILY}, st AS (
  SELECT unit, avg(value) FILTER (day <= DATE '{CUTOFF}') AS m, stddev_pop(value) FILTER (day <= DATE '{CUTOFF}') AS s,
  count(value) FILTER (day <= DATE '{CUTOFF}') AS c FROM daily GROUP BY 1),
z AS (SELECT daily.unit, day, (value - m) / s AS z FROM daily JOIN st USING (unit) WHERE c >= 5 AND s > 0)"""
_SUP = lambda hs: f"""{_Z}, l AS (  -- noqa
  SELECT unit, day, z AS lag_0, lag(z, 1) OVER w AS lag_1, lag(z, 2) OVER w AS lag_2,
  {', '.join(f'lead(z, {h}) OVER w AS t{h}, lead(day, {h}) OVER w AS d{h}' for h in hs)}
  FROM z WINDOW w AS (PARTITION BY unit ORDER BY day)),
sup AS ({' UNION ALL '.join(f"SELECT unit, day, lag_0, lag_1, lag_2, {h} AS horizon, t{h} AS target, d{h} AS target_period, d{h} > DATE '{CUTOFF}' AS is_test FROM l WHERE lag_0 IS NOT NULL AND lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND t{h} IS NOT NULL" for h in hs)})"""  # noqa: E731


def _cut():
    return F.lit(CUTOFF).cast("date")


def _supervised(spark: SparkSession, sf_dir: str, horizons: list[int]) -> DataFrame:
    z = panel.train_zscore(daily(spark, sf_dir), "unit", "day", "value", _cut())
    return panel.supervised(z, "unit", "day", "z", 3, horizons, _cut())


def skill_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 of the last value one step ahead, per unit, on targets after the cutoff."""
    test = baselines.persistence(_supervised(spark, sf_dir, [1]).filter("is_test"), "lag_0")
    return rounded(test.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), metrics.r2("target", "persistence", 3).alias("r2"), metrics.rmse("target", "persistence").alias("rmse")))


@registered(f"""WITH {_SUP([1])} SELECT unit, count(*) AS n,
  round(CASE WHEN count(*) >= 3 AND var_pop(target) > 0 THEN 1 - sum((target - lag_0) * (target - lag_0)) / (var_pop(target) * count(*)) END,
  6) + 0 AS r2,
round(sqrt(avg((target - lag_0) * (target - lag_0))), 6) + 0 AS rmse FROM sup WHERE is_test GROUP BY 1""")
def b9_persistence_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skill_by_unit(spark, sf_dir)


@registered(f"WITH {_Z} SELECT unit, day, round(z, 6) + 0 AS z FROM z")
def w1_train_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.train_zscore(daily(spark, sf_dir), "unit", "day", "value", _cut()).select("unit", "day", "z"))


@registered(f"WITH {_SUP([1, 3])} SELECT unit, day, CAST(horizon AS INTEGER) AS horizon, round(lag_0, 6) + 0 AS lag_0, round(lag_1, 6) + 0 AS lag_1, round(lag_2, 6) + 0 AS lag_2, round(target, 6) + 0 AS target, target_period, is_test FROM sup")
def w2_supervised_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_supervised(spark, sf_dir, [1, 3]).select("unit", "day", "horizon", "lag_0", "lag_1", "lag_2", "target", "target_period", "is_test"))


@registered(f"""WITH {_SUP([1, 3, 7])}, u AS (
  SELECT horizon, unit, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(target) > 0 THEN 1 - sum((target - lag_0) * (target - lag_0)) / (var_pop(target) * count(*)) END AS r2
  FROM sup WHERE is_test GROUP BY 1, 2),
p AS (SELECT horizon, count(*) AS n_rows, 1 - sum((target - lag_0) * (target - lag_0)) / (var_pop(target) * count(*)) AS pooled_r2 FROM sup
  WHERE is_test GROUP BY 1)
SELECT CAST(p.horizon AS INTEGER) AS horizon, n_rows, round(pooled_r2, 6) + 0 AS pooled_r2, n_units, round(median_r2, 6) + 0 AS median_r2, n_degenerate
FROM p JOIN (SELECT horizon, count(*) AS n_units, median(r2) AS median_r2, count(*) FILTER (r2 IS NULL) AS n_degenerate FROM u WHERE n >= 3
  GROUP BY 1) q USING (horizon)""")
def w3_horizon_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = _supervised(spark, sf_dir, [1, 3, 7]).filter("is_test")
    pooled = test.groupBy("horizon").agg(F.count(F.lit(1)).alias("n_rows"), metrics.r2("target", "lag_0").alias("pooled_r2"))
    per = test.groupBy("horizon", "unit").agg(F.count(F.lit(1)).alias("n"), metrics.r2("target", "lag_0", 3).alias("r2")).filter("n >= 3")
    units = per.groupBy("horizon").agg(F.count(F.lit(1)).alias("n_units"), F.median("r2").alias("median_r2"), F.count_if(F.col("r2").isNull()).alias("n_degenerate"))
    return rounded(pooled.join(units, "horizon"))


@registered(f"""WITH {MONTHLY}, l AS (SELECT unit, ym, value, lead(value, 1) OVER w AS target, lead(ym, 1) OVER w AS target_ym FROM monthly
  WINDOW w AS (PARTITION BY unit ORDER BY ym))
SELECT l.unit, l.ym, l.target_ym, round(l.target, 2) + 0 AS target, round(s.value, 2) + 0 AS seasonal FROM l LEFT
  JOIN monthly s ON s.unit = l.unit AND s.ym = l.target_ym - 100 WHERE target IS NOT NULL""")
def b10_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir)
    frame = panel.supervised(m, "unit", "ym", "value", 1, [1], 0)
    out = baselines.seasonal(frame, m, "unit", "target_period", "ym", "value")
    return rounded(out.select("unit", "ym", F.col("target_period").alias("target_ym"), "target", "seasonal"), 2)


@registered(f"WITH {MONTHLY} SELECT CAST(floor(quantile_cont(ym, 0.8)) AS BIGINT) AS cutoff FROM (SELECT DISTINCT ym FROM monthly)")
def f13_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.chronological_cutoff(monthly(spark, sf_dir), "ym", 0.8)


@registered(f"""WITH {DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY day DESC) AS r, count(*) OVER (PARTITION BY unit) AS c FROM daily),
w AS (SELECT *, greatest(4, CAST(ceil(c * 0.2) AS BIGINT)) AS w FROM r)
SELECT unit, r <= w AS is_test, count(*) AS n, min(day) AS first_day FROM w WHERE c > w + 10 GROUP BY 1, 2""")
def f14_tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.tail_split(daily(spark, sf_dir), "unit", "day", 4, 0.2, 10).groupBy("unit", "is_test").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"))


@registered("""WITH d AS (SELECT user_id AS unit, CAST(ts AS DATE) AS day, avg(value) AS value FROM events GROUP BY 1, 2),
k AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors,
  avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS k FROM events GROUP BY 1)
SELECT unit, day, round(value, 6) + 0 AS value, clicks, errors, round(k, 6) + 0 AS k FROM d LEFT JOIN k USING (day)""")
def j1_left_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    kinds = e.groupBy("day").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "error").alias("errors"))
    k = e.groupBy("day").agg(F.avg(F.get_json_object("props", "$.k").try_cast("double")).alias("k"))
    return rounded(relational.left_attach(daily(spark, sf_dir).drop("n"), [kinds, k], ["day"]))


@registered(f"WITH {DAILY} SELECT unit, day, n, lag(n, 0) OVER w AS n_lag_0, lag(n, 1) OVER w AS n_lag_1, lag(n, 2) OVER w AS n_lag_2 FROM daily WINDOW w AS (PARTITION BY unit ORDER BY day)")
def w5_driver_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.driver_lags(daily(spark, sf_dir).select("unit", "day", "n"), "unit", "day", ["n"], 2)


@registered(f"WITH {MONTHLY}, y AS (SELECT unit, ym // 100 AS year, avg(value) / 1e7 AS v FROM monthly GROUP BY 1, 2) SELECT unit, CAST(year AS INTEGER) AS year, round(v, 4) + 0 AS v, round(CASE WHEN count(v) OVER w >= 2 THEN avg(v) OVER w END, 4) + 0 AS trailing FROM y WINDOW w AS (PARTITION BY unit ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def w8_trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = monthly(spark, sf_dir).groupBy("unit", F.floor(F.col("ym") / 100).cast("int").alias("year")).agg((F.avg("value") / 1e7).alias("v"))
    return rounded(panel.trailing_mean(y, ["unit"], "year", "v"), 4)


@registered(f"WITH {MONTHLY} SELECT ym FROM monthly GROUP BY 1 HAVING count(DISTINCT unit) = (SELECT count(DISTINCT unit) FROM monthly)")
def w11_common_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.common_periods(monthly(spark, sf_dir), "unit", "ym")


@registered("SELECT event_type, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def w12_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"), F.count_distinct("user_id").alias("n_users"))


@registered(f"WITH {DAILY} SELECT unit, day, round(value, 6) + 0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY day DESC) AS r FROM daily) WHERE r <= 5")
def p20_latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.latest_rows(daily(spark, sf_dir), "unit", "day", 5).select("unit", "day", "value"))


@registered(f"WITH {DAILY} SELECT unit, count(*) AS n_days FROM daily GROUP BY 1 HAVING count(value) >= 25")
def p21_eligible_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.eligible_units(daily(spark, sf_dir), "unit", "value", 25).groupBy("unit").agg(F.count(F.lit(1)).alias("n_days"))


@registered(f"WITH {DAILY}, u AS (SELECT unit FROM (SELECT DISTINCT unit FROM daily) ORDER BY {draw_sql('unit', 4)}, unit LIMIT 20) SELECT unit, count(*) AS n_days FROM daily WHERE unit IN (SELECT unit FROM u) GROUP BY 1")
def f21_sample_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.sample_units(daily(spark, sf_dir), "unit", 20, 4).groupBy("unit").agg(F.count(F.lit(1)).alias("n_days"))


@registered()
def f19_overlap_greedy_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = daily(spark, sf_dir).withColumn("cell", F.floor(F.col("unit") / 8).cast("int"))  # cells grow in number, not in size
    return folds.overlap_greedy_units(p, "cell", "unit", "day", 12)


_SPLITS = f"""{_SUP([1, 3])}, m AS (
  SELECT horizon, unit, avg(target) AS mean_target FROM sup WHERE NOT is_test GROUP BY 1, 2),
t AS (SELECT s.*, mean_target FROM sup s JOIN m USING (horizon, unit) WHERE is_test),
u AS (SELECT horizon, unit, count(*) AS n, sqrt(avg((target - lag_0) * (target - lag_0))) AS persistence,
  sqrt(avg((target - mean_target) * (target - mean_target))) AS unit_mean FROM t GROUP BY 1, 2)"""


@registered(f"""WITH {_SPLITS} SELECT CAST(horizon AS INTEGER) AS horizon, count(*) AS n_units, round(median(persistence), 6) + 0 AS persistence_rmse,
  round(median(unit_mean), 6) + 0 AS mean_rmse,
CAST(sum(CAST(persistence <= unit_mean AS INTEGER)) AS BIGINT) AS wins FROM u WHERE n >= 3 GROUP BY 1""")
def q12_rolling_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _supervised(spark, sf_dir, [1, 3])
    per = s.filter("not is_test").groupBy("horizon", "unit").agg(F.avg("target").alias("mean_target"))
    t = s.filter("is_test").join(per, ["horizon", "unit"])
    u = t.groupBy("horizon", "unit").agg(F.count(F.lit(1)).alias("n"), metrics.rmse("target", "lag_0").alias("persistence"), metrics.rmse("target", "mean_target").alias("unit_mean")).filter("n >= 3")
    return rounded(u.groupBy("horizon").agg(F.count(F.lit(1)).alias("n_units"), F.median("persistence").alias("persistence_rmse"), F.median("unit_mean").alias("mean_rmse"), F.sum((F.col("persistence") <= F.col("unit_mean")).cast("long")).alias("wins")))


@registered(f"""WITH {DAILY}, s AS (SELECT unit, seed, avg(value) AS v FROM daily, (SELECT unnest([1, 2, 3, 4]) AS seed)
  WHERE {draw_sql('unit * 100 + day(day)', 'seed')} % 2 = 0 GROUP BY 1, 2),
p AS (SELECT unit, avg(v) AS m, stddev_samp(v) AS sd FROM s GROUP BY 1) SELECT count(*) AS n_units, round(median(m), 6) + 0 AS median, round(avg(sd),
  6) + 0 AS seed_sd FROM p""")
def a10_seeds_then_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.functions.draws import draw

    d = daily(spark, sf_dir).select("unit", "day", "value", F.explode(F.array(*map(F.lit, [1, 2, 3, 4]))).alias("seed"))
    half = d.filter(draw(F.col("unit") * 100 + F.dayofmonth("day"), F.col("seed")) % 2 == 0)
    return rounded(summary.seeds_then_units(half.groupBy("unit", "seed").agg(F.avg("value").alias("v")), [], "unit", "v"))
