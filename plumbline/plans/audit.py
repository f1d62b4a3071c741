"""Audit analytics: classification metrics, agreement, proportions, strata, bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import bootstrap, metrics, summary
from plumbline.plans.sql import median_interval_sql
from plumbline.plans.tables import CUSTOMERS, POINTS, customers, points, registered, rounded, table


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: two raters of quality, a score with ties, and strata."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id")


JUDGED = "judged AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"


@registered(f"""WITH {JUDGED}, r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang
  ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rk FROM judged)
SELECT lang, count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality = 0) AS n_neg,
round((sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / nullif(count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0),
  0), 6) + 0 AS auc FROM r GROUP BY 1""")
def m4_auc_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc(judged(spark, sf_dir), ["lang"], "quality", "n_chars"))


@registered(f"""WITH {JUDGED}, s AS (SELECT n_chars, CAST(sum(toxic) AS BIGINT) AS pos, count(*) AS c FROM judged GROUP BY 1),
k AS (SELECT pos, sum(pos) OVER w AS tp, sum(c) OVER w AS k FROM s WINDOW w AS (ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING)),
  t AS (SELECT sum(pos) AS p, sum(c) AS n FROM s)
SELECT CAST(any_value(n) AS BIGINT) AS n, CAST(any_value(p) AS BIGINT) AS n_pos, round(any_value(p) / any_value(n), 6) + 0 AS prevalence,
  round(sum(pos / p * tp / k), 6) + 0 AS ap, round(sum(pos / p * tp / k) / (any_value(p) / any_value(n)), 6) + 0 AS ap_lift FROM k, t""")
def m5_ap_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_precision(judged(spark, sf_dir), [], "toxic", "n_chars"))


_ARGMAX = "WITH p AS (SELECT vec_id, label, CAST(embedding[1:10] AS DOUBLE[]) AS s FROM embeddings)"


@registered(f"""{_ARGMAX}, l AS (SELECT cls, CAST(label = cls AS INTEGER) AS y, s[cls + 1] AS s FROM p, (SELECT unnest(range(10)) AS cls)),
r AS (SELECT cls, y, rank() OVER (PARTITION BY cls ORDER BY s) + (count(*) OVER (PARTITION BY cls, s) - 1) / 2.0 AS rk FROM l),
a AS (SELECT cls, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0),
  0) AS auc FROM r GROUP BY 1)
SELECT round(avg(auc), 6) + 0 AS macro_auc, count(auc) AS n_classes FROM a""")
def m6_macro_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", *(F.col("embedding")[i].cast("double").alias(f"s{i}") for i in range(10)))
    return rounded(metrics.macro_auc(e, [], "label", {i: f"s{i}" for i in range(10)}))


@registered(f"{_ARGMAX} SELECT label, count(*) AS n, round(avg(CAST(list_position(s, list_max(s)) - 1 = label AS INTEGER)), 6) + 0 AS accuracy FROM p GROUP BY 1")
def m7_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select("label", (F.array_position(s, F.array_max(s)) - 1).alias("pred"))
    return rounded(e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), metrics.accuracy("label", "pred").alias("accuracy")))


@registered(f"""WITH {JUDGED}, r AS (SELECT lang, quality AS a, 1 - toxic AS b FROM judged), t AS (SELECT lang, count(*) AS n, avg(CAST(a = b AS INTEGER)) AS po,
  avg(a) AS pa, avg(b) AS pb FROM r GROUP BY 1)
SELECT lang, n, round(100 * po, 6) + 0 AS agreement_pct, round((po - (pa * pb + (1 - pa) * (1 - pb))) / nullif(1 - (pa * pb + (1 - pa) * (1 - pb)), 0),
  6) + 0 AS kappa FROM t""")
def m16_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.kappa(judged(spark, sf_dir).withColumn("clean", 1 - F.col("toxic")), ["lang"], "quality", "clean"))


@registered(f"WITH {JUDGED} SELECT lang, count(*) FILTER (quality = 1 AND n_chars > 500) AS tp, count(*) FILTER (quality = 0 AND n_chars > 500) AS fp, count(*) FILTER (quality = 1 AND NOT n_chars > 500) AS fn, count(*) FILTER (quality = 0 AND NOT n_chars > 500) AS tn FROM judged GROUP BY 1")
def m17_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = metrics.confusion(F.col("quality") == 1, F.col("n_chars") > 500)
    return judged(spark, sf_dir).groupBy("lang").agg(*(c.alias(k) for k, c in cells.items()))


_Z = 1.959963984540054


@registered(f"""WITH {JUDGED}, t AS (SELECT source, CAST(sum(toxic) AS BIGINT) AS k, count(*) AS n FROM judged GROUP BY 1), p AS (SELECT *, k / n AS p FROM t)
SELECT source, k, n, round(100 * greatest((p + {_Z * _Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4 * n * n))) / (1 + {_Z * _Z} / n), 0),
  6) + 0 AS lo, round(100 * least((p + {_Z * _Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4 * n * n))) / (1 + {_Z * _Z} / n), 1),
  6) + 0 AS hi FROM p""")
def m18_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = judged(spark, sf_dir).groupBy("source").agg(F.sum("toxic").cast("long").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = metrics.wilson(F.col("k"), F.col("n"))
    return rounded(t.select("source", "k", "n", (100 * lo).alias("lo"), (100 * hi).alias("hi")))


def _tail_sql(first: str, last: str, p: str) -> str:
    """Probability of ``first`` to ``last`` of n draws, each with probability p."""
    return f"list_sum(list_transform(range({first}, {last} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))))"


@registered(f"""WITH RECURSIVE {JUDGED}, t AS (SELECT source, CAST(sum(toxic) AS BIGINT) AS k, count(*) AS n FROM judged GROUP BY 1),
b AS (SELECT source, k, n, 0 AS step, CAST(0 AS DOUBLE) AS la, CAST(1 AS DOUBLE) AS lb, CAST(0 AS DOUBLE) AS ha, CAST(1 AS DOUBLE) AS hb FROM t
UNION ALL SELECT source, k, n, step + 1, CASE WHEN low THEN (la + lb) / 2 ELSE la END, CASE WHEN low THEN lb ELSE (la + lb) / 2 END,
  CASE WHEN high THEN (ha + hb) / 2 ELSE ha END, CASE WHEN high THEN hb ELSE (ha + hb) / 2 END
  FROM (SELECT *, {_tail_sql('k', 'n', '((la + lb) / 2)')} < 0.025 AS low, {_tail_sql('0', 'k', '((ha + hb) / 2)')} > 0.025 AS high FROM b WHERE step < 50))
SELECT source, k, n, round(CASE WHEN k = 0 THEN 0.0 ELSE la END, 6) + 0 AS lo, round(CASE WHEN k = n THEN 1.0 ELSE hb END, 6) + 0 AS hi FROM b WHERE step = 50""")
def m18_clopper_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = judged(spark, sf_dir).groupBy("source").agg(F.sum("toxic").cast("long").alias("k"), F.count(F.lit(1)).alias("n"))
    return rounded(t.withColumn("ci", metrics.clopper_pearson("k", "n")).select("source", "k", "n", F.col("ci.lo"), F.col("ci.hi")))


def _boot_sql(values: list[str], statistic: str, seed: int) -> str:
    return f"WITH {_UNITS}, {median_interval_sql('ci', 'units', '', 'unit', values, statistic, seed)} SELECT round(lo, 6) + 0 AS lo, round(hi, 6) + 0 AS hi FROM ci"


_UNITS = f"{JUDGED}, units AS (SELECT source AS unit, avg(quality) AS q, avg(toxic) AS t FROM judged GROUP BY 1)"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).groupBy(F.col("source").alias("unit")).agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"))


@registered(_boot_sql(["q"], "m0", 3))
def m19_bootstrap_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bootstrap.median_interval(_units(spark, sf_dir), [], "unit", ["q"], seed=3))


@registered(_boot_sql(["q", "t"], "m0 - m1", 5))
def m20_paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bootstrap.median_interval(_units(spark, sf_dir), [], "unit", ["q", "t"], lambda q, t: q - t, seed=5))


@registered(_boot_sql(["t", "q"], "m0 / nullif(m1, 0)", 6))
def m21_bootstrap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bootstrap.median_interval(_units(spark, sf_dir), [], "unit", ["t", "q"], F.try_divide, seed=6))


@registered(f"WITH {POINTS} SELECT label, count(y) AS n, round(avg(y), 6) + 0 AS mean, round(stddev_samp(y), 6) + 0 AS sd, round(min(y), 6) + 0 AS min, round(quantile_cont(y, 0.05), 6) + 0 AS p05, round(quantile_cont(y, 0.5), 6) + 0 AS p50, round(quantile_cont(y, 0.95), 6) + 0 AS p95, round(max(y), 6) + 0 AS max FROM points GROUP BY 1")
def m22_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.describe(points(spark, sf_dir), ["label"], "y"))


@registered(f"""WITH {JUDGED}, c AS (SELECT lang, quality, count(*) AS n FROM judged GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT lang
  FROM c), (SELECT DISTINCT quality FROM c)), t AS (SELECT lang, sum(n) AS t FROM c GROUP BY 1)
SELECT lang, quality, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / t, 6) + 0 AS row_pct FROM g LEFT JOIN c USING (lang, quality)
  JOIN t USING (lang)""")
def a13_crosstab_rowpct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.cross_table(judged(spark, sf_dir), "lang", "quality"))


@registered(f"WITH {JUDGED} SELECT lang, count(*) FILTER (toxic = 1) AS n_given, count(*) FILTER (toxic = 1 AND quality = 1) AS n_event, round(100.0 * count(*) FILTER (toxic = 1 AND quality = 1) / nullif(count(*) FILTER (toxic = 1), 0), 6) + 0 AS share_pct FROM judged GROUP BY 1")
def a14_conditional_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.conditional_share(judged(spark, sf_dir), ["lang"], F.col("toxic") == 1, F.col("quality") == 1))


@registered(f"""WITH {JUDGED}, e AS (SELECT lang, quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS e FROM judged GROUP BY 1)
SELECT lang, CAST(len(list_filter(e, lambda v: v < n_chars)) + 1 AS INTEGER) AS stratum, count(*) AS n, round(avg(quality), 6) + 0 AS share FROM judged
  JOIN e USING (lang) GROUP BY 1, 2""")
def a15_quantile_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summary.quantile_strata(judged(spark, sf_dir), ["lang"], "n_chars")
    return rounded(s.groupBy("lang", "stratum").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("share")))


@registered("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def a7_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.value_counts(table(spark, sf_dir, "documents"), "source")


@registered(f"WITH {CUSTOMERS} SELECT region, count(DISTINCT unit) AS n_units, count(DISTINCT nation) AS n_nations, count(*) AS n_rows FROM customers GROUP BY 1")
def a6_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).groupBy("region").agg(F.count_distinct("unit").alias("n_units"), F.count_distinct("nation").alias("n_nations"), F.count(F.lit(1)).alias("n_rows"))
