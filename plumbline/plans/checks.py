"""Contracts, drift and whole tables of recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.draws import draw_sql, fold_of
from plumbline.operators import baselines, contracts, metrics, summary
from plumbline.plans.tables import CUSTOMERS, customers, registered, rounded, table


@registered("""SELECT 'nations' AS "check", CASE WHEN count(*) = 25 THEN 'ok' ELSE 'failed' END AS status, concat('rows ', count(*), ' expected 25') AS detail
  FROM nation
UNION ALL SELECT 'order key', CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'ok' ELSE 'failed' END, concat('repeated keys ', (SELECT count(*)
  FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))) FROM orders
UNION ALL SELECT 'price', CASE WHEN count(*) FILTER (NOT coalesce(o_totalprice > 0, false)) = 0 THEN 'ok' ELSE 'failed' END, concat('violations ',
  count(*) FILTER (NOT coalesce(o_totalprice > 0, false))) FROM orders
UNION ALL SELECT 'no comments', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'failed' END,
  CASE WHEN count(*) = 0 THEN 'none' ELSE concat('found ', string_agg(lower(column_name), ',' ORDER BY lower(column_name))) END FROM (DESCRIBE orders)
  WHERE lower(column_name) IN ('o_comment', 'o_clerk')
UNION ALL SELECT 'no prices', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'failed' END,
  CASE WHEN count(*) = 0 THEN 'none' ELSE concat('found ', string_agg(lower(column_name), ',' ORDER BY lower(column_name))) END FROM (DESCRIBE orders)
  WHERE lower(column_name) IN ('o_totalprice', 'o_clerk')
UNION ALL SELECT 'status parts', CASE WHEN sum(n) = (SELECT count(*) FROM orders) THEN 'ok' ELSE 'failed' END, concat('sum ',
  CAST(CAST(sum(n) AS DOUBLE) AS VARCHAR)) FROM (SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1)""")
def c1_contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation")
    parts = o.filter("o_orderstatus is not null").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("part"))
    return contracts.report([
        contracts.row_count(n, "nations", 25), contracts.unique(o, "order key", ["o_orderkey"]), contracts.every(o, "price", F.col("o_totalprice") > 0),
        contracts.forbidden_columns(o, "no comments", ["o_comment", "o_clerk"]), contracts.forbidden_columns(o, "no prices", ["o_totalprice", "o_clerk"]),
        contracts.parts_sum(parts, "status parts", "part", float(o.count())),
    ])


_TWO_RUNS = f"""{CUSTOMERS}, a AS (SELECT nation, avg(y) / 100000 AS v FROM customers WHERE o_orderstatus <> 'P' AND nation <> 'NATION_3'
  GROUP BY 1), b AS (SELECT nation, avg(y) / 100000 AS v FROM customers WHERE nation <> 'NATION_4' GROUP BY 1)"""


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = customers(spark, sf_dir)
    mean = (F.avg("y") / 100000).alias("v")
    return c.filter("o_orderstatus <> 'P' AND nation <> 'NATION_3'").groupBy("nation").agg(mean), c.filter("nation <> 'NATION_4'").groupBy("nation").agg(mean)


@registered(f"""WITH {_TWO_RUNS} SELECT nation, round(a.v, 6) + 0 AS now, round(b.v, 6) + 0 AS stored, round(abs(a.v - b.v), 6) + 0 AS diff,
CASE WHEN a.v IS NULL THEN 'missing' WHEN b.v IS NULL THEN 'new' WHEN abs(a.v - b.v) <= 0.02 THEN 'ok' ELSE 'drifted' END AS status FROM a FULL
  JOIN b USING (nation)""")
def c7_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, stored = _two_runs(spark, sf_dir)
    return rounded(contracts.drift(now, stored, ["nation"], "v", 0.02))


@registered(f"WITH {_TWO_RUNS} SELECT count(*) AS n_matched, round(max(abs(a.v - b.v)), 6) + 0 AS max_abs_diff FROM a JOIN b USING (nation)")
def c12_largest_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(contracts.largest_difference(*_two_runs(spark, sf_dir), ["nation"], "v"))


@registered("SELECT s AS o_orderstatus, p AS o_orderpriority FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS s), (SELECT unnest(['1-URGENT', '5-LOW', '9-NEVER']) AS p) EXCEPT SELECT o_orderstatus, o_orderpriority FROM orders")
def c8_grid_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.missing_cells(table(spark, sf_dir, "orders"), {"o_orderstatus": ["F", "O", "P", "X"], "o_orderpriority": ["1-URGENT", "5-LOW", "9-NEVER"]})


@registered("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def o8_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.duplicates(table(spark, sf_dir, "orders"), ["o_custkey"])


@registered(f"""WITH {CUSTOMERS}, f AS (SELECT *, CAST({draw_sql('o_orderkey', 8)} % 12 AS INTEGER) AS fold, y / 100000 AS v FROM customers),
k AS (SELECT region, fold, avg(v) AS base, median(v) AS model FROM f GROUP BY 1, 2), m AS (SELECT region, count(*) AS n, median(model) AS m,
  median(base) AS b FROM k GROUP BY 1)
SELECT region, n, round(m, 6) + 0 AS model_skill, round(b, 6) + 0 AS baseline_skill, round(m - b, 6) + 0 AS increment,
  round(CASE WHEN m > 0 THEN 100 * b / m END, 4) + 0 AS recovery_pct FROM m""")
def q1_recovery_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir).select("region", fold_of(F.col("o_orderkey"), 12, 8).alias("fold"), (F.col("y") / 100000).alias("v"))
    scores = c.groupBy("region", "fold").agg(F.avg("v").alias("base"), F.median("v").alias("model"))
    out = rounded(summary.recovery_table(scores, ["region"], "model", "base").withColumn("recovery_pct", F.round("recovery_pct", 4)))
    return out
