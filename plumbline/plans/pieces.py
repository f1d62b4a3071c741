"""Single steps of cleaning, folds, skill, contracts and ordering, each as a query of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import clean, skill
from plumbline.functions.draws import draw_sql, fold_of
from plumbline.operators import contracts, encode, folds, metrics
from plumbline.plans.tables import CUSTOMERS, POINTS, customers, points, registered, rounded, table


@registered("SELECT doc_id, lang, source FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND lang IS NOT NULL")
def p1_complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return encode.complete_rows(d, ["quality", "lang"]).select("doc_id", "lang", "source")


_ODD = "CASE WHEN l_linenumber = 1 THEN 'NaN'::DOUBLE WHEN l_linenumber = 2 THEN 'Infinity'::DOUBLE ELSE CAST(l_quantity AS DOUBLE) END"


@registered(f"WITH x AS (SELECT l_returnflag, {_ODD} AS q FROM lineitem) SELECT l_returnflag, count(*) AS n, count(q) FILTER (isfinite(q)) AS n_finite, round(avg(q) FILTER (isfinite(q)), 6) + 0 AS mean FROM x GROUP BY 1")
def p3_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") == 2, F.lit(float("inf"))).otherwise(F.col("l_quantity").cast("double"))
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", clean.finite(odd).alias("q"))
    return rounded(x.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("q").alias("n_finite"), F.avg("q").alias("mean")))


@registered("SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) AS brand, TRY_CAST(trim(p_name) AS DOUBLE) AS name FROM part")
def p4_lenient_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", clean.lenient_double(F.regexp_extract("p_brand", "[0-9]+", 0)).alias("brand"), clean.lenient_double(F.col("p_name")).alias("name"))


@registered("SELECT n_nationkey AS key, n_name AS nation, n_regionkey FROM nation")
def p7_rename_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.rename_present(table(spark, sf_dir, "nation"), {"n_nationkey": "key", "n_name": "nation", "n_comment": "absent"}).select("key", "nation", "n_regionkey")


@registered("SELECT doc_id, coalesce(CASE WHEN quality = 0 THEN 'poor' END, lang, source) AS word FROM documents LEFT JOIN labels USING (doc_id)")
def p8_first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("poor", F.when(F.col("quality") == 0, "poor"))
    return encode.first_valid(d, ["poor", "lang", "source", "none"], "word").select("doc_id", "word")


@registered("SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate']) AS feature")
def p14_features_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = encode.features_without(table(spark, sf_dir, "lineitem").columns, "L_EXTENDEDPRICE")
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@registered("SELECT n_name AS feature FROM nation WHERE n_regionkey = 1 AND n_name <> (SELECT min(n_name) FROM nation WHERE n_regionkey = 1)")
def p16_marked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = table(spark, sf_dir, "nation").withColumn("mark", F.when(F.col("n_regionkey") == 1, " X ").otherwise("-"))
    first = book.filter("n_regionkey = 1").agg(F.min("n_name")).first()[0]
    return spark.createDataFrame([(c,) for c in encode.marked_features(book, "n_name", "mark", [first])], "feature string")


@registered("SELECT o_orderkey, CAST(o_totalprice >= 250000 AS DOUBLE) AS hit FROM orders")
def p18_exceeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", clean.exceeds(F.col("o_totalprice").cast("double"), 250_000).alias("hit"))


@registered("SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'")
def p22_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter((F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-13")).select("event_id", F.to_date("ts").alias("day"))


@registered(f"""WITH {POINTS}, f AS (SELECT *, vec_id % 4 = 0 AS is_test FROM points), m AS (SELECT avg(y) AS m FROM f WHERE NOT is_test)
SELECT is_test, count(*) AS n, round(sqrt(avg((y - m) * (y - m))), 6) + 0 AS rmse FROM f, m GROUP BY 1""")
def f8_author_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("flag", F.when(F.col("vec_id") % 4 == 0, " Yes").when(F.col("vec_id") % 4 == 1, "no"))
    p = p.withColumn("is_test", folds.author_holdout(F.col("flag")))
    m = p.filter("not is_test").agg(F.avg("y").alias("m"))
    return rounded(p.join(m).groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), metrics.rmse("y", "m").alias("rmse")))  # one row


_CELL = "concat(CAST(CAST(floor(lon / CAST(45 AS DOUBLE)) AS BIGINT) AS VARCHAR), '_', CAST(CAST(floor(lat / CAST(45 AS DOUBLE)) AS BIGINT) AS VARCHAR))"


@registered(f"""WITH {POINTS}, k AS (SELECT greatest(5, count(*)) AS k FROM (SELECT {_CELL} AS b FROM points GROUP BY 1 HAVING count(*) >= 20))
SELECT CAST({draw_sql('vec_id', 3)} % k AS INTEGER) AS fold, count(*) AS n FROM points, k GROUP BY 1""")
def f16_matched_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    k = folds.matched_k(folds.eligible_folds(folds.with_block(p, "lon", "lat", 45), [], least=20))
    return folds.random_folds(p, "vec_id", k, 3).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@registered(f"""WITH {CUSTOMERS}, r AS (SELECT region, count(*) AS n, avg(y) AS m, stddev_samp(y) / sqrt(count(*)) AS se FROM customers
  GROUP BY 1), s AS (SELECT region, m - 2 * se AS lo, m, m + 2 * se AS hi FROM r),
k AS (SELECT count(*) AS a FROM (SELECT DISTINCT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation)), l AS (SELECT count(*) AS b
  FROM (SELECT n_nationkey FROM nation EXCEPT SELECT DISTINCT c_nationkey FROM customer)),
j AS (SELECT (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS b)
SELECT 'nation keys' AS "check", CASE WHEN a = 0 AND b = 0 THEN 'ok' ELSE 'failed' END AS status, concat_ws(' ', 'only left', a, 'only right',
  b) AS detail FROM k, l
UNION ALL SELECT 'discount', CASE WHEN count(*) FILTER (NOT coalesce(l_discount BETWEEN 0 AND 1, false)) = 0 THEN 'ok' ELSE 'failed' END,
  concat('violations ', count(*) FILTER (NOT coalesce(l_discount BETWEEN 0 AND 1, false))) FROM lineitem
UNION ALL SELECT 'mean inside', CASE WHEN count(*) FILTER (NOT (lo <= m AND m <= hi)) = 0 THEN 'ok' ELSE 'failed' END, concat('violations ',
  count(*) FILTER (NOT (lo <= m AND m <= hi))) FROM s
UNION ALL SELECT 'joined rows', CASE WHEN a = b THEN 'ok' ELSE 'failed' END, concat_ws(' ', 'rows', a, 'and', b) FROM j
UNION ALL SELECT 'quantity parts', CASE WHEN sum(CAST(l_quantity AS DOUBLE)) = (SELECT sum(CAST(l_quantity AS DOUBLE))
  FROM lineitem) THEN 'ok' ELSE 'failed' END, concat('sum ', CAST(sum(CAST(l_quantity AS DOUBLE)) AS BIGINT), '.0') FROM lineitem
  WHERE l_returnflag IS NOT NULL""")
def c6_more_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key sets, a predicate on every value, points inside intervals, row parity of a join, parts that add up to the whole."""
    t = lambda n: table(spark, sf_dir, n)
    r = customers(spark, sf_dir).groupBy("region").agg(F.avg("y").alias("m"), (F.stddev_samp("y") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    r = r.select("m", (F.col("m") - 2 * F.col("se")).alias("lo"), (F.col("m") + 2 * F.col("se")).alias("hi"))
    total = t("lineitem").agg(F.sum(F.col("l_quantity").cast("double"))).first()[0] or 0.0
    parts = t("lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("double")).alias("part"))
    report = contracts.report([
        contracts.same_keys(t("customer").select(F.col("c_nationkey").alias("k")).distinct(), t("nation").select(F.col("n_nationkey").alias("k")), "nation keys", ["k"]),
        contracts.every(t("lineitem"), "discount", F.col("l_discount").between(0, 1)), contracts.inside(r, "mean inside", "lo", "m", "hi"),
        contracts.same_count(t("orders"), t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")), "joined rows"),
    ])
    sums = contracts.parts_sum(parts, "quantity parts", "part", total)
    return report.unionByName(sums.withColumn("detail", F.concat(F.lit("sum "), F.regexp_extract("detail", r"[-0-9.E]+$", 0).cast("double").cast("long"), F.lit(".0"))))


@registered("SELECT doc_id FROM documents ANTI JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id)")
def c11_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that nobody has labelled."""
    have = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return contracts.missing_keys(table(spark, sf_dir, "documents").select("doc_id"), have, "doc_id")


_SKILL = f"""{CUSTOMERS}, f AS (SELECT region, CAST({draw_sql('o_orderkey', 8)} % 5 AS INTEGER) = 0 AS is_test, y / 100000 AS v
  FROM customers), m AS (SELECT region, avg(v) AS m FROM f WHERE NOT is_test GROUP BY 1), o AS (SELECT avg(v) AS o FROM f WHERE NOT is_test),
e AS (SELECT region, v, m, o FROM f JOIN m USING (region), o WHERE is_test)"""


@registered(f"""WITH {_SKILL} SELECT region, round(greatest(0.0, 1 - sum((v - m) * (v - m)) / (var_pop(v) * count(*))), 6) + 0 AS floored_skill,
  round(1 - sum((v - m) * (v - m)) / (var_pop(v) * count(*)), 6) + 0 AS r2,
round(1 - sqrt(avg((v - m) * (v - m))) / sqrt(avg((v - o) * (v - o))), 6) + 0 AS rmse_skill FROM e GROUP BY 1""")
def m8_skill_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 of the regions' means, floored and not, and their RMSE skill against the overall mean."""
    c = customers(spark, sf_dir).select("region", (fold_of(F.col("o_orderkey"), 5, 8) == 0).alias("is_test"), (F.col("y") / 100000).alias("v"))
    tr = c.filter("not is_test")
    e = c.filter("is_test").join(tr.groupBy("region").agg(F.avg("v").alias("m")), "region").join(tr.agg(F.avg("v").alias("o")))  # one row
    k = e.groupBy("region").agg(metrics.r2("v", "m").alias("r2"), metrics.rmse("v", "m").alias("a"), metrics.rmse("v", "o").alias("b"))
    return rounded(k.select("region", skill.skill(F.col("r2"), floor=True).alias("floored_skill"), "r2", skill.rmse_skill(F.col("a"), F.col("b")).alias("rmse_skill")))


@registered("SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def j13_columns_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of two tables side by side: by their key, since relations have no row order."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@registered("SELECT n_regionkey, n_name, CAST(row_number() OVER (ORDER BY n_regionkey DESC, n_name) AS BIGINT) AS place FROM nation")
def o1_ordered_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in the order of several keys, with its place so that the order shows."""
    from plumbline.operators.ranking import row_rank

    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_name").withColumn("_k", -F.col("n_regionkey"))
    return row_rank(n, [], "_k", ["n_name"], "place").select("n_regionkey", "n_name", F.col("place").cast("long").alias("place")).orderBy("place")


@registered(f"""WITH {CUSTOMERS}, s AS (SELECT region, o_orderstatus, avg(y) / 100000 AS v FROM customers
  GROUP BY 1, 2), w AS (SELECT region, max(v) FILTER (o_orderstatus = 'F') AS f, max(v) FILTER (o_orderstatus = 'O') AS o FROM s GROUP BY 1)
SELECT region, round(o - f, 6) + 0 AS delta FROM w ORDER BY o - f, region LIMIT 1""")
def o2_worst_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group whose score falls most from one setting to the other."""
    c = customers(spark, sf_dir)
    v = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("y"))) / 100000
    d = c.groupBy("region").agg((v("O") - v("F")).alias("delta"))
    return rounded(d.agg(F.min_by(F.struct("region", "delta"), F.struct("delta", "region")).alias("w")).select("w.*"))
