"""Cleaning, encoding, screening, joins and set steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import clean
from plumbline.operators import encode, learners, relational
from plumbline.plans.tables import CUSTOMERS, POINTS, customers, points, registered, rounded, table


@registered("""WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN concat('<', CAST(l_quantity AS INTEGER)) WHEN 1 THEN concat('> ',
  CAST(l_quantity AS INTEGER)) WHEN 2 THEN concat('1,', lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 3,
  '0')) WHEN 3 THEN 'NC' ELSE '-' END AS raw, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS q FROM lineitem)
SELECT raw, round(max(CASE l_linenumber % 5 WHEN 0 THEN q / 2 WHEN 1 THEN q WHEN 2 THEN 1000 + q END), 6) + 0 AS parsed, count(*) AS n FROM t
  GROUP BY 1""")
def p5_censored_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, m = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 5
    raw = F.when(m == 0, F.concat(F.lit("<"), q)).when(m == 1, F.concat(F.lit("> "), q)).when(m == 2, F.concat(F.lit("1,"), F.lpad(q, 3, "0"))).when(m == 3, "NC").otherwise("-")
    t = table(spark, sf_dir, "lineitem").select(raw.alias("raw"))
    return rounded(t.groupBy("raw").agg(F.max(clean.censored_double(F.col("raw"))).alias("parsed"), F.count(F.lit(1)).alias("n")))


@registered("SELECT c_mktsegment, count(*) AS n, count(nullif(c_nationkey, 7)) AS n_known, round(avg(nullif(CAST(c_nationkey AS DOUBLE), 7)), 6) + 0 AS mean_known FROM customer GROUP BY 1")
def p2_sentinel_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = clean.finite(clean.sentinel_to_null(F.col("c_nationkey").cast("double"), 7.0))
    c = table(spark, sf_dir, "customer").select("c_mktsegment", x.alias("x"))
    return rounded(c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("n_known"), F.avg("x").alias("mean_known")))


@registered("SELECT DISTINCT p_name, regexp_replace(trim(p_name), '\\s+', ' ', 'g') AS squeezed, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS token, concat(trim(p_brand), '||', trim(p_type)) AS key FROM part")
def p9_names_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name", clean.squeeze(F.col("p_name")).alias("squeezed"), clean.name_token(F.col("p_brand")).alias("token"), clean.composite_key(F.col("p_brand"), F.col("p_type")).alias("key")).distinct()


@registered("SELECT year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, make_date(year(o_orderdate), month(o_orderdate), 15) AS mid, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def p6_mid_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    return o.groupBy("y", "m", clean.mid_month(F.col("y"), F.col("m")).alias("mid")).agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT CAST(sum(CAST(o_orderstatus = 'F' AS INTEGER)) AS BIGINT) AS f, CAST(sum(CAST(o_orderstatus = 'O' AS INTEGER)) AS BIGINT) AS o, CAST(sum(CAST(o_orderstatus = 'P' AS INTEGER)) AS BIGINT) AS p, count(*) FILTER (o_orderstatus IS NULL) AS na FROM orders")
def p11_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = encode.one_hot(table(spark, sf_dir, "orders").select("o_orderstatus"), "o_orderstatus", ["F", "O", "P"])
    return h.agg(*(F.sum(f"o_orderstatus_{c}").alias(n) for c, n in (("F", "f"), ("O", "o"), ("P", "p"), ("NA", "na"))))


@registered("""WITH p AS (SELECT vec_id, CAST(embedding[1:4] AS DOUBLE[]) AS s FROM embeddings)
SELECT concat('e', list_position(s, list_max(s)) - 1) AS level, count(*) AS n FROM p WHERE list_max(s) > 0 GROUP BY 1""")
def p13_idxmax_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(*(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(4)))
    return encode.one_hot_decode(e, ["e0", "e1", "e2", "e3"], "level").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT 'n' AS side, n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT 'n', n_regionkey, concat('R', n_name) FROM nation")
def p12_stack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "nation").select(F.lit("n").alias("side"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("key.1"), F.concat(F.lit("R"), "n_name").alias("name.1"))
    return encode.stack_blocks(wide, ["side"])


@registered("SELECT * FROM (VALUES ('l_orderkey', false, 'structural'), ('l_partkey', true, NULL), ('l_suppkey', true, NULL), ('l_linenumber', false, 'structural'), ('l_quantity', true, NULL), ('l_extendedprice', false, 'target'), ('l_discount', false, 'derivative'), ('l_tax', true, NULL), ('l_returnflag', true, NULL), ('l_linestatus', true, NULL), ('l_shipdate', true, NULL)) AS t(\"column\", kept, reason)")
def p15_leakage_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.leakage_relation(table(spark, sf_dir, "lineitem"), "l_extendedprice", {"l_extendedprice": ["discount"]}, ["l_orderkey", "l_linenumber"])


@registered("""WITH t AS (SELECT CASE WHEN l_linenumber = 1 THEN l_tax END AS sparse, CAST(1 AS INTEGER) AS constant, l_quantity AS dense FROM lineitem)
SELECT 'sparse' AS feature, round(avg(CAST(sparse IS NULL AS INTEGER)), 6) + 0 AS missing_share, count(DISTINCT sparse) AS n_distinct,
  avg(CAST(sparse IS NULL AS INTEGER)) <= 0.8 AND count(DISTINCT sparse) >= 2 AS kept FROM t
UNION ALL SELECT 'constant', round(avg(CAST(constant IS NULL AS INTEGER)), 6) + 0, count(DISTINCT constant),
  avg(CAST(constant IS NULL AS INTEGER)) <= 0.8 AND count(DISTINCT constant) >= 2 FROM t
UNION ALL SELECT 'dense', round(avg(CAST(dense IS NULL AS INTEGER)), 6) + 0, count(DISTINCT dense),
  avg(CAST(dense IS NULL AS INTEGER)) <= 0.8 AND count(DISTINCT dense) >= 2 FROM t""")
def p17_feature_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") == 1, F.col("l_tax")).alias("sparse"), F.lit(1).alias("constant"), F.col("l_quantity").alias("dense"))
    return rounded(encode.feature_screen(t, ["sparse", "constant", "dense"]))


@registered(f"""WITH {POINTS}, t AS (SELECT label, count(*) AS n, CAST(sum(CAST(y >= 0.1 AS INTEGER)) AS BIGINT) AS n_pos FROM points
  GROUP BY 1), w AS (SELECT *, n - n_pos AS n_neg,
  CASE WHEN n < 45 THEN 'too few rows' WHEN n_pos < 9 THEN 'too few positives' WHEN n - n_pos < 5 THEN 'too few negatives' END AS reason FROM t)
SELECT label, n, n_pos, n_neg, CASE WHEN reason IS NULL THEN 'ok' ELSE 'skipped' END AS status, reason FROM w""")
def p19_screen_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("over", clean.exceeds(F.col("y"), 0.1))
    return encode.screen_status(p, ["label"], "over", 45, 9, 5)


@registered(f"""WITH {POINTS}, h AS (SELECT vec_id, CASE WHEN label = 3 THEN NULL ELSE x1 END AS x1, x2
  FROM points), m AS (SELECT coalesce(median(x1), 0) AS m1, coalesce(median(x2), 0) AS m2 FROM h),
f AS (SELECT vec_id, coalesce(x1, m1) AS x1, coalesce(x2, m2) AS x2 FROM h, m), s AS (SELECT avg(x1) AS a1, stddev_pop(x1) AS s1, avg(x2) AS a2,
  stddev_pop(x2) AS s2 FROM f)
SELECT vec_id, round((x1 - a1) / (s1 + 1e-8), 6) + 0 AS x1, round((x2 - a2) / (s2 + 1e-8), 6) + 0 AS x2 FROM f, s""")
def p23_impute_and_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = points(spark, sf_dir).select("vec_id", F.when(F.col("label") != 3, F.col("x1")).alias("x1"), "x2")
    return rounded(learners.standardise(learners.median_impute(h, "", ["x1", "x2"]), ["x1", "x2"]))


@registered(f"WITH {POINTS} SELECT vec_id, round(x1, 6) + 0 AS x1, round(x2, 6) + 0 AS x2, round(x1 * x1, 6) + 0 AS x1_x1, round(x1 * x2, 6) + 0 AS x1_x2, round(x2 * x2, 6) + 0 AS x2_x2 FROM points")
def p25_polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points(spark, sf_dir).select("vec_id", *(c.alias(n.replace("*", "_")) for n, c in learners.polynomial(["x1", "x2"]).items())))


@registered("SELECT o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS idx, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def p26_label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return encode.label_index(n, "o_orderpriority", "idx")


@registered("""WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_nationkey < 15
  GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_nationkey > 5
  GROUP BY 1), c AS (SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey > 2)
SELECT coalesce(a.k, b.k, c.k) AS k, customers, suppliers, n_name FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k FULL
  JOIN c ON coalesce(a.k, b.k) IS NOT DISTINCT FROM c.k""")
def j2_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").filter("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, sf_dir, "supplier").filter("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = table(spark, sf_dir, "nation").filter("n_nationkey > 2").select(F.col("n_nationkey").alias("k"), "n_name")
    return relational.outer_merge([a, b, c], ["k"])


@registered("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1")
def j8_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_orderpriority = '1-URGENT' AND d.o_custkey IS NOT DISTINCT FROM o.o_custkey AND d.o_orderstatus IS NOT DISTINCT FROM o.o_orderstatus) GROUP BY 1, 2")
def j9_resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    left = relational.not_yet_done(o, o.filter("o_orderpriority = '1-URGENT'"), ["o_custkey", "o_orderstatus"])
    return left.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def o7_dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.keep_last(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@registered("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def o9_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@registered("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def o10_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).subtract(rich)


@registered("SELECT c_nationkey AS k, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS s_name FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey, s_acctbal, s_name FROM supplier WHERE s_acctbal < 0")
def o5_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("balance"), "s_name")
    return relational.union_all([c, s])


@registered("SELECT region, variable, CAST(value AS BIGINT) AS value FROM (SELECT r_name AS region, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1) UNPIVOT (value FOR variable IN (building, machinery))")
def d3_wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    wide = j.groupBy(F.col("r_name").alias("region")).agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("machinery"))
    return relational.to_long(wide, ["region"], ["building", "machinery"], "variable", "value")


@registered(f"WITH {CUSTOMERS}, f AS (SELECT nation, median(y) AS m FROM customers GROUP BY 1), g AS (SELECT region, median(y) AS gm FROM customers GROUP BY 1) SELECT DISTINCT nation, c.region, round(m / 1000, 6) + 0 AS m, round(gm / 1000, 6) + 0 AS gm FROM customers c JOIN f USING (nation) LEFT JOIN g ON c.region = g.region")
def j3_attach_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    per = c.groupBy("nation", "region").agg((F.median("y") / 1000).alias("m"))
    return rounded(relational.left_attach(per, [c.groupBy("region").agg((F.median("y") / 1000).alias("gm"))], ["region"]))
