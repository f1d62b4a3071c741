"""Round trips through readers and sinks: a table is written to the shared folder in some form and read back.

The files stay in the shared folder, since the result reads them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import shared
from plumbline.plans.tables import registered, table
from plumbline.sources import readers, sinks


def _place(spark: SparkSession, what: str) -> str:
    return f"{shared.folder(spark)}/{what}-{uuid.uuid4().hex}"


@registered("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s1_csv_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a CSV file are found by the header, whatever their order; more columns do not matter."""
    path = _place(spark, "s1")
    sinks.write_table(table(spark, sf_dir, "nation").select(F.lit("x").alias("more"), "n_regionkey", "n_name", "n_nationkey"), path, "csv")
    return readers.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int, n_absent double", ["n_nationkey", "n_name", "n_regionkey"])


@registered("SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_acctbal AS DOUBLE) END AS s_acctbal FROM supplier")
def s2_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tab-separated file; NaN becomes NULL."""
    path = _place(spark, "s2")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal").cast("double")).alias("s_acctbal"))
    s.write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_csv(spark, path, "s_suppkey bigint, s_acctbal double", sep="\t")


@registered("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def s4_csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "s4")
    sinks.write_table(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, "csv")
    return readers.read_csv_text(spark, path)


@registered("SELECT r_regionkey, r_name, true AS named FROM region")
def s6_csv_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by a pattern, without those of another; each row knows its file."""
    path = _place(spark, "s6")
    sinks.write_table(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), path, "csv")
    got = readers.read_csv_glob(spark, path, "part-*.csv", ["_skip_"], "r_regionkey int, r_name string")
    return got.select("r_regionkey", "r_name", F.col("source_file").startswith("part-").alias("named"))


@registered("SELECT user_id, ts, value FROM events")
def s7_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "s7")
    sinks.write_table(table(spark, sf_dir, "events"), path)
    return readers.read_panel(spark, path, ["user_id", "ts", "value"])


@registered("SELECT n_name, CAST(n_nationkey AS DOUBLE) AS v FROM nation")
def s12_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file with lines above its header."""
    path = _place(spark, "s12")
    n = table(spark, sf_dir, "nation").select(F.concat_ws(",", "n_name", F.col("n_nationkey").cast("string")).alias("line"), (F.col("n_nationkey") + 3).alias("at"))
    head = spark.createDataFrame([("made by someone", 0), ("on a day, in a place", 1), ("Nation,v", 2)], "line string, at int")
    head.unionByName(n).coalesce(1).sortWithinPartitions("at").select("line").write.text(path)
    return readers.read_csv_with_preamble(spark, path, "Nation", "n_name string, v double")


@registered("SELECT CASE WHEN n_regionkey < 2 THEN 'monthly' ELSE 'daily' END AS frequency, n_name AS well, 'h1' AS horizon, n_nationkey / CAST(10 AS DOUBLE) AS persist, CAST(n_regionkey AS DOUBLE) AS ridge, CAST(n_nationkey AS BIGINT) AS n_test FROM nation")
def s14_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document of lists of wells with a record per horizon, as rows."""
    path = _place(spark, "s14")
    rec = F.struct((F.col("n_nationkey") / F.lit(10.0)).alias("persist"), F.col("n_regionkey").cast("double").alias("ridge"), F.col("n_nationkey").alias("n_test"))
    w = F.struct(F.col("n_name").alias("well"), rec.alias("h1"))
    one = table(spark, sf_dir, "nation").agg(F.collect_list(F.when(F.col("n_regionkey") < 2, w)).alias("monthly"), F.collect_list(F.when(F.col("n_regionkey") >= 2, w)).alias("daily"))  # 25 rows
    one.select(F.to_json(F.struct("monthly", "daily")).alias("value")).write.text(path)
    return readers.read_horizons(spark, path, ["monthly", "daily"], ["h1", "h7"]).select("frequency", "well", "horizon", "persist", "ridge", "n_test")


@registered("SELECT n_name AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation")
def s15_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "s15")
    one = table(spark, sf_dir, "nation").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("int")))).alias("m"))  # 25 rows
    one.select(F.to_json("m").alias("value")).write.text(path)
    return readers.read_mirror(spark, path)


@registered("SELECT region, n, CASE WHEN region = 0 THEN 'second' ELSE 'first' END AS run FROM (SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1)")
def s18_units_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store by unit: a second run replaces its own units only."""
    path = _place(spark, "s18")
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("n"))
    sinks.write_units(n.withColumn("run", F.lit("first")), path, ["region"])
    sinks.write_units(n.filter("region = 0").withColumn("run", F.lit("second")), path, ["region"])
    return sinks.stored(spark, path, "n long, run string, region int").select("region", "n", "run")


@registered("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 1")
def s19_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that a store does not hold yet."""
    path = _place(spark, "s19")
    work = table(spark, sf_dir, "customer").select("c_custkey")
    sinks.write_table(work.filter("c_custkey % 3 = 1"), path)
    return sinks.resume(work, path, "c_custkey long", ["c_custkey"])


@registered("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS run FROM orders")
def s22_merge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    old = o.withColumns({"run": F.lit("old"), "seq": F.lit(1)})
    return sinks.merge_results(old, o.filter("o_orderkey % 2 = 0").withColumns({"run": F.lit("new"), "seq": F.lit(2)}), ["o_orderkey"], "seq").select("o_orderkey", "run")


@registered("SELECT unnest(['a', 'b', 'gone']) AS path, unnest(['ok', 'changed', 'missing']) AS status")
def s24_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files against a manifest of hashes: one as it was, one changed, one gone."""
    path = _place(spark, "s24")
    for name in ("a", "b"):
        table(spark, sf_dir, "region").select("r_name").coalesce(1).write.text(f"{path}/{name}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter("path like '%.txt'")
    have = files.select(F.regexp_extract("path", r"([ab]/[^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("sha256"))
    m = have.withColumn("sha256", F.when(F.col("path").startswith("a"), F.col("sha256")).otherwise(F.lit("0"))).unionAll(spark.createDataFrame([("gone", "1")], "path string, sha256 string"))
    return readers.verify_manifest(spark, path, m).select(F.substring_index("path", "/", 1).alias("path"), "status")
