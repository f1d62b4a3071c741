"""The roles that the star tables play, as relations and as the same SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded in the last step, so that summation order does not show. Adding 0 drops the sign of zero."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points: place, value, exceedance and class."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", (e(0) * 180).alias("lon"), (e(1) * 90).alias("lat"), e(2).alias("y"), e(3).alias("x1"), e(4).alias("x2"), (F.col("label") >= 5).cast("int").alias("hit"), "label")


POINTS = """points AS (
  SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 180 AS lon, CAST(embedding[2] AS DOUBLE) * 90 AS lat, CAST(embedding[3] AS DOUBLE) AS y,
         CAST(embedding[4] AS DOUBLE) AS x1, CAST(embedding[5] AS DOUBLE) AS x2, CAST(label >= 5 AS INTEGER) AS hit, label
  FROM embeddings)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a panel: the mean value of each user and day."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("unit"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


DAILY = "daily AS (SELECT user_id AS unit, CAST(ts AS DATE) AS day, avg(value) AS value, count(*) AS n FROM events GROUP BY 1, 2)"
#: About four fifths of the days of the event table.
CUTOFF = "2024-01-24"


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a calendar panel: the total price (in cents, so that sums are exact) of each nation and month, as YYYYMM."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    ym = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("ym")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("unit"), ym).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("value"))


MONTHLY = """monthly AS (
  SELECT c_nationkey AS unit, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS ym,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's nation and region: repeated readings of units that lie in regions."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    out = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return out.select("o_orderkey", F.col("o_custkey").alias("unit"), F.col("o_totalprice").cast("double").alias("y"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "o_orderstatus", "o_orderpriority")


CUSTOMERS = """customers AS (
  SELECT o_orderkey, o_custkey AS unit, CAST(o_totalprice AS DOUBLE) AS y, n_name AS nation, r_name AS region, o_orderstatus, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
