"""Contracts: checks that return a relation (check, status, detail) instead of stopping the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _verdict(df: DataFrame, name: str, ok: Column, detail: Column) -> DataFrame:
    good = F.coalesce(ok, F.lit(False))
    return df.select(F.lit(name).alias("check"), F.when(good, "ok").otherwise("failed").alias("status"), detail.cast("string").alias("detail"))


def row_count(df: DataFrame, name: str, n: int, where: Column | None = None) -> DataFrame:
    c = df.agg((F.count_if(where) if where is not None else F.count(F.lit(1))).alias("n"))
    return _verdict(c, name, F.col("n") == n, F.concat(F.lit("rows "), F.col("n"), F.lit(f" expected {n}")))


def unique(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Duplicates are counted by an aggregate on the keys, not by one global distinct."""
    d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1).alias("d"))
    return _verdict(d, name, F.col("d") == 0, F.concat(F.lit("repeated keys "), F.col("d")))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def every(df: DataFrame, name: str, predicate: Column) -> DataFrame:
    """NULL counts as a violation; an empty table passes."""
    v = df.agg(F.count_if(~F.coalesce(predicate, F.lit(False))).alias("v"))
    return _verdict(v, name, F.col("v") == 0, F.concat(F.lit("violations "), F.col("v")))


def forbidden_columns(df: DataFrame, name: str, names: list[str]) -> DataFrame:
    found = sorted({c.lower() for c in df.columns} & {n.lower() for n in names})
    one = df.sparkSession.range(1)
    return _verdict(one, name, F.lit(not found), F.lit("found " + ",".join(found) if found else "none"))


def same_keys(a: DataFrame, b: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Multisets of keys are equal."""
    only_a, only_b = a.select(*keys).exceptAll(b.select(*keys)), b.select(*keys).exceptAll(a.select(*keys))
    both = only_a.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(only_b.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    c = both.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    return _verdict(c, name, (F.col("a") == 0) & (F.col("b") == 0), F.concat_ws(" ", F.lit("only left"), F.col("a"), F.lit("only right"), F.col("b")))


def same_count(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Two stores of one result hold as many rows."""
    n = a.agg(F.count(F.lit(1)).alias("a")).join(b.agg(F.count(F.lit(1)).alias("b")))  # one row each
    return _verdict(n, name, F.col("a") == F.col("b"), F.concat_ws(" ", F.lit("rows"), F.col("a"), F.lit("and"), F.col("b")))


def drift(now: DataFrame, stored: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """(keys, now, stored, diff, status): ok, drifted, missing or new."""
    a, b = now.select(*keys, F.col(value).cast("double").alias("now")), stored.select(*keys, F.col(value).cast("double").alias("stored"))
    out = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), keys, "full")
    diff = F.abs(F.col("now") - F.col("stored"))
    same = (F.col("now").isNull() & F.col("stored").isNull()) | (diff <= tolerance)
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "new").when(F.coalesce(same, F.lit(False)), "ok").otherwise("drifted")
    return out.select(*keys, "now", "stored", diff.alias("diff"), status.alias("status"))


def largest_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(n_matched, max_abs_diff) of two runs."""
    d = F.abs(F.col("a") - F.col("b"))
    return a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys).agg(F.count(F.lit(1)).alias("n_matched"), F.max(d).alias("max_abs_diff"))


def missing_cells(df: DataFrame, levels: dict[str, list]) -> DataFrame:
    """Combinations of the listed levels that the table lacks; the grid is as large as the lists say."""
    spark, grid = df.sparkSession, None
    for c, values in levels.items():
        one = spark.createDataFrame([(v,) for v in values], f"{c} {dict(df.dtypes)[c]}")
        grid = one if grid is None else grid.crossJoin(one)
    return grid.join(df.select(*levels).distinct(), list(levels), "left_anti")


def missing_keys(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return required.join(present, key, "left_anti")


def inside(df: DataFrame, name: str, lo: str, point: str, hi: str) -> DataFrame:
    return every(df, name, (F.col(lo) <= F.col(point)) & (F.col(point) <= F.col(hi)))


def parts_sum(df: DataFrame, name: str, part: str, total: float) -> DataFrame:
    s = df.agg(F.coalesce(F.sum(part), F.lit(0)).cast("double").alias("s"))
    return _verdict(s, name, F.col("s") == total, F.concat(F.lit("sum "), F.col("s")))


def report(checks: list[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
