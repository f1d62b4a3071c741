"""Joins and set steps whose semantics need a decision: null keys, last rows, resumed work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outer_merge(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join on keys that may be NULL (NULL matches NULL); of columns that repeat, the first frame's stays."""

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        new = [c for c in b.columns if c not in a.columns]
        l, r = a.alias("l"), b.alias("r")
        on = reduce(lambda x, y: x & y, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys))
        old = [c for c in a.columns if c not in keys]
        return l.join(r, on, "full").select(*(F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys), *(f"l.{c}" for c in old), *(f"r.{c}" for c in new))

    return reduce(two, frames)


def left_attach(df: DataFrame, others: list[DataFrame], on: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "left"), others, df)


def not_yet_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key has no stored result; NULL keys are equal."""
    w, d = work.alias("w"), done.select(*keys).distinct().alias("d")
    on = reduce(lambda x, y: x & y, (F.col(f"w.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys))
    return w.join(d, on, "left_anti")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def grid(spark, axes: dict[str, list]) -> DataFrame:
    """Every combination of the listed parameter values, each once."""
    frames = []
    for name, values in axes.items():
        frames.append(spark.createDataFrame([(v,) for v in values], [name]))
    return reduce(lambda a, b: a.crossJoin(b), frames).dropDuplicates()


def to_long(df: DataFrame, keys: list[str], columns: list[str], variable: str, value: str) -> DataFrame:
    return df.unpivot(keys, columns, variable, value)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
