"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.shared import drop, scratch, written


#: A key with more than this share of a table's rows is joined by broadcast; there are at most 1 / HOT such keys.
HOT = 1 / 1024
#: Edge tables smaller than this have no key that needs it.
HOT_FROM = 1_000_000


def attach(left: DataFrame, right: DataFrame, key: str, n: int) -> DataFrame:
    """Left join on ``key`` (unique in ``right``) of a table of n rows, however its keys are distributed.

    Rows of a hot key stay where they are: those keys - a bounded number - are looked up and broadcast. Rows with a null key
    match nothing and are not shuffled either.
    """
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = [r[0] for r in counts.filter(F.col("n") > max(n * HOT, 64)).select(key).collect()]
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name != key]
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    names = [*left.columns, *(f for f in right.columns if f != key)]
    rest = left.filter(F.col(key).isNotNull() & ~is_hot).join(right, key, "left").select(names)
    out = rest.unionAll(left.filter(F.col(key).isNull()).select(*left.columns, *added))
    if hot:
        out = out.unionAll(left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, "left").select(names))
    return out


def _inner(left: DataFrame, right: DataFrame, key: str, n: int) -> DataFrame:
    """Join of edges with a value of each node; every node of ``left`` has one."""
    return left.join(right, key) if n < HOT_FROM else attach(left, right, key, n)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of its neighbours and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _inner(both, least, "a", 2 * n).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = _inner(edges, least, "a", n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).filter("a <> b")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of every node of the edge table (a long, b long); component is its smallest node.

    Each round is written to the shared folder. Loops and repeated edges do not matter; nodes without an edge
    to another node are not returned; an empty table gives an empty one. The number of rounds grows with the
    logarithm of the longest path.
    """
    spark = edges.sparkSession
    with scratch(spark) as rounds:
        now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        before, n = None, edges.count()
        for _ in range(most):
            large = _large_star(now, n).distinct()
            if n >= HOT_FROM:  # looked at twice
                large = written(large, "large-star")
            now = written(_small_star(large, n).distinct(), "star")
            mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
            drop(spark, rounds[:-1])
            del rounds[:-1]
            if mark == before or mark["n"] == 0:
                break
            before, n = mark, mark["n"]
        else:
            raise RuntimeError(f"components did not settle in {most} rounds")
        now = written(now, "components", hold=True)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
