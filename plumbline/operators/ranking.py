"""Ranks and running sums over a whole table or large groups, without one task per group.

A window over a group sorts that group in one task. Here each group is first
cut into ranges of its order column at approximate quantiles; windows run
inside the ranges, and the ranges' totals (at most COARSE * MOST_FINE rows a
group) give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.shared import written

#: A group is cut into COARSE * FINE ranges at least; so many rows a range are aimed at beyond that.
COARSE, MOST_FINE, RANGE_ROWS = 16, 256, 4_000_000


def _ranged(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``_range``: how many of the group's quantiles lie below the order column. The number of ranges follows the rows."""
    fine = min(MOST_FINE, max(4, -(-df.count() // (COARSE * RANGE_ROWS))))
    n = COARSE * fine
    cuts = F.percentile_approx(order, [i / n for i in range(1, n)], 20 * n)
    bounds = df.groupBy(*keys).agg(cuts.alias("_cuts"))
    bounds = bounds.withColumn("_coarse", F.transform(F.sequence(F.lit(1), F.lit(COARSE - 1)), lambda i: F.get("_cuts", i * fine - 1)))
    cond = [df[k].eqNullSafe(bounds[k]) for k in keys]
    joined = df.join(bounds, cond, "left") if keys else df.join(bounds)
    for k in keys:
        joined = joined.drop(bounds[k])
    below = lambda c: c < F.col(order)
    joined = joined.withColumn("_first", F.size(F.filter("_coarse", below)) * fine)  # all cuts before this one are below
    inner = F.size(F.filter(F.slice("_cuts", F.col("_first") + 1, F.lit(fine)), below))
    return joined.withColumn("_range", F.col("_first") + inner).drop("_cuts", "_coarse", "_first")


def running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """One row per group and distinct value of ``order``: each sum at the value, and ``<name>_below`` over smaller values.

    Rows with a NULL order value are left out.
    """
    at = df.filter(F.col(order).isNotNull()).groupBy(*keys, order).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    at = _ranged(at, keys, order)
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = at.groupBy(*keys, "_range").agg(*(F.sum(n).alias(f"_t_{n}") for n in sums))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "_range", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums))
    at = at.select("*", *(F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_i_{n}") for n in sums))
    at, ranges = at.alias("a"), ranges.alias("r")
    cond = F.col("a._range") == F.col("r._range")
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"r.{k}"))
    below = [(F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(f"{n}_below") for n in sums]
    return at.join(ranges, cond).select(*(f"a.{k}" for k in keys), f"a.{order}", *sums, *below)


def quantiles(df: DataFrame, keys: list[str], x: str, qs: list[float]) -> DataFrame:
    """(keys, n, q): exact quantiles of x in the order asked for, between neighbours in proportion; NULLs do not count.

    They are read off the running counts of the distinct values, so no task holds a group. The rows are written once.
    """
    df = written(df.select(*keys, F.col(x).cast("double").alias("_x")).filter(F.col("_x").isNotNull()), "quantiles")
    at = running_sums(df, keys, "_x", {"_n": F.lit(1)})
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    t = total.withColumnsRenamed({k: f"_t_{i}" for i, k in enumerate(keys)})
    cond = [F.col(k).eqNullSafe(F.col(f"_t_{i}")) for i, k in enumerate(keys)]
    both = at.join(t, cond) if keys else at.join(t)
    at_rank = lambda r: F.max(F.when((F.col("_n_below") <= r) & (r < F.col("_n_below") + F.col("_n")), F.col("_x")))
    aggs = []
    for i, q in enumerate(qs):
        h = (F.col("n") - 1) * F.lit(float(q))
        aggs += [at_rank(F.floor(h)).alias(f"_lo{i}"), at_rank(F.ceil(h)).alias(f"_hi{i}"), F.max(h - F.floor(h)).alias(f"_w{i}")]
    out = both.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    return out.select(*keys, "n", F.array(*(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}") for i in range(len(qs)))).alias("q"))


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds the 1-based rank of ``value`` in its group; equal values share their mean rank, NULLs get NULL."""
    at = running_sums(df, keys, value, {"_n": F.lit(1)}).alias("r")
    cond = F.col(f"d.{value}") == F.col(f"r.{value}")
    for k in keys:
        cond = cond & F.col(f"d.{k}").eqNullSafe(F.col(f"r.{k}"))
    rank = (F.col("r._n_below") + (F.col("r._n") + 1) / F.lit(2.0)).alias(name)
    return df.alias("d").join(at, cond, "left").select("d.*", rank)


def row_rank(df: DataFrame, keys: list[str], order: str, ties: list[str], name: str) -> DataFrame:
    """Adds a 1-based row number by ``order``, then ``ties``, within the group."""
    ranged = _ranged(df, keys, order)
    ranges = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")).alias("r")
    inside = Window.partitionBy(*keys, "_range").orderBy(order, *ties)
    ranged = ranged.withColumn("_i", F.row_number().over(inside)).alias("d")
    cond = F.col("d._range") == F.col("r._range")
    for k in keys:
        cond = cond & F.col(f"d.{k}").eqNullSafe(F.col(f"r.{k}"))
    return ranged.join(ranges, cond).select(*(f"d.{c}" for c in df.columns), (F.col("_before") + F.col("_i")).alias(name))
