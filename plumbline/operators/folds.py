"""Folds as relations: a row's membership in a test fold. Training rows are the others; copies are never made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.draws import draw, fold_of
from plumbline.functions.geo import block_id
from plumbline.operators.ranking import row_rank


def with_block(df: DataFrame, lon: str, lat: str, deg: float | Column, name: str = "fold") -> DataFrame:
    return df.withColumn(name, block_id(F.col(lon), F.col(lat), deg))


def block_sweep(df: DataFrame, lon: str, lat: str, degrees: list[float]) -> DataFrame:
    """Every row once per block size, in one pass: adds block_deg and fold."""
    sizes = F.explode(F.array(*(F.lit(float(d)) for d in degrees))).alias("block_deg")
    return with_block(df.select("*", sizes), lon, lat, F.col("block_deg"))


def eligible_folds(
    df: DataFrame, keys: list[str], fold: str = "fold", least: int = 1, label: str | None = None, least_pos: int = 0, least_neg: int = 0, cap: int | None = None
) -> DataFrame:
    """(keys, fold, n_test, n_pos) of folds with enough rows and positives; with ``cap`` the largest ones, ties by fold."""
    pos = F.sum(F.col(label).cast("double")).cast("long") if label else F.lit(None).cast("long")
    out = df.filter(F.col(fold).isNotNull()).groupBy(*keys, fold).agg(F.count(F.lit(1)).alias("n_test"), pos.alias("n_pos")).filter(F.col("n_test") >= least)
    if label:
        out = out.filter((F.col("n_pos") >= least_pos) & (F.col("n_test") - F.col("n_pos") >= least_neg))
    if cap is not None:
        by_size = Window.partitionBy(*keys).orderBy(F.desc("n_test"), fold)
        out = out.withColumn("_r", F.row_number().over(by_size)).filter(F.col("_r") <= cap).drop("_r")
    return out


def screened_scales(df: DataFrame, lon: str, lat: str, degrees: list[float], least_rows: int, least_folds: int = 5) -> DataFrame:
    """(block_deg, n_folds, status) for every block size asked for, also those without a usable fold."""
    spark = df.sparkSession
    asked = spark.createDataFrame([(float(d),) for d in degrees], "block_deg double")
    n = eligible_folds(block_sweep(df, lon, lat, degrees), ["block_deg"], least=least_rows).groupBy("block_deg").agg(F.count(F.lit(1)).alias("n_folds"))
    out = asked.join(n, "block_deg", "left").select("block_deg", F.coalesce("n_folds", F.lit(0)).alias("n_folds"))
    return out.withColumn("status", F.when(F.col("n_folds") >= least_folds, "used").otherwise("too few folds"))


def random_folds(df: DataFrame, key: str, k: int | Column, seed: int | Column = 0, name: str = "fold") -> DataFrame:
    """Independent assignment by a portable hash of the key."""
    return df.withColumn(name, fold_of(F.col(key), k, seed))


def chunk_folds(df: DataFrame, key: str, k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """One permutation cut into k chunks, the first n mod k of them one row longer."""
    ranked = row_rank(df.withColumn("_d", draw(F.col(key), seed)), [], "_d", [key], "_r")
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    base, extra, r = F.floor(F.col("_n") / k), F.col("_n") % k, F.col("_r") - 1
    long_rows = extra * (base + 1)
    fold = F.when(r < long_rows, F.floor(r / (base + 1))).otherwise(extra + F.floor((r - long_rows) / F.greatest(base, F.lit(1))))
    return ranked.join(F.broadcast(n)).withColumn(name, fold.cast("int")).drop("_d", "_r", "_n")  # n is one row


def stratified_folds(df: DataFrame, key: str, label: str, k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """Each class dealt out in turn by hash order; k is the size of the smallest class if that is less."""
    smallest = df.groupBy(label).count().agg(F.least(F.lit(k), F.greatest(F.min("count"), F.lit(1))).alias("_k"))
    ranked = row_rank(df.withColumn("_d", draw(F.col(key), seed)), [label], "_d", [key], "_r")
    return ranked.join(F.broadcast(smallest)).withColumn(name, ((F.col("_r") - 1) % F.col("_k")).cast("int")).drop("_d", "_r", "_k")  # one row


#: Groups with more than this share of the rows are placed one by one; there are fewer than 1 / LARGE_GROUP of them.
LARGE_GROUP = 1 / 1024


def group_folds(df: DataFrame, group: str, k: int = 5, least_groups: int = 3) -> DataFrame:
    """(group, fold): whole groups, the large ones first, the largest into the lightest fold; ties by group, then fold.

    The groups that hold more than LARGE_GROUP of the rows each (fewer than 1,024) are placed on the driver. All others are dealt by the
    hash of the group, to each fold in proportion to what it still lacks of an even share.
    """
    sizes = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    n, total = sizes.agg(F.count(F.lit(1)), F.sum("_n")).first()
    none = df.select(group, F.lit(0).alias("fold")).schema
    if n < least_groups:
        return df.sparkSession.createDataFrame([], none)
    load, out, edge = [0] * min(k, n), [], total * LARGE_GROUP
    for r in sorted(sizes.filter(F.col("_n") > edge).collect(), key=lambda r: (-r["_n"], r[group])):
        f = min(range(len(load)), key=lambda i: (load[i], i))
        load[f] += r["_n"]
        out.append((r[group], f))
    placed = df.sparkSession.createDataFrame(out, none)
    if len(out) == n:
        return placed
    lack = [max(total / len(load) - x, 0.0) for x in load]
    up_to = [sum(lack[: i + 1]) / sum(lack) for i in range(len(lack))]
    u = F.pmod(F.xxhash64(group), F.lit(1 << 30)) / F.lit(float(1 << 30))
    fold = F.size(F.filter(F.array(*map(F.lit, up_to[:-1])), lambda edge: edge <= u)).cast("int")
    return placed.unionAll(sizes.filter(F.col("_n") <= edge).select(group, fold.alias("fold")))


def permutation_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 0, name: str = "is_test") -> DataFrame:
    """Test rows are those after the first floor(share * n) of one permutation."""
    ranked = row_rank(df.withColumn("_d", draw(F.col(key), seed)), [], "_d", [key], "_r")
    n = ranked.agg(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("_n"))
    return ranked.join(F.broadcast(n)).withColumn(name, F.col("_r") > F.col("_n")).drop("_d", "_r", "_n")  # one row


def author_holdout(flag: Column) -> Column:
    """Test rows by a supplied flag: true, yes, test or 1, in any case."""
    return F.coalesce(F.lower(F.trim(flag.cast("string"))).isin("true", "yes", "test", "1"), F.lit(False))


def chronological_cutoff(df: DataFrame, period: str, q: float = 0.8) -> DataFrame:
    """One row: the q-quantile of the distinct periods, truncated to a whole period."""
    return df.select(period).distinct().agg(F.floor(F.percentile(F.col(period), q)).cast("long").alias("cutoff"))


def tail_split(df: DataFrame, unit: str, order: str, least_test: int, share: float = 0.2, margin: int = 30) -> DataFrame:
    """Adds is_test: each unit's last max(least_test, ceil(share * n)) rows; units with no more than that plus margin are left out."""
    last = Window.partitionBy(unit).orderBy(F.desc(order))
    n = F.count(F.lit(1)).over(Window.partitionBy(unit))
    want = F.greatest(F.lit(least_test), F.ceil(F.col("_n") * F.lit(share)))
    out = df.withColumn("_n", n).withColumn("_w", want).withColumn("_r", F.row_number().over(last))
    return out.filter(F.col("_n") > F.col("_w") + margin).withColumn("is_test", F.col("_r") <= F.col("_w")).drop("_n", "_w", "_r")


def repeated_holdout(df: DataFrame, key: str, seeds: list[int], test_share: float) -> DataFrame:
    """Every row once per seed with is_test by the hash of key and seed."""
    out = df.select("*", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    return out.withColumn("is_test", draw(F.col(key), F.col("seed")) % 10_000 < int(round(test_share * 10_000)))


def stratified_sample(df: DataFrame, key: str, label: str, most: int, least_pos: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows with the classes' shares kept and at least ``least_pos`` positives, by hash order (a sampling operator)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"))
    quota = F.when(F.col("_t") <= most, F.col("_c")).otherwise(
        F.greatest(F.floor(F.col("_c") * F.lit(float(most)) / F.col("_t")), F.when(F.col(label) > 0.5, F.least(F.lit(least_pos), F.col("_c"))).otherwise(F.lit(0)))
    )
    quotas = counts.join(F.broadcast(total)).select(label, quota.cast("long").alias("_q"))  # total is one row
    ranked = row_rank(df.withColumn("_d", draw(F.col(key), seed)), [label], "_d", [key], "_r")
    return ranked.join(quotas, label).filter(F.col("_r") <= F.col("_q")).drop("_d", "_r", "_q")


def sample_units(df: DataFrame, unit: str, most: int, seed: int = 0) -> DataFrame:
    """All rows of at most ``most`` units, by hash order (a sampling operator)."""
    units = df.select(unit).distinct()
    chosen = units.orderBy(draw(F.col(unit), seed), unit).limit(most)
    return df.join(chosen, unit, "left_semi")


def overlap_count(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """One row n_overlap: rows that are in both; a sound split has none."""
    return train.select(*keys).intersect(test.select(*keys)).agg(F.count(F.lit(1)).alias("n_overlap"))


def overlap_greedy_units(panel: DataFrame, cell: str, unit: str, period: str, least: int) -> DataFrame:
    """(cell, unit, n_common) of the units left when units are dropped until ``least`` periods are common to all.

    Each step drops the unit whose loss gains most common periods; ties go to the unit with fewer periods, then the larger
    name. A step depends on the one before, so a cell is worked on in one task, on its table of units and periods; a step counts
    units by period once. Cells with fewer than two units left are not returned.
    """
    import numpy as np
    import pandas as pd

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf[cell].iloc[0]
        units, u = np.unique(pdf[unit].to_numpy(), return_inverse=True)
        periods, p = np.unique(pdf[period].to_numpy(), return_inverse=True)
        has = np.zeros((len(units), len(periods)), bool)
        has[u, p] = True
        left, held = np.arange(len(units)), has.sum(1)
        count = has.sum(0)
        while len(left) > 1:
            common = int((count == len(left)).sum())
            if common >= least:
                return pd.DataFrame({cell: name, unit: units[left], "n_common": common})
            gain = (~has[np.ix_(left, np.flatnonzero(count == len(left) - 1))]).sum(1)  # periods that only this unit lacks
            out = max(range(len(left)), key=lambda i: (gain[i], -held[left[i]], left[i]))
            count = count - has[left[out]]
            left = np.delete(left, out)
        return pd.DataFrame({cell: [], unit: [], "n_common": []})

    types = dict(panel.dtypes)
    return panel.select(cell, unit, period).distinct().groupBy(cell).applyInPandas(pick, f"{cell} {types[cell]}, {unit} {types[unit]}, n_common long")


def matched_k(spatial_folds: DataFrame, least: int = 5) -> int:
    """Number of random folds to set beside usable spatial folds: as many, but at least ``least``."""
    return max(spatial_folds.count(), least)


def smoke_subset(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by hash order, for trying a pipeline out (a sampling operator)."""
    return df.orderBy(draw(F.col(key), seed), key).limit(n)
