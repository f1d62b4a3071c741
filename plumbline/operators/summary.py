"""Reductions of fold score tables: medians, gaps, recovery, pivots, strata, cross tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.skill import recovery_pct
from plumbline.operators.ranking import quantiles


def weighted_mean(x: str, w: str) -> Column:
    ok = F.col(x).isNotNull() & F.col(w).isNotNull()
    return F.try_divide(F.sum(F.when(ok, F.col(x) * F.col(w))), F.sum(F.when(ok, F.col(w))).cast("double"))


def fold_summary(scores: DataFrame, keys: list[str], metric: str, size: str) -> DataFrame:
    """(keys, n_folds, pooled_n, median, weighted_mean)."""
    return scores.groupBy(*keys).agg(F.count(metric).alias("n_folds"), F.sum(size).alias("pooled_n"), F.median(metric).alias("median"), weighted_mean(metric, size).alias("weighted_mean"))


def regime_gap(scores: DataFrame, keys: list[str], regime: str, metric: str, random: str = "random", spatial: str = "spatial") -> DataFrame:
    """(keys, random_median, spatial_median, gap)."""
    m = lambda r: F.median(F.when(F.col(regime) == r, F.col(metric)))
    out = scores.groupBy(*keys).agg(m(random).alias("random_median"), m(spatial).alias("spatial_median"))
    return out.withColumn("gap", F.col("random_median") - F.col("spatial_median"))


def recovery_table(scores: DataFrame, keys: list[str], model: str, baseline: str, offset: str | float = 0.0, floor: bool = False) -> DataFrame:
    """(keys, n, model_skill, baseline_skill, increment, recovery_pct) from the medians of the two columns."""
    off = F.col(offset) if isinstance(offset, str) else F.lit(offset)
    by = [*keys, offset] if isinstance(offset, str) and offset not in keys else keys
    out = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.median(model)).alias("_m"), F.median(baseline).alias("_b"))
    out = out.withColumns({"model_skill": F.col("_m") - off, "baseline_skill": F.col("_b") - off})
    return out.select(*keys, "n", "model_skill", "baseline_skill", (F.col("model_skill") - F.col("baseline_skill")).alias("increment"), recovery_pct(F.col("baseline_skill"), F.col("model_skill"), floor).alias("recovery_pct"))


def paired_medians(wide: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, median_of_differences, difference_of_medians) over rows where both are known; the two are not the same."""
    own = wide.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median(F.col(a) - F.col(b)).alias("median_of_differences"), (F.median(a) - F.median(b)).alias("difference_of_medians"))


def pivot_models(scores: DataFrame, keys: list[str], model: str, models: list[str], metric: str, paired: bool = True) -> DataFrame:
    """(keys, one column per model); with ``paired`` only rows where every model has a score."""
    out = scores.groupBy(*keys).pivot(model, models).agg(F.first(metric, ignorenulls=True))
    return out.dropna(subset=models) if paired else out


def best_model(scores: DataFrame, keys: list[str], model: str, metric: str) -> DataFrame:
    """(keys, best, score): the largest score; of equals the first name."""
    w = Window.partitionBy(*keys).orderBy(F.desc(metric), model)
    ranked = scores.filter(F.col(metric).isNotNull()).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return ranked.select(*keys, F.col(model).alias("best"), F.col(metric).alias("score"))


def seeds_then_units(scores: DataFrame, keys: list[str], unit: str, metric: str) -> DataFrame:
    """(keys, n_units, median, seed_sd): mean over seeds in each unit, then the median; the mean sample sd over seeds."""
    per = scores.groupBy(*keys, unit).agg(F.avg(metric).alias("_m"), F.stddev_samp(metric).alias("_s"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_units"), F.median("_m").alias("median"), F.avg("_s").alias("seed_sd"))


def range_flags(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(x).alias("least"), F.max(x).alias("most"), F.bool_and(F.col(x) > 0).alias("all_positive"), F.count(x).alias("n"))


def cross_table(df: DataFrame, row: str, column: str, most: int = 1_000_000) -> DataFrame:
    """(row, column, n, row_pct) over the whole grid, zero cells included; rows with a NULL are left out.

    A grid of more than ``most`` cells is no table to print and an error.
    """
    own = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = own.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    n_rows, n_columns = cells.agg(F.count_distinct(row), F.count_distinct(column)).first()
    if n_rows * n_columns > most:
        raise ValueError(f"{row} x {column} has {n_rows * n_columns} cells, more than {most}")
    # the grid has one row for each pair of levels: rows x columns of the table that is printed
    grid = cells.select(row).distinct().crossJoin(cells.select(column).distinct())
    total = cells.groupBy(row).agg(F.sum("n").alias("_t"))
    out = grid.join(cells, [row, column], "left").join(total, row)
    return out.select(row, column, F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.lit(100.0) * F.coalesce("n", F.lit(0)) / F.col("_t")).alias("row_pct"))


def conditional_share(df: DataFrame, keys: list[str], given: Column, event: Column) -> DataFrame:
    """(keys, n_given, n_event, share_pct); NULL where nothing is given."""
    out = df.groupBy(*keys).agg(F.count_if(given).alias("n_given"), F.count_if(given & event).alias("n_event"))
    return out.withColumn("share_pct", F.try_divide(F.lit(100.0) * F.col("n_event"), F.col("n_given")))


def quantile_strata(df: DataFrame, keys: list[str], x: str, n: int = 4) -> DataFrame:
    """Adds stratum 1..n in each group by its quantile edges, intervals closed above, the first also below."""
    edges = quantiles(df, keys, x, [i / n for i in range(1, n)]).drop("n").withColumnRenamed("q", "_e")
    out = df.join(edges, keys, "left") if keys else df.join(edges, how="left")
    return out.withColumn("stratum", F.when(F.col(x).isNotNull(), F.size(F.filter("_e", lambda e: e < F.col(x))) + 1)).drop("_e")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of every value, NULL included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
