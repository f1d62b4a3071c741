"""Supervised frames from long panels, without looking past the cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def train_zscore(panel: DataFrame, unit: str, period: str, value: str, cutoff: Column | int, least: int = 5) -> DataFrame:
    """Adds z: centred and scaled by the unit's mean and population sd up to the cutoff.

    Units with fewer than ``least`` training rows or without variance there are left out.
    """
    early = F.when(F.col(period) <= cutoff, F.col(value).cast("double"))
    stats = panel.groupBy(unit).agg(F.avg(early).alias("_m"), F.stddev_pop(early).alias("_s"), F.count(early).alias("_n"))
    stats = stats.filter((F.col("_n") >= least) & (F.col("_s") > 0))
    return panel.join(stats, unit).withColumn("z", (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s", "_n")


def supervised(panel: DataFrame, unit: str, period: str, z: str, lags: int, horizons: list[int], cutoff: Column | int) -> DataFrame:
    """One row per cutoff row and horizon: lag_0 (the row itself) to lag_{lags-1}, target, target_period, is_test.

    Lags and leads go by row, not by calendar. All horizons share one window. A row is a test row if its target lies
    after the cutoff. Rows without every lag and a target are left out.
    """
    w = Window.partitionBy(unit).orderBy(period)
    lagged = {f"lag_{j}": F.lag(z, j).over(w) for j in range(1, lags)} | {"lag_0": F.col(z)}
    leads = [F.struct(F.lit(h).alias("horizon"), F.lead(z, h).over(w).alias("target"), F.lead(period, h).over(w).alias("target_period")) for h in horizons]
    out = panel.select(unit, period, *(c.alias(n) for n, c in sorted(lagged.items())), F.array(*leads).alias("_h"))
    out = out.dropna(subset=[f"lag_{j}" for j in range(lags)]).select("*", F.explode("_h").alias("_o")).select("*", "_o.*").drop("_h", "_o")
    return out.filter(F.col("target").isNotNull()).withColumn("is_test", F.col("target_period") > cutoff)


def driver_lags(panel: DataFrame, unit: str, period: str, drivers: list[str], lags: int) -> DataFrame:
    """Adds <driver>_lag_0 to <driver>_lag_{lags}."""
    w = Window.partitionBy(unit).orderBy(period)
    return panel.select("*", *(F.lag(d, j).over(w).alias(f"{d}_lag_{j}") for d in drivers for j in range(lags + 1)))


def feature_columns(columns: list[str], drivers: list[str], which: str) -> list[str]:
    """Feature names for an ablation: own, drivers or both."""
    own = [c for c in columns if c.startswith("lag_")]
    ext = [c for c in columns if any(c.startswith(f"{d}_lag_") for d in drivers)]
    return {"own": own, "drivers": ext, "both": own + ext}[which]


def latest_rows(panel: DataFrame, unit: str, period: str, n: int) -> DataFrame:
    w = Window.partitionBy(unit).orderBy(F.desc(period))
    return panel.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def trailing_mean(df: DataFrame, keys: list[str], order: str, x: str, rows: int = 3, least: int = 2, name: str = "trailing") -> DataFrame:
    """Adds the mean over this and the rows - 1 before it; NULL with fewer than ``least`` known values."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumn(name, F.when(F.count(x).over(w) >= least, F.avg(x).over(w)))


def common_periods(panel: DataFrame, unit: str, period: str, keys: list[str] = ()) -> DataFrame:
    """(keys, period) that every unit has."""
    keys = list(keys)
    rows = panel.select(*keys, unit, period).distinct()
    units = rows.groupBy(*keys).agg(F.count_distinct(unit).alias("_u"))
    at = rows.groupBy(*keys, period).agg(F.count(F.lit(1)).alias("_c"))
    joined = at.join(units, keys) if keys else at.join(units)
    return joined.filter(F.col("_c") == F.col("_u")).select(*keys, period)
