"""Zero-learning baselines that know only training rows: group means, last value, same season last year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_mean(train: DataFrame, test: DataFrame, groups: list[str], y: str, keys: list[str] = ()) -> DataFrame:
    """Test rows with pred (the group's training mean, else the overall one) and seen. ``keys`` (such as fold) must agree."""
    keys = list(keys)
    per = train.groupBy(*keys, *groups).agg(F.avg(y).alias("_m"))
    overall = train.groupBy(*keys).agg(F.avg(y).alias("_o"))
    out = test.join(per, [*keys, *groups], "left")
    out = out.join(overall, keys, "left") if keys else out.join(overall)
    return out.withColumns({"pred": F.coalesce("_m", "_o"), "seen": F.col("_m").isNotNull()}).drop("_m", "_o")


def fold_group_mean(df: DataFrame, fold: str, groups: list[str], y: str) -> DataFrame:
    """Every row with the mean of its group over the rows outside its fold, by subtraction from the totals.

    Adds pred (the overall mean outside the fold if the group has no row there) and seen. One aggregate, no copies.
    """
    def sums(by: list[str], tag: str) -> DataFrame:
        return df.groupBy(*by).agg(F.sum(y).alias(f"_s{tag}"), F.count(y).alias(f"_n{tag}"))

    cell, group, part = sums([fold, *groups], "c"), sums(groups, "g"), sums([fold], "f")
    total = df.agg(F.sum(y).alias("_st"), F.count(y).alias("_nt"))
    stats = cell.join(group, groups).join(F.broadcast(part), fold).join(F.broadcast(total))  # a row a fold, and one row
    own = F.try_divide(F.col("_sg") - F.col("_sc"), F.col("_ng") - F.col("_nc"))
    rest = F.try_divide(F.col("_st") - F.col("_sf"), F.col("_nt") - F.col("_nf"))
    stats = stats.select(fold, *groups, F.coalesce(own, rest).alias("pred"), own.isNotNull().alias("seen"))
    return df.join(stats, [fold, *groups], "left")


def persistence(frame: DataFrame, z: str = "z") -> DataFrame:
    """The value at the cutoff row as the forecast."""
    return frame.withColumn("persistence", F.col(z))


def seasonal(frame: DataFrame, panel: DataFrame, unit: str, target_period: str, period: str, z: str) -> DataFrame:
    """Adds seasonal: the unit's value at target_period - 100 (YYYYMM, a year before), NULL if that period is absent.

    It is looked up by the calendar, so gaps in a series do not shift it. Of rows that repeat a period the one with the largest value counts.
    """
    look = panel.groupBy(F.col(unit).alias("_u"), (F.col(period) + 100).alias("_p")).agg(F.max(z).alias("seasonal"))
    return frame.join(look, (F.col(unit) == F.col("_u")) & (F.col(target_period) == F.col("_p")), "left").drop("_u", "_p")
