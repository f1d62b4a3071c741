"""Encoding, feature screening and leakage exclusion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames the columns that are there."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def first_valid(df: DataFrame, sources: list[str], name: str) -> DataFrame:
    """One column from several: the first that is not NULL; the sources go."""
    here = [c for c in sources if c in df.columns]
    return df.withColumn("_first", F.coalesce(*map(F.col, here))).drop(*here).withColumnRenamed("_first", name) if here else df


def one_hot(df: DataFrame, column: str, levels: list | None = None, most: int = 1000) -> DataFrame:
    """Adds <column>_<level> as 0/1 for each level in order, and <column>_NA for NULL. Levels become columns, so at most ``most``."""
    if levels is None:
        levels = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
        if len(levels) > most:
            raise ValueError(f"{column} has more than {most} levels")
    return df.select("*", *(F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in levels), F.col(column).isNull().cast("int").alias(f"{column}_NA"))


def one_hot_decode(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Adds the name of the first column with the largest value; rows where none is above 0 are dropped."""
    cols = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    top = F.array_max(cols)
    level = F.element_at(F.array(*map(F.lit, columns)), F.array_position(cols, top).cast("int"))
    return df.withColumn(name, F.when(top > 0, level)).filter(F.col(name).isNotNull())


def stack_blocks(df: DataFrame, keep: list[str], suffix: str = ".1") -> DataFrame:
    """Two side-by-side blocks, the right one with a name suffix, as rows; rows without any value go."""
    right = [c for c in df.columns if c.endswith(suffix)]
    left = [c.removesuffix(suffix) for c in right]
    one = df.select(*(F.col(f"`{c}`") for c in [*keep, *left]))
    two = df.select(*(F.col(f"`{c}`") for c in keep), *(F.col(f"`{c}`").alias(c.removesuffix(suffix)) for c in right))
    return one.unionByName(two).dropna(how="all", subset=left)


def features_without(columns: list[str], *drop: str) -> list[str]:
    gone = {d.lower() for d in drop}
    return [c for c in columns if c.lower() not in gone]


def leakage_relation(df: DataFrame, target: str, derivatives: dict[str, list[str]], structural: list[str] = ()) -> DataFrame:
    """(column, kept, reason): columns whose token names the target or a direct derivative of it, or that are structural, are out."""
    token = lambda s: re.sub("[^a-z0-9]+", "", s.lower())
    names = {token(target), *map(token, derivatives.get(target, []))}
    rows = []
    for c in df.columns:
        t = token(c)
        why = "target" if t == token(target) else "derivative" if any(n and n in t for n in names) else "structural" if c in structural else None
        rows.append((c, why is None, why))
    return df.sparkSession.createDataFrame(rows, "column string, kept boolean, reason string")


def marked_features(variables: DataFrame, name: str, mark: str, leaks: list[str]) -> list[str]:
    """Variables that a list marks with x, without the leaks; the list is a codebook, not data."""
    rows = variables.filter((F.lower(F.trim(mark)) == "x") & ~F.col(name).isin(*leaks)).select(name).orderBy(name)
    return [r[0] for r in rows.collect()]


def feature_screen(df: DataFrame, features: list[str], most_missing: float = 0.8, least_distinct: int = 2) -> DataFrame:
    """(feature, missing_share, n_distinct, kept) from one pass. Distinct values are counted exactly."""
    aggs = []
    for f in features:
        aggs += [F.avg(F.col(f).isNull().cast("double")).alias(f"m_{f}"), F.count_distinct(f).alias(f"d_{f}")]
    row = df.agg(*aggs)
    parts = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("missing_share"), F.col(f"d_{f}").alias("n_distinct")) for f in features)))
    out = row.select(parts.alias("o")).select("o.*")
    kept = (F.col("missing_share") <= most_missing) & (F.col("n_distinct") >= least_distinct)
    return out.withColumn("kept", F.coalesce(kept, F.lit(False)))


def screen_status(df: DataFrame, keys: list[str], label: str, least: int, least_pos: int, least_neg: int) -> DataFrame:
    """(keys, n, n_pos, n_neg, status, reason): whether each group is large enough to be analysed, and the first reason if not."""
    out = df.filter(F.col(label).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(label) > 0.5).cast("long")).alias("n_pos"), F.sum((F.col(label) <= 0.5).cast("long")).alias("n_neg")
    )
    why = F.when(F.col("n") < least, "too few rows").when(F.col("n_pos") < least_pos, "too few positives").when(F.col("n_neg") < least_neg, "too few negatives")
    return out.withColumns({"status": F.when(why.isNull(), "ok").otherwise("skipped"), "reason": why})


def eligible_units(df: DataFrame, unit: str, column: str, least: int) -> DataFrame:
    """Rows of units with at least ``least`` known values of a column."""
    ok = df.groupBy(unit).agg(F.count(column).alias("_n")).filter(F.col("_n") >= least).select(unit)
    return df.join(ok, unit, "left_semi")


def complete_rows(df: DataFrame, required: list[str]) -> DataFrame:
    return df.dropna(subset=required)


def label_index(df: DataFrame, label: str, name: str, most: int = 100_000) -> DataFrame:
    """Adds the place of each class in alphabetical order, from 0. There may be at most ``most`` classes."""
    classes = df.filter(F.col(label).isNotNull()).select(label).distinct()
    found = [r[0] for r in classes.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{label} has more than {most} classes")
    numbered = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(sorted(found))], classes.withColumn(name, F.lit(0)).schema)
    return df.join(numbered, label, "left")


def any_known(features: list[str]) -> Column:
    return F.coalesce(*(F.col(f).cast("string") for f in features)).isNotNull()
