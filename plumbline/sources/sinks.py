"""Result stores: formats, partitions that are replaced one by one, and resumed work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from plumbline.operators.relational import keep_last, not_yet_done


def write_table(df: DataFrame, path: str, fmt: str = "parquet", force: bool = True, by: list[str] = ()) -> None:
    """Replaces the output, or leaves an existing one alone without ``force``."""
    w = df.write.format(fmt).mode("overwrite" if force else "ignore")
    w = w.option("header", True) if fmt == "csv" else w
    (w.partitionBy(*by) if by else w).save(path)


def write_units(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that the rows belong to: a finished unit is safe before the next starts."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a store holds; an empty relation if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def resume(work: DataFrame, path: str, schema: str, keys: list[str]) -> DataFrame:
    return not_yet_done(work, stored(work.sparkSession, path, schema), keys)


def merge_results(old: DataFrame, new: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Old and new rows; of a key that repeats, the last by ``sequence``."""
    return keep_last(old.unionByName(new, allowMissingColumns=True), keys, [sequence])
