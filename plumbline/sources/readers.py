"""Readers. Schemas are given, not inferred; NaN in doubles becomes NULL where a reader says so."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str | list[str], schema: str, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header (a byte-order mark is skipped), columns by name; NaN becomes NULL.

    The header of the first file says which columns there are and where; a file whose header differs is an error. Columns of the
    schema that no header names are NULL, columns that the schema does not name are not read.
    """
    want = StructType.fromDDL(schema)
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    types = {f.name: f.dataType for f in want}
    there = StructType([StructField(c, types.get(c, StringType())) for c in raw.columns])
    df = spark.read.schema(there).option("header", True).option("sep", sep).option("enforceSchema", False).csv(path)
    df = df.select(*(F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want))
    df = df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
    return df.select(*columns) if columns else df


def read_csv_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every column as text, for sources whose numbers need parsing."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_csv_glob(spark: SparkSession, folder: str, pattern: str, exclude: list[str], schema: str) -> DataFrame:
    """Files by pattern without those whose name contains an excluded part; adds source_file."""
    df = spark.read.schema(schema).option("header", True).option("pathGlobFilter", pattern).csv(folder)
    df = df.withColumn("source_file", F.col("_metadata.file_name"))
    for part in exclude:
        df = df.filter(~F.col("source_file").contains(part))
    return df


def read_units(spark: SparkSession, folder: str, columns: list[str], key: str = "unit") -> DataFrame:
    """Parquet files of one unit each: the file's stem becomes the key."""
    df = spark.read.parquet(folder)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.parquet$", 1).alias(key), *columns)


def read_panel(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """A Parquet folder, only some columns."""
    return spark.read.parquet(folder).select(*columns)


def read_zipped_csv(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """The CSV members whose name ends with ``member`` in ZIP archives, as text parsed to the schema. One task per archive of at most 2 GB."""
    want = StructType.fromDDL(schema)
    names = want.fieldNames()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in sorted(z.namelist()):
                        if n.endswith(member):
                            with z.open(n) as f:
                                for part in pd.read_csv(f, dtype=str, encoding="utf-8-sig", chunksize=50_000, keep_default_na=False):
                                    yield part.reindex(columns=names)

    text = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, ", ".join(f"`{n}` string" for n in names))
    return text.select(*(F.nullif(F.col(f"`{f.name}`"), F.lit("")).try_cast(f.dataType).alias(f.name) for f in want))


def read_csv_with_preamble(spark: SparkSession, path: str, first_cell: str, schema: str) -> DataFrame:
    """CSV whose header is the first record that starts with ``first_cell``; the records above it are dropped.

    Columns match by position. Records may have line breaks in quotes, so a file is read by one task, record by record. Every file has
    its own header, so several files with different preambles can be read at once; a file without a header gives no rows.
    """
    want = StructType.fromDDL(schema)
    text = StructType([StructField(f"_{i}", StringType()) for i in range(len(want))])
    rows = spark.read.schema(text).option("multiLine", True).csv(path).select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    first = F.regexp_replace("_0", "^\ufeff", "")
    header = F.min(F.when(first == first_cell, F.col("_at"))).over(Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    body = rows.withColumn("_h", header).filter(F.col("_h").isNotNull() & F.coalesce(*text.fieldNames()).isNotNull())
    return body.select(*(F.nullif(F.col(f"_{i}"), F.lit("")).try_cast(f.dataType).alias(f.name) for i, f in enumerate(want)))


def read_horizons(spark: SparkSession, path: str, frequencies: list[str], horizons: list[str]) -> DataFrame:
    """(frequency, well, horizon, n_test, and each score) from one JSON document of lists of wells with a record per horizon."""
    rec = "struct<persist: double, ridge: double, xgb: double, n_test: bigint>"
    well = "array<struct<well: string, " + ", ".join(f"{h}: {rec}" for h in horizons) + ">>"
    df = spark.read.schema(", ".join(f"{f} {well}" for f in frequencies)).json(path, multiLine=True)
    parts = [df.select(F.lit(f).alias("frequency"), F.explode(f).alias("w")) for f in frequencies]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    per = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"w.{h}").alias("s")) for h in horizons))).alias("o")
    return out.select("frequency", F.col("w.well").alias("well"), per).select("frequency", "well", "o.horizon", "o.s.*").filter(F.col("n_test").isNotNull())


def read_mirror(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the scalars of one flat JSON object, as text."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def verify_manifest(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """(path, status): ok, changed, missing or too large for each (path, sha256) of a manifest.

    Files are hashed where they are read, each in one task; the content of one of 2 GB or more is not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    name = F.substr(F.regexp_replace("path", "^file:/*", "/"), F.lit(len(base) + 2))
    small = F.col("length") < (1 << 31) - 1
    have = files.filter(small).select(name.alias("path"), F.sha2("content", 256).alias("_h")).unionAll(files.filter(~small).select(name, F.lit("")))
    out = manifest.join(have, "path", "left")
    status = F.when(F.col("_h").isNull(), "missing").when(F.col("_h") == "", "too large").when(F.lower("sha256") == F.col("_h"), "ok").otherwise("changed")
    return out.select("path", status.alias("status"))
