"""From raw documents to packed training sequences: quality rules, near duplicates, repeats, benchmark leaks, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import shared
from plumbline.llm import decontaminate, jaccard, packing, quality, substring
from plumbline.llm.textcore import free_name
from plumbline.session import ship


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail the base rules or that the weighed votes reject."""
    ship(spark)
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    ship(spark)
    return jaccard.keep_first(docs)


def repeats_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated windows of words; a document that loses every word goes, one without repeats stays as it is.

    All columns stay; n_chars, if there is one that holds numbers, follows the text that is left.
    """
    ship(spark)
    no_text = free_name(docs.columns, "no_text")
    others = tuple(c for c in docs.columns if c != "text")
    kept = substring.remove_repeats(docs.withColumn(no_text, F.col("text").isNull()), carry=(*others, no_text))
    whole = F.col("n_removed") == 0
    kept = kept.filter(whole | (F.col("n_removed") < F.col("n_words")))
    out = []
    for f in docs.schema.fields:
        if f.name == "text":
            value = F.when(~F.col(f"carried.`{no_text}`"), F.col("kept_text"))
        else:
            value = F.col(f"carried.`{f.name}`")
        if f.name == "n_chars" and isinstance(f.dataType, T.NumericType):
            value = F.when(whole, value).otherwise(F.length("kept_text").cast(f.dataType))
        out.append(value.alias(f.name))
    return kept.select(*out)


def benchmark_leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in training sequences."""
    ship(spark)
    return packing.pack(docs)


#: Tables that a stage writes to the shared folder for its result to read stay there; run() deletes those of its own stages.
STAGES = [
    ("quality rules", good_texts),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", repeats_cut),
    ("benchmark decontamination", benchmark_leaks_out),
    ("best-fit packing", packed),
]

#: No SQL expresses the stages; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again.

    What a stage leaves behind goes once its result is stored, and so does the result of the stage before. The last result stays
    until the folder is cleared; it belongs to this run alone.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    folder = f"{shared.folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        with shared.scratch(spark):
            path = f"{folder}/{n}"
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            shared.drop(spark, [last])
        last = path
    return docs
