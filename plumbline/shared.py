"""The folder that the driver and all executors share, and tables written to it to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local session without one gets a temporary folder, removed at exit."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="plumbline-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


#: Lists of the tables written inside the scratch blocks that are open here, innermost last; every thread has its own.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open scratch blocks", default=())


_LOCK = threading.Lock()
#: Blocks of ``_shuffles_deleted`` that are open in each session, with what the setting was before the first.
_DELETING: dict[int, tuple[int, str | None]] = {}


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries run in the block delete their shuffle files at once: what they computed is stored and not computed again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _LOCK:
        n, before = _DELETING.get(id(spark), (0, None))
        if not n:
            before = spark.conf.get(key, None)
            spark.conf.set(key, "true")
        _DELETING[id(spark)] = n + 1, before
    try:
        yield
    finally:
        with _LOCK:
            n, before = _DELETING.pop(id(spark))
            if n > 1:
                _DELETING[id(spark)] = n - 1, before
            elif before is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, before)


def stored(df: DataFrame, what: str, hold: bool = False) -> tuple[DataFrame, str]:
    """As ``written``, with the path of the table."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{what}-{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.parquet(path)
    owners = _OPEN.get()[:-1] if hold else _OPEN.get()
    if owners:
        owners[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, what: str, hold: bool = False) -> DataFrame:
    """The rows, written to the shared folder as Parquet and read back: computed once, and safe from lost executors.

    Inside a ``scratch`` block the table goes when the block ends; with ``hold`` it lasts as long as the block around
    that one. Outside of any block it stays until the folder is cleared.
    """
    return stored(df, what, hold)[0]


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables in the shared folder."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written in the block are deleted when it ends: what leaves it must not read them any more.

    Yields the list of their paths; a caller that empties it takes them over.
    """
    own: list[str] = []
    before = _OPEN.set((*_OPEN.get(), own))
    try:
        yield own
    finally:
        _OPEN.reset(before)
        drop(spark, own)
