"""Session settings that the results rely on, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A local session for tests and the benchmark. On a cluster, set SETTINGS and size the partitions to the data."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("plumbline")
    for k, v in {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false", **more}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, unless they run here and find it by folder or PYTHONPATH."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if getattr(sc, "_plumbline_shipped", False):
        return
    sc._plumbline_shipped = True
    found = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    if sc.master.startswith("local") and str(root) in found:
        return
    path = Path(tempfile.mkdtemp(prefix="plumbline-package-")) / "plumbline.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "plumbline").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))
