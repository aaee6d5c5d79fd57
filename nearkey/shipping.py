"""What every registered query runs with: the package on Python workers, and batches of one size."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]
_sent: set[str] = set()
#: Bytes of a batch that Spark hands to a Python worker. Its own default is 64 MB, which the executor holds outside the heap and the worker again, for every core.
BATCH_BYTES = 1 << 22


def bounded_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_BYTES`` (one row at least), unless the application has set a size of its own: Spark has only a setting of the session for it."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if setting not in spark.conf.getAll:
        spark.conf.set(setting, BATCH_BYTES)


def ship(spark: SparkSession) -> None:
    """Sends the package's sources with ``addPyFile``, once an application.

    Not needed, and not done, where workers have the path: by PYTHONPATH or as the folder Spark runs in.
    """
    context = spark.sparkContext
    paths = [Path(p).resolve() for p in (os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))]
    if ROOT in paths or any((p / "nearkey").exists() for p in paths) or context.applicationId in _sent:
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "nearkey.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted((ROOT / "nearkey").rglob("*.py")):
            z.write(source, source.relative_to(ROOT))
    context.addPyFile(str(archive))
    _sent.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        bounded_batches(spark)  # for every query, so that none depends on which ran before
        return query(spark, sf_dir)

    return run
