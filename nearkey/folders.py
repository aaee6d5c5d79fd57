"""The folder that driver and executors share, and what is kept in it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode only.

    On a cluster a machine's own folder would hold tables that other machines cannot read, so there the
    setting is required.
    """
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if context.getCheckpointDir() is None:
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return named or context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, to be deleted when its results have been read."""
    return f"{shared_folder(spark).rstrip('/')}/nearkey-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into the shared folder, and read from there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


#: Rows that a task sorts or groups, about, whatever the input's size.
TASK_ROWS = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for ``rows``: Spark's run-time coalescing goes by compressed bytes, of which narrow rows have few, and would give a core a share of all rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """:func:`written` for tables that nothing reads once the block has ended: they are deleted then."""
    made: list[DataFrame] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    try:
        yield put
    finally:
        for table in made:
            delete(table.sparkSession, table.written_to)


def delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
