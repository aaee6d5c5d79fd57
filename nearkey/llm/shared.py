"""Helpers that several operators share: the shared folder, materialising, Arrow text buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nearkey.folders import checkpointed, shared_folder, shared_path  # noqa: F401
from nearkey.shipping import BATCH_BYTES, bounded_batches  # noqa: F401

#: Bytes of text that a task's numpy work holds at a time (a longer single text goes alone): it takes some 100 bytes a byte, and an executor has several workers.
CHUNK_BYTES = 1 << 19


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder: for what several branches read.

    All such tables of an application are in one folder, which can go when its results are read.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def discard(*tables: DataFrame) -> None:
    """Deletes :func:`materialised` tables that nothing reads any more: all that follows from them is written."""
    for table in tables:
        delete(table.sparkSession, table.written_to)


def delete(spark: SparkSession, written_to: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(written_to)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def in_tasks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)``, in bounded batches (:func:`nearkey.shipping.bounded_batches`)."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that text operators read, whatever else the input carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buffer = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buffer[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(batch: pa.RecordBatch, name: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of ``batch`` of at most ``limit`` bytes of text (one row at least), with bytes and offsets."""
    if not batch.num_rows:
        return
    buffer, offsets = text_bytes(batch.column(name))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), buffer[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


# --- polynomial names of byte strings, 64 bits, by prefix sums -------------------------------

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
BYTE_NAMES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], have = 1, 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


_power_cache: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_power_cache[0]) < n:
        _power_cache[:] = [_powers(_ODD, n), _powers(pow(_ODD, -1, 1 << 64), n)]
    return _power_cache[0][:n], _power_cache[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads the information of the high bits over all of them."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Names:
    """Names of substrings of one byte buffer: equal strings have equal names."""

    def __init__(self, buffer: np.ndarray):
        self.up, self.down = powers(len(buffer) + 1)
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(BYTE_NAMES[buffer] * self.up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        lengths = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + lengths * np.uint64(0xD6E8FEB86659FD93))

    def all(self, width: int) -> np.ndarray:
        """Names of all strings of ``width`` bytes, by start, without index arrays."""
        out = self.sums[width:] - self.sums[:-width]
        out *= self.down[: len(out)]
        out += np.uint64(width * 0xD6E8FEB86659FD93 & _MASK)
        return mix(out)


# --- groups of a sorted stream ---------------------------------------------------------------


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal ``keys`` (integers, no nulls) of a stream sorted by them, across batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
