"""Readers and writers of the file formats of road networks, dictionaries, labels and indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, value)`` of a text file, lines numbered from 0, empty ones left out.

    Line numbers are ids in these formats. A large file is many splits, so numbering is two-level: within a
    split in reading order, after the counts of the splits that begin before it.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("at"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("file", "block").count().select("file", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    return rows.withColumn("n", number).join(before, ["file", "block"]).select((F.col("n") + F.col("before")).cast("int").alias("line"), "value").where("value <> ''")


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).where("line > 0").select("line", F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("int")).alias("n"))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """``edges(src, dst, w)`` from ``u v w`` lines after a ``V E`` header; lines need no order."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x")).where(F.size("x") == 3)
    return rows.select(*[F.col("x")[i].cast("int").alias(c) for i, c in enumerate(("src", "dst", "w"))])


def graph_header(spark: SparkSession, path: str) -> DataFrame:
    """``(vertices, edges)``."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x")).where(F.size("x") == 2)
    return rows.select(F.col("x")[0].cast("int").alias("vertices"), F.col("x")[1].cast("int").alias("edges"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``keywords(key_id, word)``: a word a line, lower case, the id its line from 0."""
    return _lines(spark, path).select(F.col("line").alias("key_id"), F.lower("value").alias("word"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(word)``: white-space tokens, case kept."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("word")).where("word <> ''")


def read_key_vertices(spark: SparkSession, path: str) -> DataFrame:
    """``vertex_keywords(vertex, key_id)`` from ``key n v1 .. vn`` lines after a header."""
    rows = _numbers(spark, path).select(F.col("n")[0].alias("key_id"), F.explode(F.slice("n", 3, 1 << 30)).alias("vertex"))
    return rows.select("vertex", "key_id").distinct()


def read_vertex_keys(spark: SparkSession, path: str) -> DataFrame:
    """The same table from ``vertex n k1 .. kn`` lines."""
    return _numbers(spark, path).select(F.col("n")[0].alias("vertex"), F.explode(F.slice("n", 3, 1 << 30)).alias("key_id")).distinct()


def read_workload(spark: SparkSession, path: str) -> DataFrame:
    """``queries(qid, vertex, key_id)`` from ``n`` and then ``vertex key`` lines."""
    return _numbers(spark, path).select((F.col("line") - 1).alias("qid"), F.col("n")[0].alias("vertex"), F.col("n")[1].alias("key_id"))


def _forward(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    at = 1
    for vertex in range(int(values[0]) if len(values) else 0):
        n = int(values[at])
        pairs = values[at + 1 : at + 1 + 2 * n].reshape(n, 2)
        yield np.full(n, vertex), pairs[:, 0], pairs[:, 1]
        at += 1 + 2 * n


def _label_forward(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    pairs = values[: len(values) // 2 * 2].reshape(-1, 2)
    end = np.flatnonzero((pairs == -1).all(1))
    pairs = pairs[: end[0]] if len(end) else pairs
    opens = pairs[:, 1] == 0
    yield pairs[opens, 0][np.cumsum(opens) - 1] if len(pairs) else pairs[:, 0], pairs[:, 0], pairs[:, 1]


def _binary_labels(spark: SparkSession, path: str, parse) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for vertex, hub, dist in parse(np.frombuffer(content, "<i4")):
                    yield pd.DataFrame({"vertex": vertex, "hub": hub, "dist": dist})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "vertex int, hub int, dist int")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``labels(vertex, hub, dist)`` from 32-bit ``V`` and, a vertex, ``n`` and n pairs (hub, dist).

    A file is one row here, so of 2 GB at most; :mod:`nearkey.sources.label_files` reads larger ones in ranges.
    """
    return _binary_labels(spark, path, _forward)


def read_label_forward(spark: SparkSession, path: str) -> DataFrame:
    """The same from (hub, dist) pairs: a pair of distance 0 opens its vertex, (-1, -1) ends."""
    return _binary_labels(spark, path, _label_forward)


def write_index(postings: DataFrame, path: str) -> None:
    """A derived table as Parquet, clustered by hub and sorted in it, so hub filters skip row groups."""
    postings.repartitionByRange("hub").sortWithinPartitions("hub", "pos").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_edges_text(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst", "w").write.mode("overwrite").option("sep", " ").csv(path)


def read_edges_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("src int, dst int, w int").option("sep", " ").csv(path)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, records)``: sizes without reading contents; records of 12 bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.expr("length div 12").alias("records"))
