"""The model's tables derived from the driver's star schema.

Parts are vertices, suppliers hubs; a part's label holds its suppliers with the least quantity as
distance; the words of a part's name, type and brand are its keywords.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkey.folders import tasks_for


@dataclass(frozen=True)
class Model:
    """``keywords(vertex, word)``, ``labels(vertex, hub, dist)`` and ``edges(src, dst, w)``."""

    keywords: DataFrame
    labels: DataFrame

    @property
    def edges(self) -> DataFrame:
        """Vertex-hub edges in both directions; hubs are numbered below zero."""
        out = self.labels.select("vertex", (-F.col("hub") - 1).alias("hub"), "dist")
        return out.select(F.col("vertex").alias("src"), F.col("hub").alias("dst"), F.col("dist").alias("w")).unionByName(
            out.select(F.col("hub").alias("src"), F.col("vertex").alias("dst"), F.col("dist").alias("w"))
        )


def star_model(spark: SparkSession, sf_dir: str) -> Model:
    part, lineitem = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    text = F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    # both tables are dealt by vertex, in tasks of a bounded number of rows, and meet without another shuffle; rows are counted in the files' footers
    n = tasks_for(spark, lineitem.count())
    part, lineitem = part.repartition(n, "p_partkey"), lineitem.repartition(n, "l_partkey")
    words = part.select(F.col("p_partkey").alias("vertex"), F.explode(F.split(text, " ")).alias("word")).where("word <> ''").distinct()
    labels = lineitem.groupBy(F.col("l_partkey").alias("vertex"), F.col("l_suppkey").alias("hub")).agg(F.min("l_quantity").cast("int").alias("dist"))
    return Model(words, labels)


#: The same tables for the SQL oracle.
SQL = """
vertex_keywords AS (
  SELECT DISTINCT vertex, word FROM (
    SELECT p_partkey AS vertex, unnest(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ')) AS word FROM part) WHERE word <> ''
), hop_labels AS (
  SELECT l_partkey AS vertex, l_suppkey AS hub, CAST(min(l_quantity) AS INTEGER) AS dist FROM lineitem GROUP BY 1, 2
)"""
