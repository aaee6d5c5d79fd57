"""Changes of keywords, labels and edge weights: each takes and returns a table of the model.

Derived tables (postings, positions, intervals) follow from the changed tables; nothing is renumbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_keys(keywords: DataFrame, added: DataFrame) -> DataFrame:
    """``added(vertex, word)``, known words or new ones; pairs that exist change nothing."""
    return keywords.unionByName(added.select("vertex", F.lower("word").alias("word"))).distinct()


def delete_keys(keywords: DataFrame, gone: DataFrame) -> DataFrame:
    """Pairs that a vertex does not have change nothing."""
    return keywords.join(gone.select("vertex", F.lower("word").alias("word")), ["vertex", "word"], "left_anti")


def insert_labels(labels: DataFrame, added: DataFrame) -> DataFrame:
    """``added(vertex, hub, dist)``; where the pair exists, the smaller distance stays."""
    return labels.unionByName(added).groupBy("vertex", "hub").agg(F.min("dist").alias("dist"))


def delete_labels(labels: DataFrame, gone: DataFrame) -> DataFrame:
    return labels.join(gone.select("vertex", "hub"), ["vertex", "hub"], "left_anti")


def upsert_labels(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes(vertex, hub, dist)`` replace or add labels; of several changes of a pair the smallest holds.

    Both are grouped together, not joined: tables that are dealt by vertex stay as they are dealt, where a join would deal both anew.
    """
    kind = labels.schema["dist"].dataType
    old = labels.select("vertex", "hub", "dist", F.lit(None).cast(changes.schema["dist"].dataType).alias("new"))
    new = changes.select("vertex", "hub", F.lit(None).cast(kind).alias("dist"), F.col("dist").alias("new"))
    both = old.unionByName(new).groupBy("vertex", "hub").agg(F.min("dist").alias("dist"), F.min("new").alias("new"))
    return both.select("vertex", "hub", F.coalesce("new", "dist").alias("dist"))


def apply_label_changes(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes(vertex, hub, dist)`` of a network's edges, one a pair: a null ``dist`` takes the label away, others replace or add it."""
    rest = labels.join(changes.select("vertex", "hub"), ["vertex", "hub"], "left_anti")
    return rest.select("vertex", "hub", "dist").unionByName(changes.where("dist is not null").select("vertex", "hub", "dist"))


def reweighted(edges: DataFrame, factor: float, increase: bool) -> DataFrame:
    """``edges(.., dist)`` with ``dist`` grown or cut by ``factor``, truncated toward zero."""
    step = F.col("dist") * F.lit(factor)
    return edges.withColumn("dist", (F.col("dist") + step if increase else F.col("dist") - step).cast("int"))
