"""Connected components of an edge table by alternating large-star and small-star rounds.

(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.) Every round is two
aggregates with map-side combine and two joins back, so a hub is neither collected nor windowed;
each round is checkpointed, so lost executors cost one round. The minima are written before they
are joined: a join straight over two shuffles is one whose hot keys (a hub's edges) are split at
run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkey.llm.shared import checkpointed, discard, materialised


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)``, component the smallest node reachable.

    Loops, repeats and either direction are allowed; edges with a null end are ignored; nodes
    without an edge to another node are not listed.
    """
    now = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = _mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = materialised(low, "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialised(large, "large")
        least = materialised(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(low, large, least)
        last, seen = seen, _mark(now)
        if last == seen:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _mark(edges: DataFrame) -> tuple[int, str]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], str(row["h"])
