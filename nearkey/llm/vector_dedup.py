"""Embedding near-duplicates by sorted projection passes, followed by an exact check of every label.

Every pass gives each vector the concatenated signs of random projections and orders the vectors of a label by that string;
neighbours in the order are compared in double, and verified pairs are united across passes. Codes travel without their
vectors: all passes are one range sort of (pass, label, code, node), which gives positions, and vectors then meet their positions
once a pass. The order is cut into units of ``UNIT`` rows, whose last window is also the begin of the next, so windows do
not end at partitions; inside a unit a tile of ``WINDOW`` rows is compared with itself and the one before. Equal vectors are one node
throughout. Passes need only connect what belongs together (a tile returns a spanning forest); the links of a
vector are then counted exactly inside its component, large components in tile pairs.

The number of passes follows from the label's size and the angles in a sample of it, so that the expected share of missed
pairs at the threshold stays ``MISSED`` at most, up to ``MOST_PASSES``. An exact check follows in every label, whatever its size: all
pairs of tiles, where a vector is copied as often as the label has tiles. So the result does not rest on the passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkey.llm.components import connected_components
from nearkey.llm.shared import materialised, sorted_groups
from nearkey.llm.simhash import _forest
from nearkey.llm.vectors import cosines, matrix, unit, usable

COSINE = 0.93
PASSES = 16
BITS = 63
WINDOW = 128
#: Rows of the order that a task compares, besides the window before them.
UNIT = 16_384
#: Passes that a label gets at most.
MOST_PASSES = 32
#: Rows of a tile of the exact check; smaller labels have up to 16 smaller tiles.
EXACT_TILE = 8192
EXACT_TILES = 16
#: Expected share of pairs at the threshold that the passes over a larger label may miss.
MISSED = 0.001
#: Vectors of a label whose angles set its number of passes, about.
SAMPLE = 512
#: Rows of a tile when links are counted inside a component.
COUNT_TILE = 1024
SEED = 20240301


def _linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have a cosine of at least ``least``; close calls by :func:`cosines`."""
    near = unit(a) @ unit(b).T
    out = near >= least
    i, j = np.nonzero(np.abs(near - least) < 1e-9)
    if len(i):
        out[i, j] = cosines(a[i], b[j]) >= least
    return out


def passes_for(vectors: np.ndarray, size: int, least: float, window: int, passes: int) -> int:
    """Passes that a label of ``size`` vectors needs, by a sample of it; ``passes`` at least.

    A pair meets in a pass about when its codes agree on as many leading bits as leave a window's
    rows; two vectors agree on a bit with probability 1 - angle / pi. Pairs that are linked anyway
    do not count as crowding.
    """
    if len(vectors) < 2 or size <= window:
        return passes
    near = unit(vectors) @ unit(vectors).T
    agree = np.where(near >= least, 0.0, 1 - np.arccos(np.clip(near, -1, 1)) / np.pi)
    low, high = np.zeros(len(vectors)), np.full(len(vectors), 4096.0)
    for _ in range(40):
        bits = (low + high) / 2
        crowded = size * (agree ** bits[:, None]).sum(1) / (len(vectors) - 1) > 1.5 * window
        low, high = np.where(crowded, bits, low), np.where(crowded, high, bits)
    met = np.minimum((1 - np.arccos(least) / np.pi) ** low, 1 - 1e-9)
    while ((1 - met) ** passes).mean() > MISSED:
        passes += max(1, passes // 16)
    return passes


def label_passes(nodes: DataFrame, sizes: DataFrame, least: float, passes: int, window: int, most: int = MOST_PASSES) -> DataFrame:
    """``(grp, dim, size, passes, settled)`` of the labels of ``sizes(grp, dim, size)``, all in ``nodes``: whether ``most`` passes are enough."""

    def run(table: pa.Table) -> pa.Table:
        grp, dim, size = (table.column(c)[0].as_py() for c in ("grp", "dim", "size"))
        n = passes_for(matrix(table.column("v"), dim), size, least, window, passes)
        return pa.table({"grp": pa.array([grp], pa.int64()), "dim": pa.array([dim], pa.int32()), "needed": pa.array([n], pa.int32())})

    sample = nodes.join(sizes, ["grp", "dim"]).where(F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("size")) < SAMPLE)
    found = sample.select("grp", "dim", "size", "v").groupBy("grp", "dim").applyInArrow(run, "grp long, dim int, needed int")
    needed = F.coalesce("needed", F.lit(passes))
    return materialised(sizes.join(found, ["grp", "dim"], "left").select("grp", "dim", "size", F.least(needed, F.lit(max(most, passes))).alias("passes"), (needed <= most).alias("settled")), "label-passes")


def pass_keys(nodes: DataFrame) -> DataFrame:
    """``nodes(node, grp, dim, v, passes)`` for every pass, with ``code``, the signs of its projections, and without the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        shift = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, 1024):
                    rows = part.slice(at, 1024)
                    wanted, v = rows.column("passes").to_numpy(), unit(matrix(rows.column("v"), dim))
                    for p in range(int(wanted.max())):
                        if (dim, p) not in planes:
                            planes[dim, p] = np.random.default_rng([SEED, dim, p]).standard_normal((dim, BITS))
                        some = wanted > p
                        codes = ((v[some] @ planes[dim, p] > 0) * shift).sum(1)
                        arrays = [rows.column(c).filter(pa.array(some)) for c in ("node", "grp", "dim")]
                        yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(codes), p, np.int32)), pa.array(codes)], ["node", "grp", "dim", "pass", "code"])

    return nodes.select("node", "grp", "dim", "v", "passes").mapInArrow(run, "node long, grp long, dim int, pass int, code long")


def exact_edges(nodes: DataFrame, sizes: DataFrame, least: float = COSINE, tile: int = COUNT_TILE, large: int = EXACT_TILE) -> DataFrame:
    """``(a, b)``: edges that connect all linked vectors of the labels of ``sizes(grp, dim, size)``."""
    tiles = F.greatest(F.least(F.ceil(F.col("size") / tile), F.lit(EXACT_TILES)), F.ceil(F.col("size") / large)).cast("int")
    dealt = nodes.join(sizes.withColumn("tiles", tiles).drop("size"), ["grp", "dim"])
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    units = dealt.select("grp", "dim", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["grp", "dim", "i", "j"]):
            dim, i, j = (group.column(c)[0].as_py() for c in ("dim", "i", "j"))
            node, at, rows = group.column("node").to_numpy(), group.column("tile").to_numpy(), group.column("v").combine_chunks()
            first, second = np.flatnonzero(at == i), np.flatnonzero(at == j)
            other = matrix(rows.take(pa.array(second)), dim)
            for k in range(0, len(first), 512):
                some = first[k : k + 512]
                a, b = _forest(_linked(matrix(rows.take(pa.array(some)), dim), other, least), node[some], node[second])
                keep = a != b
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    keys = ["grp", "dim", "i", "j"]
    return units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long").distinct()


def candidate_edges(nodes: DataFrame, least: float = COSINE, passes: int = PASSES, window: int = WINDOW, unit_rows: int = UNIT) -> DataFrame:
    """``(a, b)``: edges that connect the vectors which the passes find linked."""
    order = ["pass", "grp", "dim", "code", "node"]
    keyed = pass_keys(nodes if "passes" in nodes.columns else nodes.withColumn("passes", F.lit(passes)))
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    ordered = materialised(ordered.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "passes")
    # positions across partitions, from the partitions' sizes: as many rows as partitions
    sizes = ordered.groupBy("_part").count().orderBy("_part").collect()
    start, starts = 0, []
    for r in sizes:
        starts.append((r["_part"], start))
        start += r["count"]
    offsets = nodes.sparkSession.createDataFrame(starts, "_part int, _start long")
    placed = ordered.join(F.broadcast(offsets), "_part").withColumn("pos", F.col("_start") + F.col("_row"))
    own = F.floor(F.col("pos") / unit_rows).cast("long")
    ends = F.pmod("pos", F.lit(unit_rows)) >= unit_rows - window
    placed = placed.select("node", "grp", "pass", "pos", F.explode(F.when(ends, F.array(own, own + 1)).otherwise(F.array(own))).alias("unit"))
    met = placed.join(nodes.select("node", "dim", "v"), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["unit", "pass", "grp", "dim"]):
            node, m = group.column("node").to_numpy(), matrix(group.column("v"), group.column("dim")[0].as_py())
            for at in range(0, len(node), window):
                from_, to = max(0, at - window), at + window
                a, b = _forest(_linked(m[from_:to], m[at:to], least), node[from_:to], node[at:to])
                keep = a != b
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    keys = ["unit", "pass", "grp", "dim"]
    return met.repartition("unit").sortWithinPartitions(*keys, "pos").mapInArrow(compare, "a long, b long").distinct()


def count_links(members: DataFrame, least: float = COSINE, tile: int = COUNT_TILE) -> DataFrame:
    """``members(node, component, copies, dim, v)`` to ``(node, linked)``: copies of the other linked nodes."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = members.join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    units = dealt.select("component", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "copies", "dim", "v")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["component", "i", "j"]):
            node, copies, at = (group.column(c).to_numpy() for c in ("node", "copies", "tile"))
            first, second = at == group.column("i")[0].as_py(), at == group.column("j")[0].as_py()
            dims, rows = group.column("dim").to_numpy(), group.column("v")
            total = np.zeros(len(node), np.int64)
            for dim in np.unique(dims).tolist():
                a, b = np.flatnonzero(first & (dims == dim)), np.flatnonzero(second & (dims == dim))
                if len(a) and len(b):
                    link = _linked(matrix(rows.take(a), dim), matrix(rows.take(b), dim), least) & (node[a][:, None] != node[b][None, :])
                    total[a] += link @ copies[b]
                    if not np.array_equal(a, b):
                        total[b] += link.T @ copies[a]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total)], ["node", "linked"])

    keys = ["component", "i", "j"]
    found = units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(count, "node long, linked long")
    return found.groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, least: float = COSINE, passes: int = PASSES, window: int = WINDOW, exact_rows: int | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors(vec_id, embedding, label)``.

    Unusable vectors, and rows without a label, link with nothing: no links, their own component.
    Rows without a vec_id link with nothing, their component is null and they are not kept. Rows that
    share vec_id are one node of the components. Only vectors of one label and dimension compare. No rows in, no rows out.
    All labels are checked exactly; with ``exact_rows`` only those of so many different vectors at most and those that passes do not settle.
    """
    rows = usable(vectors.where("label is not null"), F.col("label").cast("long").alias("grp"))
    nodes = materialised(rows.groupBy("grp", "dim", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "nodes")
    member = materialised(rows.join(nodes, ["grp", "dim", "v"]).select("vec_id", "node", "copies"), "members")
    shared = member.where("vec_id <> node").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    twice = shared.join(nodes.select(F.col("node").alias("a")), "a", "left_semi")  # an id with several vectors
    sizes = materialised(nodes.groupBy("grp", "dim").agg(F.count("*").alias("size")), "label-sizes")
    labels = label_passes(nodes, sizes, least, passes, window)
    edges = candidate_edges(nodes.join(labels.select("grp", "dim", "passes"), ["grp", "dim"]), least, passes, window)
    some = F.lit(True) if exact_rows is None else (F.col("size") <= exact_rows) | ~F.col("settled")
    check = labels.where(some).select("grp", "dim", "size")
    edges = edges.unionByName(exact_edges(nodes, check, least))
    component = materialised(connected_components(edges.unionByName(twice)), "components")
    linked = materialised(count_links(nodes.join(component, "node"), least), "linked")
    per_node = member.join(component, "node", "left").join(linked, "node", "left")
    per_row = per_node.groupBy("vec_id").agg(F.max(F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.min(F.coalesce("component", "node")).alias("component_id"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(per_row, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN l ON r.other = l.a
), c AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1
)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1) n USING (vec_id)
"""
