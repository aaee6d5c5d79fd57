"""Nearest neighbours by a block matrix join over int8 tiles with error bounds.

Queries and candidates are dealt into blocks by a hash of their ids, so that a block's rows do not
depend on the table's order or skew; each (query block, candidate block) pair is one unit of work.
In a unit, unit vectors are quantised to int8 with a scale each; the tile of int8 products (exact
integers) times the scales is within a known bound of the cosines: for q = q' + e and c = c' + f,
``|q.c - q'.c'| <= |e| |c| + |q'| |f|``. Pairs whose upper bound reaches the k-th best lower bound are
recomputed from the original vectors in double; the rest cannot be among the k. Each unit gives k
rows a query, and heaps merge them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkey.llm.shared import materialised, sorted_groups
from nearkey.llm.vectors import cosines, matrix, unit, usable

K = 5
QUERY_BLOCK = 1024
BLOCK = 8192
#: Rounding of norms and sums, far above double precision's.
SLACK = 1e-9
STEP = 128  # queries of a tile
HANDED = 10_000  # result rows that a task holds


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the norms of the quantised vectors and of what is lost."""
    scale = np.abs(v).max(1) / 127
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.sqrt((back * back).sum(1)), np.sqrt(((v - back) ** 2).sum(1))


def _tile_top(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best candidates of each query of a unit, found through the int8 tile."""
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # integers that the product holds exactly
    qc, qs, qn, qe = quantised(unit(q))
    cc, cs, _, ce = quantised(unit(c))
    cc = np.ascontiguousarray(cc.T).astype(exact)
    for at in range(0, len(q), STEP):
        part = slice(at, at + STEP)
        near = (qc[part].astype(exact) @ cc) * (qs[part, None] * cs[None, :])
        bound = qe[part, None] + qn[part, None] * ce[None, :] + SLACK
        own = qid[part, None] == cid[None, :]
        low = np.where(own, -np.inf, near - bound)
        least = np.partition(low, -k, axis=1)[:, -k] if len(cid) >= k else np.full(len(low), -np.inf)
        i, j = np.nonzero(~own & (near + bound >= least[:, None]))
        score = cosines(q[part][i], c[j])
        order = np.lexsort((cid[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i)  # where the query's rows begin
        best = np.arange(len(i)) - first < k
        yield qid[part][i[best]], cid[j[best]], score[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows of ``vectors`` by cosine for each row of ``queries``.

    Both have ``vec_id`` and ``embedding``; other columns are ignored. Vectors that are null, zero
    or hold null or non-finite components, and rows without an id, take no part; only vectors of
    one dimension are compared. Rows with the query's id are its own and no candidates. Ties go to
    the smaller id; candidate rows that repeat count each. A query id that repeats has one list: of its
    vectors the least in array order asks. No rows in, no rows out.
    """
    every, asked = materialised(usable(vectors), "vectors"), usable(queries)
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    blocks = max(1, -(-every.count() // block))
    query_blocks = max(1, -(-asked.count() // query_block))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    q = asked.withColumn("qb", deal(query_blocks)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(0))
    c = every.withColumn("cb", deal(blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("side", F.lit(1))
    units = ["dim", "qb", "cb"]

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, units):
            dim, side = group.column("dim")[0].as_py(), group.column("side").to_numpy()
            ids, m = group.column("vec_id").to_numpy(), matrix(group.column("v"), dim)
            if (side == 0).any() and (side == 1).any():
                for x in _tile_top(ids[side == 0], m[side == 0], ids[side == 1], m[side == 1], k):
                    yield pa.RecordBatch.from_arrays([pa.array(y) for y in x], ["query_id", "vec_id", "score"])

    def heaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in sorted_groups(batches, ["query_id"]):
            pairs = zip((-group.column("score").to_numpy()).tolist(), group.column("vec_id").to_pylist())
            query = group.column("query_id")[0].as_py()
            out += [(query, r, v, -s) for r, (s, v) in enumerate(heapq.nsmallest(k, pairs), 1)]
            if len(out) >= HANDED:
                yield handed(out)
                out = []
        if out:
            yield handed(out)

    def handed(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), kinds)], ["query_id", "rank", "vec_id", "score"])

    columns = ["dim", "qb", "cb", "side", "vec_id", "v"]
    paired = q.select(*columns).unionByName(c.select(*columns)).repartition(*units).sortWithinPartitions(*units)
    best = paired.mapInArrow(tiles, "query_id long, vec_id long, score double")
    return best.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(heaps, "query_id long, rank int, vec_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
