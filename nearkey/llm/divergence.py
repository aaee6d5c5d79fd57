"""How the sources of a language differ in their terms: distances of all pairs of sources, and each source's own terms.

Tasks count terms a (language, source) at a time and flush what they hold, so counts are combined before the shuffle.
A pair's distance is a sum over the kept terms of a function of two counts. Terms with equal counts are alike, so
it is evaluated on a joint count histogram: blocks of terms are matrices (sources by terms), each pair of
their rows gives its different (count, count) combinations with multiplicities, these are added over blocks,
and the function is evaluated once a combination. Terms that neither source has are no rows: how many there are
follows from the size of the vocabulary. Languages with many sources are dealt into tiles of ``TILE``.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearkey.llm.shared import CHUNK_BYTES, documents, in_tasks, materialised, sorted_groups

MIN_DOCS = 30
TOP = 50
UNIT = 1_000_000_000
SMOOTHING = 5
#: Different terms that a task holds before it hands over its counts.
HELD = 200_000
#: Rows (source, term) of a block; a block is a matrix of at most TILE times so many counts, twice.
BLOCK_ROWS = 1 << 16
TILE = 64
#: Of lower-cased UTF-8: letters and all that is not ASCII.
TERM, OTHER = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, by at most about ``CHUNK_BYTES`` of it at a time."""
    at = 0
    while at < len(text):
        end = OTHER.search(text, at + CHUNK_BYTES)
        to = end.start() if end else len(text)
        yield TERM.findall(text, at, to)
        at = to


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)`` of ``docs(lang, source, text)``: occurrences, and documents that have it; null is empty."""
    fields = [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, holders) in found.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                same = lambda x: pa.array([x] * len(n), pa.string())
                columns = [same(lang), same(source), terms, pa.array(list(n.values()), pa.int64()), pa.array([holders[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])
            found.clear()

        for batch in batches:
            held = 0
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary())):
                n, holders = found[lang, source]
                own: set[bytes] = set()
                for terms in _pieces(text.as_py().lower()):
                    n.update(terms)
                    own.update(terms)
                holders.update(own)
                held += len(own)
                if held >= HELD:
                    if sum(len(x) for x, _ in found.values()) >= HELD:
                        yield from flush()
                    held = 0
            if sum(len(x) for x, _ in found.values()) >= HELD:
                yield from flush()
        yield from flush()

    some = in_tasks(docs, run, "lang string, source string, term string, n long, docs long")
    return some.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, size: Column) -> Column:
    """``1 + floor(UNIT * (n + 5) / (total + 5 * size))``, exactly."""
    below = total + SMOOTHING * size
    short = F.call_function("div", F.lit(UNIT).cast("long") * (n + SMOOTHING), below)
    long = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + SMOOTHING).cast("decimal(20,0)"), below.cast("decimal(20,0)"))
    return F.when(n < (1 << 63) // UNIT - SMOOTHING, short).otherwise(long) + 1


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, source, term, n, lang_n, first)`` of terms in ``min_docs`` documents of the language; ``first`` marks one row a (lang, term)."""
    term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).withColumns({
        "_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "first": (F.row_number().over(term.orderBy("source")) == 1).cast("int"),
    })
    return counted.where(F.col("_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "first")


def sized_groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, total, lang_total, size, place, sources)`` of every group, places from 0 by source within a language."""
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("_first"))
    of_lang = Window.partitionBy("lang")
    rows = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").fillna(0, ["total", "_first"])
    return rows.select(
        "lang", "source", "total", F.sum("total").over(of_lang).alias("lang_total"), F.sum("_first").over(of_lang).alias("size"),
        (F.row_number().over(of_lang.orderBy("source")) - 1).alias("place"), F.count("*").over(of_lang).cast("int").alias("sources"),
    )


def _combinations(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of two count vectors without (0, 0), and how often each is met."""
    some = (a > 0) | (b > 0)
    ua, ia = np.unique(a[some], return_inverse=True)
    ub, ib = np.unique(b[some], return_inverse=True)
    code, times = np.unique(ia * len(ub) + ib, return_counts=True)
    return ua[code // max(len(ub), 1)], ub[code % max(len(ub), 1)], times


def joint_histograms(kept: DataFrame, groups: DataFrame, block_rows: int = BLOCK_ROWS, tile: int = TILE) -> DataFrame:
    """``(lang, a, b, na, nb, times)``: of the places a < b, how many kept terms have counts (na, nb), not both zero."""
    blocks = max(1, -(-kept.count() // block_rows))
    placed = kept.join(groups.select("lang", "source", "place", "sources"), ["lang", "source"])
    dealt = placed.select("lang", F.xxhash64("lang").alias("unit"), F.xxhash64("term").alias("name"), "place", "sources", "n", F.floor(F.col("place") / tile).cast("int").alias("t"))
    dealt = dealt.withColumn("block", F.pmod("name", F.lit(blocks)).cast("int")).withColumn("u", F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / tile).cast("int"))))
    dealt = dealt.withColumns({"i": F.least("t", "u"), "j": F.greatest("t", "u")}).drop("t", "u")
    keys = ["unit", "block", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, keys):
            lang, (i, j) = group.column("lang")[0], (group.column(k)[0].as_py() for k in "ij")
            sources = group.column("sources")[0].as_py()
            places = sorted({p for t in (i, j) for p in range(t * tile, min(sources, (t + 1) * tile))})
            _, term = np.unique(group.column("name").to_numpy(), return_inverse=True)
            counts = np.zeros((len(places), term.max() + 1), np.int64)
            counts[np.searchsorted(places, group.column("place").to_numpy()), term] = group.column("n").to_numpy()
            for x, a in enumerate(places):
                rows = [(b, *_combinations(counts[x], counts[y])) for y, b in enumerate(places) if a < b and (a // tile, b // tile) == (i, j)]
                if not rows:
                    continue
                second = np.repeat([r[0] for r in rows], [len(r[3]) for r in rows])
                out = [pa.array(np.full(len(second), a), pa.int32()), pa.array(second, pa.int32()), *(pa.array(np.concatenate([r[k] for r in rows]), pa.int64()) for k in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(second)), *out], ["lang", "a", "b", "na", "nb", "times"])

    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    part = dealt.mapInArrow(run, "lang string, a int, b int, na long, nb long, times long")
    return part.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("times").alias("times"))


def source_distances(kept: DataFrame, groups: DataFrame, block_rows: int = BLOCK_ROWS, tile: int = TILE) -> DataFrame:
    """``(lang, source, item, value)`` of every two sources of a language, both ways."""
    own = lambda x: groups.select("lang", F.col("place").alias(x), F.col("total").alias(f"total_{x}"), F.col("source").alias(f"source_{x}"), *(["size"] if x == "a" else []))
    pairs = own("a").join(own("b"), "lang").where("a < b")
    apart = F.abs(share(F.col("na"), F.col("total_a"), F.col("size")) - share(F.col("nb"), F.col("total_b"), F.col("size")))
    joint = joint_histograms(kept, groups, block_rows, tile).join(own("a").drop("source_a"), ["lang", "a"]).join(own("b").drop("source_b"), ["lang", "b"])
    sums = joint.groupBy("lang", "a", "b").agg(F.sum(apart * F.col("times")).alias("some"), F.sum("times").alias("terms"))
    zero = F.lit(0).cast("long")
    none = F.abs(share(zero, F.col("total_a"), F.col("size")) - share(zero, F.col("total_b"), F.col("size")))
    value = F.when(F.col("size") == 0, zero).otherwise(F.coalesce("some", zero) + (F.col("size") - F.coalesce("terms", zero)) * none)
    found = pairs.join(sums, ["lang", "a", "b"], "left").withColumn("value", value)
    ways = F.array(*[F.struct(F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item")) for x, y in ("ab", "ba")])
    return found.select("lang", F.inline(ways), "value")


def own_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: a source's terms whose share is above the language's, and by how much."""
    sized = kept.join(groups.select("lang", "source", "total", "lang_total", "size"), ["lang", "source"])
    over = share(F.col("n"), F.col("total"), F.col("size")) - share(F.col("lang_n"), F.col("lang_total"), F.col("size"))
    return sized.select("lang", "source", F.col("term").alias("item"), over.alias("value")).where("value > 0")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block_rows: int = BLOCK_ROWS, tile: int = TILE) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of ``docs(text, lang, source)``; other columns are ignored.

    Part ``pair``: the distances of a group (lang, source) to the language's other sources, largest first; part
    ``term``: its ``top`` terms above the language's share. Ties go by the item's UTF-8 bytes. Null text, lang and source are empty ones;
    a row is a document, equal rows count each; a group whose documents have no kept term is one of zero counts; a
    language without kept terms has distances 0 and no terms; a group alone in its language has no pair. No documents, no rows.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = materialised(kept_terms(docs, min_docs), "terms")
    groups = materialised(sized_groups(docs, kept), "groups")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_distances(kept, groups, block_rows, tile).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(ranked))
    terms = own_terms(kept, groups).withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), v AS (
  SELECT lang, term, count(*) AS lang_n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= {MIN_DOCS}
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY 1, 2, 3
), l AS (
  SELECT lang, count(*) AS size, sum(lang_n) AS lang_total FROM v GROUP BY 1
), s AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2
), cell AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
         1 + (CAST({UNIT} AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * l.size) AS p,
         1 + (CAST({UNIT} AS HUGEINT) * (v.lang_n + 5)) // (l.lang_total + 5 * l.size) AS q
  FROM g JOIN v ON g.lang = v.lang JOIN l ON l.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT m.lang, m.source, o.source AS item, sum(abs(m.p - o.p)) AS value FROM cell m JOIN cell o ON m.lang = o.lang AND m.term = o.term AND m.source <> o.source GROUP BY 1, 2, 3
  ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), term AS (
  SELECT lang, source, term AS item, p - q AS value FROM cell WHERE n > 0 AND p > q
), every AS (
  SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' FROM term
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every
) WHERE part = 'pair' OR rank <= {TOP}
"""
