"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Targets come from water-filling over the sources. A source whose target holds e whole epochs gives
every document e times; the rest of the target is a weighted sample without replacement: documents
in the order of exponential keys ``-ln(u) / weight``, prefix-summed up to the rest. The prefix sums
are two-level, so a source with a third of all rows is not one task's: keys fall into ``KEY_BUCKETS``
buckets, a source's bucket totals (a small table) say which buckets are wholly in or out, and only
the one bucket that the rest ends in is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearkey.llm.shared import documents, materialised

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
KEY_BUCKETS = 4096
#: Draw weights of documents by their quality label; unlabelled ones have the middle one.
QUALITY_WEIGHTS = {1: 2.0, None: 1.0, 0: 0.5}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``.

    Sources in code-point order, null last, take the weights in turn. All together get ``share``
    of all sizes by weight, none over ``most`` times its own; what is over goes to the others by
    weight. That fixed point is a prefix of the sources by size per weight that stop at their most,
    and one rate for the rest. Windows here run over the table of sources, not of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    sizes = sizes.withColumn("weight", F.array(*map(F.lit, weights))[place].cast("long"))
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # the rate if exactly the sources before this one stop at their most
    rate = (F.sum("source_size").over(everything) * share - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    sizes = sizes.withColumn("rate", rate)
    full = F.col("rate") * F.col("weight") >= most * F.col("source_size")
    free = F.min(F.when(~full, F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "rate"))).over(everything)["rate"]
    return sizes.withColumn("free", free).select(
        "source", "source_size", F.when(full, F.col("source_size") * F.lit(float(most))).otherwise(F.col("free") * F.col("weight")).alias("target")
    )


def exponential_key(doc_id: Column, weight: Column, seed: int = 42) -> Column:
    """``-ln(u) / weight`` with u in (0, 1) from 52 bits of a digest of the id: reruns agree."""
    digest = F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def mix(docs: DataFrame, weight: Column | None = None, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, key_buckets: int = KEY_BUCKETS) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted) and ``times``.

    ``weight`` is the draw weight (positive; null: 1), ``size`` the size (default: words of the
    text). The document on which a source's rest ends is taken if at least half of it is within. A
    null text has size 0, of which nothing is taken; null is a source like any other; equal keys
    (repeated rows) are ordered by id and size; no rows in, no rows out; columns of ``docs`` of the new names are replaced.
    """
    one = F.lit(1.0)
    sized = docs.withColumns({
        "size": word_count(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0)),
        "_key": exponential_key(F.col("doc_id"), one if weight is None else F.coalesce(weight, one)),
    }).drop("source_size", "target", "taken", "times")
    kept = [c for c in sized.columns if c not in ("size", "_key")]
    sized = sized.withColumn("_bucket", F.floor((1 - F.exp(-F.col("_key"))) * key_buckets).cast("int"))
    cells = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("cell"))
    whole = targets(cells.groupBy("source").agg(F.sum("cell").alias("source_size")), weights, share, most)
    whole = whole.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    whole = whole.withColumn("rest", F.col("target") - F.col("source_size") * F.col("epochs")).withColumnRenamed("source", "_own")
    running = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("cell").over(running), F.lit(0)))
    plan = cells.select(F.col("source").alias("_source"), F.col("_bucket").alias("_cell"), "cell", "before").join(whole, F.expr("_source <=> _own"))
    dealt = sized.join(plan, F.expr("source <=> _source and _bucket = _cell"))
    inside = F.col("before") + F.col("cell") <= F.col("rest")
    split = (F.col("before") < F.col("rest")) & ~inside
    sure = dealt.where(~split).withColumn("more", inside.cast("long"))
    order = Window.partitionBy("_source", "_cell").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    last = dealt.where(split).withColumn("more", (start + F.col("size") / 2 <= F.col("rest")).cast("long"))
    times = (F.col("epochs") + F.col("more")).cast("int")
    return sure.unionByName(last).select(*kept, "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def quality_weight(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with a column ``draw_weight`` from ``labels(doc_id, quality)``, the largest label of an id."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    weight = F.when(F.col("_quality") > 0, QUALITY_WEIGHTS[1]).when(F.col("_quality") <= 0, QUALITY_WEIGHTS[0]).otherwise(QUALITY_WEIGHTS[None])
    return docs.join(known, "doc_id", "left").withColumn("draw_weight", weight).drop("_quality")


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    # words are counted once and before any join, so texts are neither read twice nor shuffled
    slim = materialised(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    weighted = quality_weight(slim, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed = mix(weighted, F.col("draw_weight"), F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CASE WHEN q.quality > 0 THEN 2.0 WHEN q.quality <= 0 THEN 0.5 ELSE 1.0 END AS w
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1) q ON d.doc_id = q.doc_id
), keyed AS (
  SELECT *, -ln((CAST('0x' || substr(md5('42/' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0) / w AS k FROM sized
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s FROM keyed GROUP BY 1
), weighed AS (
  SELECT *, (ARRAY[5, 2, 1])[1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS wt FROM sizes
), rated AS (
  SELECT *, (CAST(sum(s) OVER () AS DOUBLE) * 1.5 - 2 * CAST(coalesce(sum(s) OVER b, 0) AS DOUBLE))
            / CAST(sum(wt) OVER () - coalesce(sum(wt) OVER b, 0) AS DOUBLE) AS rate
  FROM weighed WINDOW b AS (ORDER BY s / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aimed AS (
  SELECT source, s AS source_size,
         CASE WHEN rate * wt >= 2 * s THEN 2.0 * s
              ELSE (SELECT r.rate FROM rated r WHERE r.rate * r.wt < 2 * r.s ORDER BY r.s / r.wt, r.source NULLS LAST LIMIT 1) * wt END AS target
  FROM rated
), summed AS (
  SELECT k.doc_id, k.size, a.source_size, CAST(a.target AS DOUBLE) AS target,
         CASE WHEN a.source_size > 0 THEN CAST(floor(a.target / a.source_size) AS BIGINT) ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN aimed a ON k.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN before + size / 2 <= target - source_size * epochs THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""
