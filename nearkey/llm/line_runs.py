"""Line deduplication against levelled sorted runs of line hashes, in DataFrame operations only.

Documents come in batches, those of the largest ids first. The distinct line hashes of a batch are one sorted run;
it is merge-anti-joined with the runs that exist, and only what none of them has is added, as a run of level 0.
``FANOUT`` runs of a level are merged into one of the next, so n batches leave about log(n) runs, which share no hash. Since ids fall from batch to batch, the largest document that holds a line is known when its hash is added;
a hash that is met again only adds to a count. Runs are bucketed and sorted by hash, so joins and merges of runs
read them in place: only a batch's own hashes are shuffled, once.

A line's key is the line without white space at both ends, A-Z lower-cased. Hashes are two 64-bit ones with
different seeds: unequal keys meet with a chance of n * n / 2**129.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkey.llm.shared import delete, discard, documents, materialised, shared_path

BATCHES = 4
FANOUT = 2
MIN_CHARS = 40
MIN_DOCS = 5
HASH = ["h1", "h2"]
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class LineRuns:
    """Disjoint runs of rows ``(h1, h2, ..)`` by level, each a table bucketed and sorted by hash.

    There are as many buckets as shuffle partitions. Tables live in the shared folder; :meth:`drop` deletes them.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._tables: dict[str, str] = {}

    def sorted_run(self, rows: DataFrame) -> str:
        """``rows``, one a hash, written as a run that belongs to no level yet; its table's name."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = shared_path(self.spark, "run")
        dealt = rows.repartition(self.buckets, *HASH)
        dealt.write.format("parquet").option("path", path).bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name)
        self._tables[name] = path
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def fresh(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` whose hash no run has."""
        return reduce(lambda left, run: left.join(run.select(*HASH).hint("merge"), HASH, "left_anti"), self.runs(), rows)

    def add(self, rows: DataFrame) -> DataFrame | None:
        """Adds what is fresh of ``rows``, one a hash, as a run; returns the others as a written table.

        None where there was no run before, so all is fresh.
        """
        own = self.sorted_run(rows)
        if not self.levels:
            self.levels.append([own])
            return None
        batch = self.spark.table(own)
        new = self.sorted_run(self.fresh(batch))
        seen = materialised(batch.join(self.spark.table(new).select(*HASH).hint("merge"), HASH, "left_anti"), "seen")
        self.levels[0].append(new)
        self.forget([own])
        self._compact()
        return seen

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            if level + 1 == len(self.levels):
                self.levels.append([])
            merged = self.sorted_run(reduce(DataFrame.unionByName, [self.spark.table(name) for name in old]))
            self.levels[level + 1].append(merged)
            self.levels[level] = []
            self.forget(old)
            level += 1

    def forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, self._tables.pop(name))

    def drop(self) -> None:
        self.forget(list(self._tables))
        self.levels = []


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, name, pos, h1, h2, first)`` of lines whose key has ``min_chars`` code points.

    ``name`` stands for the text; ``first`` is 1 on one line of a text for each of its keys, 0 on the others.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_name(docs).alias("name"), F.transform(text_lines(docs), line_key).alias("keys"))
    hashed = lambda k, i: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"), i.alias("pos")))
    rows = rows.withColumn("at", F.array_sort(F.filter(F.transform("keys", hashed), lambda x: x.isNotNull()))).drop("keys")
    before = lambda i: F.get(F.col("at"), i - 1)
    marked = lambda x, i: F.struct(x["pos"].alias("pos"), x["h1"].alias("h1"), x["h2"].alias("h2"), F.when((i > 0) & (before(i)["h1"] == x["h1"]) & (before(i)["h2"] == x["h2"]), 0).otherwise(1).alias("first"))
    return rows.select("doc_id", "name", F.inline(F.transform("at", marked)))


def text_lines(docs: DataFrame) -> Column:
    return F.split(F.coalesce(docs["text"].cast("string"), F.lit("")), "\n", -1)


def text_name(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def batch_of(docs: DataFrame, batches: int) -> Column:
    """Batches of near equal numbers of documents by falling id, from 0; rows without an id are in the last."""
    cuts = [i / batches for i in range(1, batches)]
    bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), cuts, 10_000).alias("b")).first()["b"] if cuts else None
    place = sum((F.col("doc_id") <= F.lit(b)).cast("int") for b in sorted(set(bounds or []))) if bounds else F.lit(0)
    return F.coalesce(place, F.lit(len(set(bounds or []))))


def frequent_lines(lines: DataFrame, batches: int, min_docs: int, fanout: int = FANOUT) -> DataFrame:
    """``(h1, h2, last)``: hashes in ``min_docs`` documents or more, with the largest id; ``lines`` is partitioned by ``batch``."""
    store, seen = LineRuns(lines.sparkSession, fanout), []
    for batch in range(batches):
        own = lines.where(F.col("batch") == batch).groupBy(*HASH).agg(F.sum("first").alias("docs"), F.max("doc_id").alias("last"))
        again = store.add(own)
        if again is not None:
            seen.append(again)
    if not seen:
        found = reduce(DataFrame.unionByName, store.runs()).where(F.col("docs") >= min_docs).select(*HASH, "last")
    else:
        more = reduce(DataFrame.unionByName, seen).groupBy(*HASH).agg(F.sum("docs").alias("more"))
        more = store.spark.table(store.sorted_run(more))
        total = F.col("docs") + F.coalesce("more", F.lit(0))
        found = [run.join(more.hint("merge"), HASH, "left").where(total >= min_docs).select(*HASH, "last") for run in store.runs()]
        found = reduce(DataFrame.unionByName, found)
    found = materialised(found, "frequent")
    store.drop()
    discard(*seen)
    return found


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``: repeated lines stay only in the largest doc_id.

    A line goes if its key has ``min_chars`` code points and is in ``min_docs`` rows of ``docs`` or more. A row is a
    document: equal rows count each, and rows that share the largest doc_id all keep the line. A null doc_id is below
    every other; a line of rows without an id alone stays in all of them. A null or empty text is one empty line.
    Where all lines go, the text is empty. An empty table gives an empty one. Other columns stay; those of the three new names
    are replaced.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    path = shared_path(spark, "lines")
    staged = long_lines(docs, min_chars).withColumn("batch", batch_of(docs, batches))
    staged.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(staged.schema).parquet(path)
    lines.written_to = path
    frequent = frequent_lines(lines, batches, min_docs, fanout)
    repeats = lines.join(frequent, HASH).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = repeats.groupBy(F.col("doc_id").alias("_id"), F.col("name").alias("_named")).agg(F.collect_set("pos").alias("_gone"))
    gone = materialised(gone, "gone")
    discard(lines, frequent)
    named = docs.select(*kept).withColumn("_name", text_name(docs))
    found = named.join(gone, named["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.col("_name") == F.col("_named")), "left")
    found = found.withColumn("_lines", text_lines(found))
    rest = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    joined = F.array_join(F.transform(rest, lambda i: F.get(F.col("_lines"), i)), "\n")
    return found.select(
        *kept,
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_gone").isNull(), F.coalesce(F.col("text").cast("string"), F.lit(""))).otherwise(joined).alias("kept_text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY 1 HAVING count(DISTINCT r) >= {MIN_DOCS}
), d AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.last AS gone FROM k LEFT JOIN f USING (key)
)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY r
"""
