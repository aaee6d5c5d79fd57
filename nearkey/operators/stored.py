"""A stored index: what a ranking reads of it, and how changes rewrite only the parts they touch.

Parquet tables in one folder, each partitioned by ``part``, a hash of its key:

- ``keywords(vertex, word)`` and ``labels(vertex, hub, dist)`` by vertex, ``holders(word, vertex)`` by word,
- ``postings(hub, vertex, dist, pos)`` of vertices with keywords by hub, sorted by (hub, dist, vertex), so that a bound on
  the distance skips pages,
- ``steps(hub, pos, dist)``: the postings at positions 0, 1, 3, 7, .., by hub: how many postings a distance reaches, within a factor of 2,
- ``rests(rest, word)`` by rest: what is left of a word's prefixes when up to ``tau`` characters are left out.

Rankings are exact and read postings in rounds of growing distance (:class:`Reach`). Once k places are known, their worst score is turned
into a distance beyond which nothing can enter; one more round reads up to it, and that is the end. After a further keystroke
the reading goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkey import folders
from nearkey.folders import delete, scratch, shared_path, tasks_for, written
from nearkey.functions.text import deletions, prefix_edit_distance, prefixes, score, spatial
from nearkey.operators import maintenance
from nearkey.operators.index import numbered_postings
from nearkey.operators.search import RESULT, best_per, multi_score

SCHEMAS = {
    "keywords": ("vertex", "vertex long, word string"),
    "holders": ("word", "word string, vertex long"),
    "labels": ("vertex", "vertex long, hub long, dist int"),
    "postings": ("hub", "hub long, vertex long, dist int, pos int"),
    "steps": ("hub", "hub long, pos int, dist int"),
    "rests": ("rest", "rest string, word string"),
}
KEYS = {"vertex": "long", "hub": "long", "word": "string", "rest": "string"}
ORDER = {"keywords": ["vertex", "word"], "holders": ["word", "vertex"], "labels": ["vertex", "hub"], "postings": ["hub", "dist", "vertex"], "steps": ["hub", "pos"], "rests": ["rest", "word"]}
PARTS = 64
#: Postings that the first round of a ranking reads, about; each further round reads ``GROWTH`` times as many.
FIRST, GROWTH = 4096, 16
#: Rows of a page, the unit that a distance bound skips.
PAGE_ROWS = 5_000


def _deletions(words: DataFrame, tau: int) -> DataFrame:
    """``(rest, word)``, each once: what repeats, repeats inside a word, so no shuffle is needed to see it."""
    rests = F.array_distinct(F.flatten(F.transform(prefixes(F.lower("word")), lambda start: deletions(start, tau))))
    return words.select("word").distinct().select(F.explode(rests).alias("rest"), "word")


@dataclass(frozen=True)
class StoredIndex:
    """The tables below ``path``; ``parts`` and ``tau`` are those of the build."""

    spark: SparkSession
    path: str
    parts: int = PARTS
    tau: int = 2

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def table(self, name: str, parts: list[int] | None = None) -> DataFrame:
        """A table, or only those of its parts."""
        rows = self.spark.read.schema(f"{SCHEMAS[name][1]}, part int").parquet(f"{self.path}/{name}")
        return rows if parts is None else rows.where(F.col("part").isin(parts))

    def parts_of(self, keys: DataFrame, column: str) -> list[int]:
        """The parts that hold the keys in ``column``: at most all ``parts`` numbers come to the driver."""
        return sorted(r["part"] for r in keys.select(self.part(F.col(column).cast(KEYS[column])).alias("part")).distinct().collect())

    def write(self, name: str, rows: DataFrame, parts: list[int] | None = None) -> None:
        """Replaces the table, or those of its parts: ``rows`` are all there is to them then."""
        key, schema = SCHEMAS[name]
        columns = [c.strip().split(" ") for c in schema.split(",")]
        # a part is as many files as keep each a bounded number of rows, also where a key (a frequent word) has most of a part's
        with scratch() as put:
            rows = rows if hasattr(rows, "written_to") else put(rows, name)
            typed = rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in columns]).withColumn("part", self.part(F.col(key)))
            sizes = typed.groupBy("part").count().agg(F.sum("count").alias("rows"), F.max("count").alias("most")).first()
            files = -(-(sizes["most"] or 1) // folders.TASK_ROWS)
            self._write_parts(name, typed.repartition(tasks_for(self.spark, sizes["rows"] or 0), "part", F.pmod(F.hash(*ORDER[name]), F.lit(files))), parts)

    def _write_parts(self, name: str, typed: DataFrame, parts: list[int] | None) -> None:
        dealt = typed.sortWithinPartitions("part", *ORDER[name])
        to = f"{self.path}/{name}"
        dealt.write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "static" if parts is None else "dynamic").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(to)
        if parts is not None:  # parts of which no row is left
            left = {r["part"] for r in self.table(name, parts).select("part").distinct().collect()}
            empty = {r["part"] for r in typed.select("part").distinct().collect()}
            for part in sorted(left - empty):
                delete(self.spark, f"{to}/part={part}")

    # --- maintenance -----------------------------------------------------------------------------

    def _held(self, who: DataFrame, parts: list[int]) -> DataFrame:
        """Postings of the vertices ``who``: their labels, if they have a keyword."""
        some = self.table("keywords", parts).select("vertex").distinct()
        return self.table("labels", parts).join(who, "vertex", "left_semi").join(some, "vertex", "left_semi").select("hub", "vertex", "dist")

    def _change(self, name: str, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Rewrites what ``changes(vertex, ..)`` touch of a table and of the postings; the parts of hubs that were rewritten."""
        with scratch() as put:
            changes = put(changes, "changes")
            who = changes.select(F.col("vertex").cast("long").alias("vertex")).distinct()
            parts = self.parts_of(who, "vertex")
            before = put(self._held(who, parts), "before")
            columns = [c.split(" ")[0] for c in SCHEMAS[name][1].split(", ")]
            self.write(name, put(change(self.table(name, parts).select(*columns), changes), "changed"), parts)
            after = self._held(who, parts).withColumnRenamed("dist", "new")
            moved = put(before.join(after, ["hub", "vertex"], "full").where("not (dist <=> new)").select("hub", "vertex", "new"), "moved")
            touched = self.parts_of(moved, "hub")
            if touched:
                rest = self.table("postings", touched).select("hub", "vertex", "dist").join(moved, ["hub", "vertex"], "left_anti")
                added = moved.where("new is not null").select("hub", "vertex", F.col("new").alias("dist"))
                self._write_postings(put(rest.unionByName(added), "postings"), touched)
            return touched

    def _write_postings(self, rows: DataFrame, parts: list[int] | None = None) -> None:
        with scratch() as put:
            numbered = put(numbered_postings(put(rows, "held")), "numbered")
            self.write("postings", numbered, parts)
            # pos + 1 is a power of two
            self.write("steps", numbered.where("pos & (pos + 1) = 0").select("hub", "pos", "dist"), parts)

    def insert_keys(self, added: DataFrame) -> list[int]:
        """``added(vertex, word)``: new words go into the deletion index too."""
        with scratch() as put:
            rests = put(_deletions(added.select(F.lower("word").alias("word")), self.tau), "rests")
            touched = self.parts_of(rests, "rest")
            known = self.table("rests", touched).select("rest", "word")
            self.write("rests", put(known.unionByName(rests).distinct(), "rests"), touched)
        return self._change_keys(added, maintenance.insert_keys)

    def delete_keys(self, gone: DataFrame) -> list[int]:
        """Words that no vertex has any more stay in the deletion index: they match nobody."""
        return self._change_keys(gone, maintenance.delete_keys)

    def _change_keys(self, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        with scratch() as put:
            changes = put(changes.select("vertex", "word"), "keys")
            words = self.parts_of(changes.select(F.lower("word").alias("word")), "word")
            self.write("holders", put(change(self.table("holders", words).select("vertex", "word"), changes), "holders"), words)
            return self._change("keywords", changes, change)

    def insert_labels(self, added: DataFrame) -> list[int]:
        return self._change("labels", added.select("vertex", "hub", "dist"), maintenance.insert_labels)

    def delete_labels(self, gone: DataFrame) -> list[int]:
        return self._change("labels", gone.select("vertex", "hub"), maintenance.delete_labels)

    def upsert_labels(self, changes: DataFrame) -> list[int]:
        return self._change("labels", changes.select("vertex", "hub", "dist"), maintenance.upsert_labels)


def build(keywords: DataFrame, labels: DataFrame, path: str | None = None, parts: int = PARTS, tau: int = 2) -> StoredIndex:
    """Writes the index of ``keywords(vertex, word)`` and ``labels(vertex, hub, dist)``; for texts of up to ``tau`` edits."""
    spark = keywords.sparkSession
    index = StoredIndex(spark, path or shared_path(spark, "index"), parts, tau)
    with scratch() as put:
        lower = put(keywords.select("vertex", F.lower("word").alias("word")).distinct(), "keywords")
        index.write("keywords", lower)
        index.write("holders", lower)
    index.write("labels", labels)
    index._write_postings(labels.join(keywords.select("vertex").distinct(), "vertex", "left_semi").select("hub", "vertex", "dist"))
    index.write("rests", _deletions(keywords, tau))
    return index


def build_dictionary(words: DataFrame, path: str | None = None, parts: int = PARTS, tau: int = 1) -> StoredIndex:
    """Only the deletion index of ``words(word)``, for :func:`match_texts`."""
    spark = words.sparkSession
    index = StoredIndex(spark, path or shared_path(spark, "index"), parts, tau)
    index.write("rests", _deletions(words, tau))
    return index


# --- reading ------------------------------------------------------------------------------------


def match_texts(index: StoredIndex, texts: DataFrame, tau: int) -> DataFrame:
    """``(text, word, ped)`` of ``texts(text)`` and the indexed words within ``tau``, from the parts that the texts' remainders are in."""
    if tau > index.tau:
        raise ValueError(f"the index is for {index.tau} edits at most")
    typed = texts.select(F.lower("text").alias("text")).distinct().select("text", F.explode(deletions(F.col("text"), tau)).alias("rest"))
    typed = written(typed, "typed")
    pairs = index.table("rests", index.parts_of(typed, "rest")).select("rest", "word").join(typed, "rest").select("text", "word").distinct()
    return pairs.withColumn("ped", prefix_edit_distance(F.col("text"), F.col("word"), tau)).where("ped is not null")


class Reach:
    """What has been read of the postings around a place: all vertices up to a distance, each with its own.

    A vertex's nearest common hub is among the postings whose two distances add up to no more than ``most``, so within it distances are
    exact. Growing reads only the postings beyond what was read. ``most`` is None when all have been.
    """

    def __init__(self, index: StoredIndex, vertex: int, put: Callable[[DataFrame, str], DataFrame]):
        self.index, self.put, spark = index, put, index.spark
        own = index.table("labels", index.parts_of(spark.range(1).select(F.lit(vertex).alias("vertex")), "vertex")).where(F.col("vertex") == vertex)
        self.own = put(own.select("hub", F.col("dist").alias("own")), "own")
        self.least = self.own.agg(F.min("own").alias("m")).first()["m"]
        self.parts = [] if self.least is None else index.parts_of(self.own, "hub")
        self.most: int | None = -1
        self.near = put(self.own.select(F.lit(0).cast("long").alias("vertex"), F.col("own").alias("dist")).limit(0), "near")

    def distance_of(self, postings: int) -> int | None:
        """A distance within which about so many postings of the own hubs are; None: all of them are fewer."""
        steps = self.index.table("steps", self.parts).join(self.own, "hub")
        gained = steps.groupBy((F.col("dist") + F.col("own")).alias("at")).agg(F.sum(F.expr("(pos + 1) div 2 + if(pos = 0, 1, 0)")).alias("n"))
        # a window over different distances, not over postings
        so_far = gained.selectExpr("at", "sum(n) over (order by at) as n")
        return so_far.where(F.col("n") >= postings).agg(F.min("at").alias("at")).first()["at"]

    def grow(self, most: int | None) -> None:
        further = between(self.index, self.own, self.parts, self.least or 0, self.most, most)
        self.near = self.put(self.near.unionByName(further.join(self.near.select("vertex"), "vertex", "left_anti")), "near")
        self.most = most


def between(index: StoredIndex, own: DataFrame, parts: list[int], least: int, beyond: int, most: int | None) -> DataFrame:
    """``(vertex, dist)`` by the postings that are farther than ``beyond`` and at most ``most`` away (None: all).

    ``own(hub, own)`` are the labels of a place, ``least`` their least distance, which bounds what pages are read.
    """
    rows = index.table("postings", parts)
    if most is not None:
        rows = rows.where(F.col("dist") <= F.lit(int(most) - least))
    near = rows.select("hub", "vertex", "dist").join(own, "hub").select("vertex", (F.col("dist") + F.col("own")).alias("dist")).where(F.col("dist") > beyond)
    if most is not None:
        near = near.where(F.col("dist") <= F.lit(int(most)))
    return near.groupBy("vertex").agg(F.min("dist").alias("dist"))


def _ranked(reach: Reach, matches: DataFrame, rate: Callable[[DataFrame], DataFrame], some: float, k: int, alpha: float, d_max: float, first: int) -> DataFrame:
    """The k best of ``matches(vertex, ped)`` by (score, srd, vertex), ``rate`` adding these; no score is below its spatial part and ``some``."""
    size = first
    if alpha == 0 and reach.most is not None:
        reach.grow(None)
    elif reach.most == -1:
        reach.grow(reach.distance_of(size))
    while True:
        found = written(rate(reach.near.join(matches, "vertex")).orderBy("score", "srd", "vertex").limit(k), "found")
        if reach.most is None:
            return found
        worst = found.agg(F.count("*").alias("n"), F.max("score").alias("s")).first()
        if worst["n"] == k:
            # one more than the bound in exact numbers: rounding must not lose a tie
            needed = int((worst["s"] - some) * d_max / alpha) + 1
            if needed <= reach.most:
                return found
            reach.grow(needed)
        else:
            further = reach.most
            while further is not None and further <= reach.most:
                size *= GROWTH
                further = reach.distance_of(size)
            reach.grow(further)
        delete(reach.index.spark, found.written_to)


def _holders(index: StoredIndex, words: DataFrame) -> DataFrame:
    return index.table("holders", index.parts_of(words, "word")).select("word", "vertex").join(words, "word")


def topk(index: StoredIndex, vertex: int, text: str, k: int = 10, tau: int = 1, alpha: float = 0.5, d_max: float = 100, first: int = FIRST) -> DataFrame:
    """The k best ``(vertex, dist, ped, score)``, those of :func:`nearkey.operators.search.topk`.

    Postings of a round of growth are at most about ``GROWTH`` times those of the round before.
    """
    found = keystroke_topk(index, vertex, text, k, tau, alpha, d_max, first, steps=[text])
    return found.orderBy("rank").select(*RESULT)


def keystroke_topk(index: StoredIndex, vertex: int, text: str, k: int = 5, tau: int = 1, alpha: float = 0.5, d_max: float = 100, first: int = FIRST, steps: list[str] | None = None) -> DataFrame:
    """The k best after every keystroke, ``(step, rank, vertex, dist, ped, score)``: those of :func:`nearkey.operators.search.keystroke_topk`.

    A step goes on from the one before: words that are out stay out, so the index of words is asked once and each step filters what is left;
    and the postings read stay read, so a step only reads on where its k-th score allows vertices beyond them. ``steps`` are the texts to
    rank, each a beginning of the next (default: all beginnings of ``text``).
    """
    spark, every = index.spark, []
    steps = [text[:i] for i in range(1, len(text) + 1)] if steps is None else steps
    with scratch() as put:
        reach = Reach(index, vertex, put)
        words = None
        for step, typed in enumerate(steps, 1):
            if words is None:
                words = match_texts(index, spark.range(1).select(F.lit(typed).alias("text")), tau).select("word", "ped")
            else:
                words = words.select("word", prefix_edit_distance(F.lit(typed), F.col("word"), tau).alias("ped")).where("ped is not null")
            words = put(words, "words")
            best = words.agg(F.min("ped").alias("m")).first()["m"]
            if best is None or reach.least is None:
                break
            matches = put(_holders(index, words).groupBy("vertex").agg(F.min("ped").alias("ped")), "matches")
            rate = lambda rows: rows.withColumns({"score": score(F.col("dist"), F.col("ped"), tau, alpha, d_max), "srd": spatial(F.col("dist"), alpha, d_max)})
            every.append(_ranked(reach, matches, rate, 0.0 if tau == 0 else (1 - alpha) * best / tau, k, alpha, d_max, first).withColumn("step", F.lit(step)))
    if not every:
        return spark.createDataFrame([], "step int, rank int, vertex long, dist int, ped int, score double")
    return best_per(reduce(DataFrame.unionByName, every), ["step"], k)


def multikey_topk(index: StoredIndex, vertex: int, texts: list[str], k: int = 5, tau: int = 1, alpha: float = 0.5, d_max: float = 100, first: int = FIRST) -> DataFrame:
    """The k best vertices that match all of ``texts``: those of :func:`nearkey.operators.search.multikey_topk`."""
    spark = index.spark
    with scratch() as put:
        reach = Reach(index, vertex, put)
        asked = put(spark.createDataFrame([(t.lower(),) for t in texts], "text string").groupBy("text").agg(F.count("*").alias("times")), "texts")
        words = put(match_texts(index, asked.select("text"), tau).join(asked, "text"), "words")
        each = _holders(index, words).groupBy("vertex", "text", "times").agg(F.min("ped").alias("ped"))
        matches = put(each.groupBy("vertex").agg(F.sum(F.col("ped") * F.col("times")).alias("ped"), F.sum("times").alias("n")).where(F.col("n") == len(texts)).drop("n"), "matches")
        best = matches.agg(F.min("ped").alias("m")).first()["m"]
        if best is None or reach.least is None:
            return spark.createDataFrame([], "vertex long, dist int, ped long, score double")
        some = 0.0 if tau == 0 else (1 - alpha) * best / (tau * len(texts))
        found = _ranked(reach, matches, lambda rows: multi_score(rows, len(texts), tau, alpha, d_max), some, k, alpha, d_max, first)
    return found.orderBy("score", "srd", "vertex").select(*RESULT)
