"""Substring dedup by hashing units of text: lines, paragraphs or sentences.

Units are normalised (case folded, punctuation and white space collapsed) and named by 128-bit
digests; digests are grouped globally with map-side combine, the occurrence that ranks first is
kept, the others are removed, and their original offsets are returned. Units without a letter or digit
are none. With ``least_words`` above 1, shorter units are no evidence: short sentences join the next long
one of their line, and what stays short is never removed.

Rows are named by their id and a hash of their text, so rows that share an id are documents of their own.
They rank by id (rows without one last), then by that hash; rows that repeat whole are one document.

Passages that repeat without being whole units are found exactly, at every word: a word goes when
it lies in ``passage_words`` words that stand earlier too. A window of so many words is represented
by its least-named gram, which its own words decide; consecutive windows of one representative are
a run, a row. Runs that are unique leave; of equal runs all but the first go whole; only what is left
is compared window by window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkey.llm.shared import Names, discard, documents, in_tasks, materialised, mix, powers, text_chunks

LEAST_WORDS = 1
_LAST = (1 << 63) - 1
#: Words of a window of the passages that go wherever they stand, and of the grams that represent it.
PASSAGE_WORDS = 50
GRAM_WORDS = 8
_LINE = re.compile(r"[^\n]+")
_PARAGRAPH = re.compile(r"\S[^\n]*(?:\n[^\S\n]*\S[^\n]*)*")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
_SKIP = re.compile(r"[\W_]+")


def units(text: str, kind: str, least_words: int) -> Iterator[tuple[int, int, str]]:
    """``(start, end, normalised)`` of the units with enough words; offsets in code points."""
    for piece in (_PARAGRAPH if kind == "paragraph" else _LINE).finditer(text):
        if kind != "sentence":
            cuts = [(piece.start(), piece.end())]
        else:
            cuts, start, words = [], piece.start(), 0
            for s in _SENTENCE.finditer(text, piece.start(), piece.end()):
                words = max(words, len(s.group().split()))
                if words >= least_words:
                    cuts.append((start, s.end()))
                    start, words = s.end(), 0
            if start < piece.end():
                cuts.append((start, piece.end()))
        for a, b in cuts:
            plain = _SKIP.sub(" ", text[a:b]).strip().casefold()
            if plain and plain.count(" ") + 1 >= least_words:
                yield a, b, plain


def named_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, doc, text)``: the rank of a row (its id; without one, the last) and the hash that tells rows of one rank apart."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.coalesce(doc_id, F.lit(_LAST)).alias("doc_id"), F.xxhash64(doc_id, text).alias("doc"), text.alias("text"))


def unit_digests(named: DataFrame, kind: str, least_words: int) -> DataFrame:
    """``(doc_id, doc, start, end, d1, d2)``, a row per unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in text_chunks(batch, "text"):
                rows, digests = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    for a, b, plain in units(text or "", kind, least_words):
                        rows.append((i, a, b))
                        digests.append(hashlib.blake2b(plain.encode(), digest_size=16).digest())
                if rows:
                    at, starts, ends = (np.array(x) for x in zip(*rows))
                    d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    names = [part.column(c).to_numpy()[at] for c in ("doc_id", "doc")]
                    arrays = [*names, starts.astype(np.int32), ends.astype(np.int32), d[:, 0].copy(), d[:, 1].copy()]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["doc_id", "doc", "start", "end", "d1", "d2"])

    return in_tasks(named, run, "doc_id long, doc long, start int, end int, d1 long, d2 long")


def repeated_units(named: DataFrame, kind: str = "paragraph", least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, doc, start, end)`` of every unit but the first of its text by (doc_id, doc, start)."""
    found = materialised(unit_digests(named, kind, least_words), "units")
    first = found.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialised(first, "first-units")  # so that the join is over two shuffles, whose hot keys are split
    return found.join(first, ["d1", "d2"]).where(F.struct("doc_id", "doc", "start") > F.col("first")).select("doc_id", "doc", "start", "end")


_tables: list[np.ndarray] = []


def _code_points() -> list[np.ndarray]:
    """Which code points are in words (as ``_SKIP`` has it), and a name for each."""
    if not _tables:
        n = 0x110000
        _tables[:] = [np.fromiter((chr(c).isalnum() for c in range(n)), bool, n), mix(np.arange(1, n + 1, dtype=np.uint64))]
    return _tables


class _Sequences(Names):
    """Names of runs of any 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[:-1], out=self.sums[1:])


class _Windows:
    """Windows of ``words`` words of some texts: representatives, names and places."""

    def __init__(self, texts: list[str], words: int):
        in_word, named = _code_points()
        joined = "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        edge = np.diff(in_word[points].astype(np.int8), prepend=0, append=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        folded, a, b = joined.casefold(), self.start, self.end
        if len(folded) != len(joined):  # a letter became several
            shift = np.r_[0, np.cumsum(np.fromiter((len(c.casefold()) for c in joined), np.int64, len(joined)))]
            a, b = shift[a], shift[b]
        self.begin = np.r_[0, np.cumsum([len(t) + 1 for t in texts])][:-1]
        self.doc = np.searchsorted(self.begin, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts)))
        self.words, self.n = words, max(0, len(self.start) - words + 1)
        self.names = _Sequences(_Sequences(named[np.frombuffer(folded.encode("utf-32-le"), np.uint32)]).of(a, b))
        self.real = self.doc[: self.n] == self.doc[words - 1 :][: self.n]
        gram = min(GRAM_WORDS, words)
        at = np.arange(max(0, len(self.start) - gram + 1))
        least, size, width = self.names.of(at, at + gram), 1, words - gram + 1
        while self.n and size < width:
            more = min(size, width - size)
            least, size = np.minimum(least[:-more], least[more:]), size + more
        self.rep = least[: self.n]

    def rows(self, part: pa.RecordBatch, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        """A row per run of windows ``first`` to ``last``; ``at`` counts words, the rest code points."""
        doc, end = self.doc[first], last + self.words
        ids, docs = (part.column(c).to_numpy()[doc] for c in ("doc_id", "doc"))
        arrays = [ids, docs, first - self.first[doc], last - first + 1, self.start[first] - self.begin[doc], self.end[end - 1] - self.begin[doc]]
        names = [self.rep[first].view(np.int64), self.names.of(first, end).view(np.int64)]
        types = [np.int64, np.int64, np.int32, np.int32, np.int32, np.int32, np.int64, np.int64]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(arrays + names, types)], ["doc_id", "doc", "at", "n", "start", "end", "d1", "d2"])


_RUN = "doc_id long, doc long, at int, n int, start int, end int, d1 long, d2 long"


def passage_runs(named: DataFrame, words: int) -> DataFrame:
    """A row per run of consecutive windows with one representative ``d1``; ``d2`` names all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in text_chunks(batch, "text"):
                w = _Windows([t or "" for t in part.column("text").to_pylist()], words)
                at = np.flatnonzero(w.real)
                if len(at):
                    cut = np.flatnonzero((np.diff(at) != 1) | (w.rep[at[1:]] != w.rep[at[:-1]]))
                    yield w.rows(part, at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]])

    return in_tasks(named, run, _RUN)


def _windows_of(named: DataFrame, runs: DataFrame, words: int) -> DataFrame:
    """A row per window of ``runs``, from the texts again."""
    places = runs.groupBy("doc_id", "doc").agg(F.collect_set(F.struct("at", "n")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in text_chunks(batch, "text"):
                w = _Windows([t or "" for t in part.column("text").to_pylist()], words)
                step = np.zeros(w.n + 1, np.int64)
                for first, places in zip(w.first.tolist(), part.column("places").to_pylist()):
                    for x in places:
                        step[first + x["at"]] += 1
                        step[first + x["at"] + x["n"]] -= 1
                at = np.flatnonzero((np.cumsum(step)[: w.n] > 0) & w.real)
                if len(at):
                    yield w.rows(part, at, at)

    return in_tasks(named.join(places, ["doc_id", "doc"]), run, _RUN)


def _against_first(rows: DataFrame, words: int, name: str) -> DataFrame:
    """``rows`` with ``gone``: an equal row stands earlier and, in the same document, without overlap."""
    first = rows.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "doc", "at")).alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    first = materialised(first, name)
    other = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("doc") != F.col("first.doc"))
    later = (F.struct("doc_id", "doc", "at") > F.col("first")) & (other | (F.col("at") >= F.col("first.at") + words))
    return rows.join(first, ["d1", "d2"], "left").withColumn("gone", F.coalesce(later, F.lit(False))).drop("first")


def _met(runs: DataFrame, words: int, name: str) -> DataFrame:
    """``runs`` whose representative is another's too, or occurs again inside the run."""
    again = words - min(GRAM_WORDS, words) + 1
    shared = runs.groupBy("d1").agg(F.count("*").alias("_n"), F.max("n").alias("_longest")).where(f"_n > 1 or _longest > {again}").select("d1")
    return runs.join(materialised(shared, name), "d1")


def repeated_passages(named: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """``(doc_id, doc, start, end)``, overlapping: all of ``words`` words that stand earlier by (doc_id, doc, place) too."""
    every = materialised(passage_runs(named, words), "runs")
    runs = materialised(_met(every, words, "shared-grams"), "shared-runs")
    discard(every)
    judged = materialised(_against_first(runs, words, "first-runs"), "judged-runs")
    discard(runs)
    # what a run that goes whole could show of others, the first of its equals shows too, and earlier
    left = materialised(_met(judged.where("not gone").drop("gone"), words, "left-grams"), "left-runs")
    windows = materialised(_windows_of(named, left, words), "windows")
    found = judged.unionByName(_against_first(windows, words, "first-windows")).where("gone")
    return found.select("doc_id", "doc", "start", "end")


def merged(spans: list[dict]) -> list[dict]:
    """Sorted spans, overlapping ones as one."""
    out: list[dict] = []
    for x in spans:
        if out and x["start"] < out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], x["end"])
        else:
            out.append(dict(x))
    return out


def remove_repeated(docs: DataFrame, kind: str = "paragraph", least_words: int = LEAST_WORDS, passage_words: int | None = None) -> DataFrame:
    """``docs(doc_id, text, ..)`` with ``text`` cut and ``removed array<struct<start, end>>``, offsets in the original text.

    With ``passage_words``, repeated passages of so many words go too; overlapping spans are one. Rows
    that share a doc_id are compared like any others; rows without one rank last; of rows that repeat whole, all keep
    what the first of them keeps. Null stays null and an empty text empty, with nothing removed. A column
    ``removed`` of ``docs`` is replaced, all others pass; an empty table gives no rows.
    """
    named = named_rows(docs)
    found = repeated_units(named, kind, least_words)
    if passage_words is not None:
        found = found.unionByName(repeated_passages(named, passage_words))
    spans = found.groupBy(F.col("doc_id").alias("_rank"), F.col("doc").alias("_doc")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_removed"))
    spans = materialised(spans, "spans")
    columns = [c for c in docs.columns if c != "removed"]
    mine = docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_own_rank"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("_own_doc"))
    joined = mine.join(spans, F.expr("_own_rank = _rank and _own_doc = _doc"), "left")
    joined = joined.withColumn("removed", F.coalesce("_removed", F.expr("cast(array() as array<struct<start:int,end:int>>)")))
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = [], []
            for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist()):
                removed = merged(removed)
                cuts.append(removed)
                if text and removed:
                    out, done = [], 0
                    for x in removed:
                        out.append(text[done : x["start"]])
                        done = max(done, x["end"])
                    text = "".join(out) + text[done:]
                texts.append(text)
            batch = batch.set_column(at, "text", pa.array(texts, batch.schema.field("text").type))
            yield batch.set_column(len(columns), "removed", pa.array(cuts, batch.schema.field("removed").type))

    result = joined.select(*columns, "removed")
    return in_tasks(result, run, result.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Paragraphs of any length, and repeated passages of ``PASSAGE_WORDS`` words; a line may repeat."""
    kept = remove_repeated(documents(spark, sf_dir).select("doc_id", "text", F.octet_length("text").alias("n_bytes")), passage_words=PASSAGE_WORDS)
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    cut = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return kept.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"), F.size("removed").cast("long").alias("n_removed"),
        cut.alias("removed_chars"), spans.alias("spans"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
