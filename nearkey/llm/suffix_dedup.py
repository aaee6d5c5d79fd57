"""Exact substring dedup: every byte under a string of ``length`` bytes that also starts elsewhere.

Prefix doubling ranks positions by ever longer strings: rows (rank, position) are grouped by the
rank of what they have matched so far and of what follows it, get new ranks, and leave when they are unique or
past the threshold. Ranking every byte needs some 16 bytes a byte of text and round, so this is
its sparse form. A window of ``length`` bytes is represented by its anchor, the start of the
``GRAM``-byte string in it whose name is least (a choice that only the window's own bytes decide, so
equal windows have equal anchors); neighbouring windows of one anchor are one row:

* the rank of the anchor's gram is the first rank; rows whose rank is unique leave;
* rows with equal rank and an equal string under all their windows are past the threshold: all
  their windows are repeated, and they leave as spans (one of them stays as a partner of others);
* the others are cut into blocks of windows and ranked again by longer strings (what all windows
  of a block share: ``GRAM`` bytes, then ``length`` - 15, - 3, and at last ``length``), until nothing is left.

Ranks are 64-bit names (polynomials by prefix sums) compared only within equal gram ranks; equality of
bytes is not verified, so of n rows some pair is mistaken with a probability of about n * n / 2**65.
Texts are named by a hash, whatever rows they stand in: copies are one text whose count says that all
of it is repeated, and cost no more than one. Groups are counted by aggregates and met again by joins over two
shuffles, whose hot keys are split, rather than ranked in one sorted partition each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkey.llm.shared import Names, discard, documents, in_tasks, materialised, mix, text_chunks

LENGTH = 200
GRAM = 64
BLOCKS = (16, 4, 1)
#: Bytes of text that are ranked at a time: a worker holds some 100 bytes a byte, and an executor has several workers.
SEGMENT = 1 << 18
_LOW = np.uint64((1 << 28) - 1)


def _least_over(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    more = width - have
    return np.minimum(values[: len(values) - more], values[more:]) if more else values


def anchors(buffer: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``(row, anchor, first, last, rank, whole)``: runs of windows with one anchor.

    Positions count from the row's start; ``first`` and ``last`` are the starts of the run's first and last windows;
    ``rank`` names the gram, ``whole`` the string under all windows of the run.
    """
    empty = np.zeros(0, np.int64)
    if len(buffer) < length:
        return (empty,) * 4 + (empty.view(np.uint64),) * 2
    names = Names(buffer)
    ranks = names.all(gram)
    least = _least_over((ranks & ~_LOW) | np.arange(len(ranks), dtype=np.uint64), length - gram + 1)
    anchor = (least & _LOW).astype(np.int64)
    start = np.arange(len(anchor))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(start)]
    good = start + length <= offsets[1:][row]
    start, anchor, row = start[good], anchor[good], row[good]
    if not len(start):
        return (empty,) * 4 + (empty.view(np.uint64),) * 2
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    first, last = start[cut], start[np.r_[cut[1:] - 1, len(start) - 1]]
    row, anchor = row[cut], anchor[cut]
    return row, anchor - offsets[row], first - offsets[row], last - offsets[row], ranks[anchor], names.of(first, last + length)


def _segments(buffer: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The chunk itself, or overlapping parts of a single long text: each window is in one part."""
    if len(buffer) <= 4 * SEGMENT:
        yield buffer, offsets, 0
        return
    for at in range(0, len(buffer) - length + 1, SEGMENT):
        part = buffer[at : at + SEGMENT + length - 1]
        yield part, np.array([0, len(part)]), at


def anchor_rows(named: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(rank, whole, doc, at, lo, hi)``; ``lo`` and ``hi`` are the distances from window start to anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buffer, offsets in text_chunks(batch, "text", SEGMENT):
                doc = part.column("doc").to_numpy()
                for piece, cuts, base in _segments(buffer, offsets, length):
                    row, anchor, first, last, rank, whole = anchors(piece, cuts, length, gram)
                    arrays = [rank.view(np.int64), whole.view(np.int64), doc[row], (anchor + base).astype(np.int32), (anchor - last).astype(np.int32), (anchor - first).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["rank", "whole", "doc", "at", "lo", "hi"])

    return in_tasks(named.select("doc", "text"), run, "rank long, whole long, doc long, at int, lo int, hi int")


def contexts(named: DataFrame, left: DataFrame, length: int) -> DataFrame:
    """``(doc, at, lo, hi, rank, settled, bytes)``: the string under the windows of the rows ``left``."""
    wanted = left.groupBy("doc").agg(F.collect_list(F.struct("at", "lo", "hi", "rank", "settled")).alias("wanted"))
    joined = named.select("doc", "text").dropDuplicates(["doc"]).join(wanted, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buffer, offsets in text_chunks(batch, "text"):
                data = buffer.tobytes()
                lists = part.column("wanted")
                n = np.asarray(lists.value_lengths())
                row, flat = np.repeat(np.arange(part.num_rows), n), lists.flatten()
                at, lo, hi = (flat.field(c).to_numpy() for c in ("at", "lo", "hi"))
                start, end = offsets[row] + at - hi, offsets[row] + at - lo + length
                arrays = [pa.array(part.column("doc").to_numpy()[row]), pa.array(at), pa.array(lo), pa.array(hi), flat.field("rank"), flat.field("settled"), pa.array([data[a:b] for a, b in zip(start, end)], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc", "at", "lo", "hi", "rank", "settled", "bytes"])

    return in_tasks(joined, run, "doc long, at int, lo int, hi int, rank long, settled boolean, bytes binary")


def block_rows(rows: DataFrame, size: int, length: int, gram: int) -> DataFrame:
    """Rows ``(doc, at, lo, hi, rank, settled, to, bytes)`` cut into aligned blocks of ``size`` windows.

    ``bytes`` ends the windows up to distance ``to`` from the anchor, of which ``lo .. hi`` are asked for. ``inner``
    names what all windows of the (whole) block share, ``whole`` what lies under those asked for.
    """
    most = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buffer, offsets in text_chunks(batch, "bytes", SEGMENT):
                at, lo, hi, far = (part.column(c).to_numpy() for c in ("at", "lo", "hi", "to"))
                n = hi // size - lo // size + 1
                row = np.repeat(np.arange(len(n)), n)
                block = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + (lo // size)[row]
                first, last = np.maximum(block * size, lo[row]), np.minimum(block * size + size - 1, hi[row])
                zero = offsets[row] + far[row]  # where the anchor is in the buffer
                names = Names(buffer)
                inner = names.of(zero - block * size, zero - np.minimum(block * size + size - 1, most) + length)
                whole = names.of(zero - last, zero - first + length)
                inner = mix(inner + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                whole = mix(whole + (first * 256 + last).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                arrays = [part.column("rank").to_numpy()[row], inner.view(np.int64), whole.view(np.int64), part.column("doc").to_numpy()[row], at[row], first.astype(np.int32), last.astype(np.int32), part.column("settled").to_numpy(zero_copy_only=False)[row]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["rank", "inner", "whole", "doc", "at", "lo", "hi", "settled"])

    schema = "rank long, inner long, whole long, doc long, at int, lo int, hi int, settled boolean"
    return in_tasks(rows.select("doc", "at", "lo", "hi", "rank", "settled", "to", "bytes"), run, schema)


def _rerank(rows: DataFrame, group: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """One round over ``rows``: spans of those past the threshold, and the rows to rank again, both written.

    Rows of equal (rank, whole, lo, hi) lie under equal windows. Where there are several (``n`` copies count each),
    all are past, and one stays as a settled partner for rows that share only some of its windows. Of
    what stays, only ``group``s go on that still hold two rows and one that is not settled.
    """
    keys = ["rank", "whole", "lo", "hi"]
    # aggregates are written before they are joined: a join straight over two shuffles is one
    # whose hot keys (a rank that many rows have) are split at run time
    rows = materialised(rows, name)
    equal = materialised(rows.groupBy(*keys).agg(F.sum("n").alias("all"), F.min(F.struct("doc", "at")).alias("first")).where("all > 1"), f"{name}-equal")
    told = materialised(rows.join(equal, keys, "left"), f"{name}-told")
    past = materialised(told.where("all > 1 and not settled").select("doc", "at", "lo", "hi"), f"{name}-past")
    stay = told.where("all is null or struct(doc, at) = first").withColumn("settled", F.expr("settled or all is not null"))
    going = stay.groupBy(*group).agg(F.count("*").alias("rows"), F.bool_and("settled").alias("idle")).where("rows > 1 and not idle").select(*group)
    going = materialised(going, f"{name}-going")
    again = materialised(stay.join(going, group, "left_semi").select("doc", "at", "lo", "hi", "rank", "settled"), f"{name}-again")
    discard(rows, equal, told, going)
    return past, again


def repeated_spans(named: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc, start, end)`` of ``named(doc, text)``: bytes under windows that start more than once; spans may overlap."""
    rows = materialised(anchor_rows(named, length, gram), "anchors")
    twice = materialised(rows.groupBy("rank").count().where("count > 1").select("rank"), "grams")
    live = materialised(rows.join(twice, "rank", "left_semi"), "live")  # an aggregate over this join would keep a hot rank together
    past, again = _rerank(live.groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("settled", F.lit(False)), ["rank"], "ranked")
    discard(rows, twice, live)
    every = [past]
    text = rows = materialised(contexts(named, again, length).withColumn("to", F.col("hi")), "contexts")
    for size in BLOCKS:
        past, again = _rerank(block_rows(rows, size, length, gram).withColumn("n", F.lit(1)), ["rank", "inner"], f"blocks{size}")
        every.append(past)
        if size > 1:
            part = again.select("doc", "at", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("settled").alias("settled2"))
            rows = text.join(part, ["doc", "at"]).where("lo2 between lo and hi").select("doc", "at", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "rank", F.col("settled2").alias("settled"), "to", "bytes")
    discard(text)
    return reduce(DataFrame.unionByName, every).select("doc", (F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + length).alias("end"))


def _covered(n: int, spans: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Flags of ``n`` bytes under ``spans``, and their maximal runs."""
    if not spans.is_valid:
        return np.zeros(n, bool), np.zeros((0, 2), np.int64)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, spans.values.field("start").to_numpy(), 1)
    np.add.at(change, spans.values.field("end").to_numpy(), -1)
    gone = np.cumsum(change)[:-1] > 0
    return gone, np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2)


def remove_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """``carry``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (byte offsets) and ``kept`` per row of ``docs(text)``.

    ``kept`` are the remaining bytes, or with ``digest`` their SHA-256 in hex, so that texts do not leave
    the task. A null text is empty; texts shorter than ``length`` bytes keep all; doc_id may be null or
    repeated; rows that repeat whole (with or without one id) are copies and lose all of ``length`` bytes or more;
    columns of ``docs`` other than ``carry`` are ignored; an empty table gives no rows.
    """
    named = docs.select(*carry, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).withColumn("_doc", F.xxhash64("_text"))
    spans = repeated_spans(named.select(F.col("_doc").alias("doc"), F.col("_text").alias("text")), length, gram)
    spans = materialised(spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("_found")), "spans")
    kinds = dict(named.dtypes)
    joined = named.join(spans, F.col("_doc") == F.col("doc"), "left").select(*carry, "_text", "_found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buffer, offsets in text_chunks(batch, "_text"):
                out: list[list] = [[] for _ in range(5)]
                for i, found in enumerate(part.column("_found")):
                    text = buffer[offsets[i] : offsets[i + 1]]
                    gone, runs = _covered(len(text), found)
                    kept = text[~gone].tobytes() if len(runs) else text.tobytes()
                    for x, v in zip(out, (len(text), int(gone.sum()), len(runs), runs.tolist(), hashlib.sha256(kept).hexdigest() if digest else kept)):
                        x.append(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string() if digest else pa.binary())
                arrays = [part.column(c) for c in carry] + [pa.array(x, k) for x, k in zip(out, types)]
                yield pa.RecordBatch.from_arrays(arrays, [*carry, "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + f", n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept {'string' if digest else 'binary'}"
    return in_tasks(joined, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    found = remove_repeated(documents(spark, sf_dir), digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))
