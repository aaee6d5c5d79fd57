"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bulk-synchronous best-fit: documents and gaps are ordered by size, every sweep gives the largest
unplaced documents the smallest gaps that hold them (their successors), conflicts are resolved by
rank, gaps shrink, and the sweep repeats. Documents of one length, and gaps of one size, are
interchangeable, so a sweep is a statement about size classes and rank ranges: the sweeps run on the driver over
the length histogram (at most ``capacity`` rows whatever the corpus), and what is distributed is
all that grows with it: tokenising, ranking within a length, and placing by (length, rank). Sweeps over the rows
themselves would be a Spark round for every document that the fullest sequence holds.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearkey.llm.shared import documents, id_and_text, in_tasks, materialised, text_chunks

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker keeps; the cache is emptied when full.
CACHED_WORDS = 500_000
#: Rows of one length that one task ranks, about.
RANK_ROWS = 250_000
#: Buckets, at least, over which rows that are alike in all columns spread.
SLOTS = 256

_PLAIN = [chr(c) for c in range(0x180)]  # no combining marks: such text is its own NFC form
_LETTERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "N")
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"
_PIECES = re.compile(f"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
_NOT_PLAIN = re.compile("[^\x00-\u017f]")


class WordEncoder:
    """Ids as the tokenizer file gives them, as little-endian 32-bit bytes.

    The tokenizer merges inside words only, so for texts of Latin letters (code points below
    U+0180, no special token in them) its ids are those of the words one by one; the words come
    from the pattern that the file states, and each different word is encoded once by the
    tokenizer itself. All other texts go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single words: encoded as one text, which the tokens that end words cut again."""
        ids = np.asarray(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._ids(words)
        data, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        words: dict[int, list[str]] = {}
        other = []
        for i, text in enumerate(texts):
            if _plain(text):
                words[i] = _PIECES.findall(text.lower())
            else:
                other.append(i)
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        new = list(set(chain.from_iterable(words.values())).difference(self.known))
        self.known.update(zip(new, self._words(new)))
        for i, x in words.items():
            out[i] = b"".join(map(self.known.__getitem__, x))
        for i, ids in zip(other, self._ids([texts[i] for i in other])):
            out[i] = ids
        return out


def _plain(text: str) -> bool:
    if "<|" in text:  # may be a special token
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _NOT_PLAIN.search(text)
    return True


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: the cut documents, with the closing id 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            for part, _, _ in text_chunks(batch, "text"):
                rows: list[tuple] = []
                encoded = encoder.encode(part.column("text").fill_null("").to_pylist())
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded):
                    ids += b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(cut) // 4, zlib.crc32(cut)) + ((np.frombuffer(cut, "<u4").astype(np.int32),) if with_ids else ()))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return in_tasks(id_and_text(docs), run, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Sweeps over size classes: ``(length, rank_from, rank_to, sequence_from, offset)``.

    Documents ``rank_from .. rank_to`` of a length go to sequences from ``sequence_from`` on, one
    each, at ``offset``. Lengths go in falling order; the successor of a length is the smallest
    gap that holds it; where several want it, lower ranks get it and the rest sweep on.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes = 0  # bit g: some gap has size g
    opened, plan = 0, []

    def put(gap: int, first: int, n: int) -> None:
        nonlocal sizes
        if gap and n:
            gaps.setdefault(gap, []).append((first, n))
            sizes |= 1 << gap

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            above = sizes >> length
            if not above:
                n = -(-left // (capacity // length))
                put(capacity, opened, n)
                opened += n
                continue
            gap = length + (above & -above).bit_length() - 1
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                sizes &= ~(1 << gap)
            take = min(n, left)
            plan.append((length, rank, rank + take, first, capacity - gap))
            put(gap, first + take, n - take)
            put(gap - length, first, take)
            rank, left = rank + take, left - take
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, with doc_id, piece and length) with ``sequence_id`` and ``offset``.

    Repeated rows are packed each. The length histogram has at most ``capacity`` rows, so the
    placement plan has a bound of its own and is broadcast.
    """
    columns = pieces.columns
    # rows of one id (or none) and one text are told apart by their place, so that none of them gather in one bucket
    slot = F.xxhash64(*[c for c in ("doc_id", "piece", "ids_crc32") if c in columns], F.pmod(F.monotonically_increasing_id(), F.lit(SLOTS)))
    pieces = materialised(pieces.withColumn("_slot", slot), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    spark = pieces.sparkSession
    buckets = int(min(1 << 20, max(16, sum(counts.values()) // RANK_ROWS)))
    dealt = pieces.withColumn("bucket", F.pmod("_slot", F.lit(buckets)).cast("int"))
    by = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(by), F.lit(0)).alias("before"))
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32", "_slot") if c in pieces.columns]
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order))).join(before, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("before")).drop("bucket", "before")
    plan = spark.createDataFrame(best_fit(counts, capacity), "length long, r0 long, r1 long, first long, offset long")
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("length", "size")), F.expr("length = size and rank >= r0 and rank < r1"))
    return placed.select(*columns, (F.col("first") + F.col("rank") - F.col("r0")).alias("sequence_id"), "offset")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All of ``docs(doc_id, text)`` in sequences of at most ``capacity`` tokens.

    A null or empty text is the closing id alone; doc_id may be null or repeated (each row is
    packed); other columns are ignored; an empty table gives no rows.
    """
    return pack(pieces(docs, tokenizer_path, capacity, with_ids), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def query(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir), default_tokenizer())
