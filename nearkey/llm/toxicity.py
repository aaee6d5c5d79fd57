"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams,
and stems of words.

(McMahan et al., "Ad Click Prediction", 2013.) Each coordinate has its own rate, and L1 keeps all
but the telling ones at zero. Training sees a bounded, documented sample of the labelled rows
(``SAMPLE_ROWS``, chosen by hash) in ``PASSES`` online passes, at every input size alike. An online pass is
sequential, so one task makes it (``SHARDS`` above 1 trains side by side and averages the weights, at
some recall); its time is bounded by the sample, and it holds one chunk of texts. The weights are
bounded by ``2 ** BITS`` entries whatever the corpus, so they are broadcast; scoring is one pass over whole
texts with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkey.llm.shared import Names, documents, id_and_text, in_tasks, materialised, mix, text_chunks

BITS = 20
#: Bytes of a word's stems.
STEMS = (4, 6, 7)
#: The bound of the training sample, in rows.
SAMPLE_ROWS = 6_000
#: Online passes over the sample, whatever its size.
PASSES = 2
SHARDS = 1
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 1.0
THRESHOLD = 0.3
#: Rows of label 1, of all, that the rate counts beside the sample's.
PRIOR = (1, 10)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, index)`` of every unigram, bigram, one-word skip-gram and stem of the texts, with repeats.

    Stems (a word's first bytes) let inflected forms that training never saw share a weight.
    """
    inside = np.zeros(len(buffer) + 2, bool)
    inside[1:-1] = _WORD[buffer]
    edge = np.zeros(len(buffer) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    known = Names(_LOWER[buffer])
    word = known.of(start, end)
    rows, names = [row], [word]
    for step, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = np.flatnonzero(row[step:] == row[:-step]) if len(row) > step else np.zeros(0, np.int64)
        rows.append(row[same])
        names.append(mix(word[same] * np.uint64(odd) + (word[same + step] >> np.uint64(1))))
    for size in STEMS:
        long = np.flatnonzero(end - start > size)
        rows.append(row[long])
        names.append(mix(known.of(start[long], start[long] + size) * np.uint64(0x165667B19E3779F9)))
    return np.concatenate(rows), (np.concatenate(names) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Learns what moves the log odds away from ``base``, the prior's."""

    def __init__(self, base: float = 0.0, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.base, self.alpha, self.beta, self.l1, self.l2 = base, alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)  # the last is the intercept

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: float) -> None:
        """One step on the row whose features are ``at`` (each once, the intercept with them)."""
        w = self.weights(at)
        g = sigmoid(self.base + w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, shards: int = SHARDS, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse weights ``(index, weight, intercept)`` from ``labels(doc_id, toxic)``.

    Rows with a null doc_id or label are not learnt from; of several labels of a document the
    largest counts. The sample (ids and labels only) has at most ``sample_rows`` rows. Scores start
    from its rate of label 1, smoothed by ``PRIOR``, so few labels or none condemn nothing. Of document rows
    that share a doc_id one is learnt from, the one of least text hash, so the bound holds for rows too; null and empty texts by the
    intercept alone. Without labels or documents the model is the prior.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = materialised(sample, "sample")
    seen = sample.agg(F.count("*").alias("n"), F.sum((F.col("label") > 0).cast("int")).alias("toxic")).first()
    rate = ((seen["toxic"] or 0) + PRIOR[0]) / (seen["n"] + PRIOR[1])
    base = float(np.log(rate / (1 - rate)))
    rows = id_and_text(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[int, Ftrl] = {}
        for batch in batches:
            for part, buffer, offsets in text_chunks(batch, "text"):
                row, index = features(buffer, offsets)
                pair = np.unique(row * np.int64(2**BITS) + index)
                row, index = pair >> BITS, pair & (2**BITS - 1)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                for i, (shard, label) in enumerate(zip(part.column("shard").to_pylist(), part.column("label").to_pylist())):
                    models.setdefault(shard, Ftrl(base)).learn(np.r_[index[cut[i] : cut[i + 1]], 2**BITS], float(label > 0))
        for model in models.values():
            w = model.weights(slice(None))
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["at", "w"])

    steps = rows.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))
    learnt = in_tasks(steps.repartition(shards, "shard").sortWithinPartitions("shard", "pass", F.xxhash64("doc_id", "pass"), "doc_id"), run, "at long, w double")
    mean = learnt.groupBy("at").agg((F.sum("w") / shards).alias("w")).orderBy("at").toArrow()
    at, w = mean.column("at").to_numpy(), mean.column("w").to_numpy()
    return at[at < 2**BITS], w[at < 2**BITS], base + float(w[at == 2**BITS].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], carry: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``carry`` columns and ``name`` per row of ``docs(text, ..)``; an empty or null text scores as the intercept does.

    A row's score depends on its text alone, so repeated rows score alike; columns not in ``carry`` are
    ignored, and ``name`` must not be one of them. No rows in, no rows out. A ``text`` in ``carry`` goes to the workers only once.
    """
    text = "text" if "text" in carry else "_text"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, intercept = shared.value
        weights = np.zeros(2**BITS)
        weights[at] = w
        for batch in batches:
            for part, buffer, offsets in text_chunks(batch, text):
                row, index = features(buffer, offsets)
                told = weights[index] != 0
                pair = np.unique(row[told] * np.int64(2**BITS) + index[told])
                total = np.bincount(pair >> BITS, weights[pair & (2**BITS - 1)], part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carry] + [pa.array(sigmoid(total + intercept))], [*carry, name])

    read = docs.select(*carry, *[F.col("text").cast("string").alias(text)] * (text not in carry))
    return in_tasks(read, run, ", ".join(f"`{c}` {kinds[c]}" for c in carry) + f", `{name}` double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
