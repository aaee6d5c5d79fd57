"""Near-duplicates by SimHash, with links found by tiled exact comparison.

Fingerprints are the contract's: ASCII letters lower-cased, words ``[^\\x20\\x09-\\x0D]+``, XXH64
(seed 42) of every run of three words, majority per bit. Numpy compares tiles of fingerprints by
exclusive-or and bit counts. Rows are tiled by population count, and pairs of tiles whose counts differ by
more than the radius are not compared: such fingerprints cannot be within it.

Population counts lie close together, so over a whole table that skip alone would leave a constant share of
all pairs. Two fingerprints within three bits agree in one of four 16-bit quarters, so rows are dealt by
(quarter, value) first and tiled inside. A bucket beyond ``TILE`` rows is cut into tiles that are work units of
their own, by count and a hash slot, so a hot bucket spreads over the cluster. A unit returns a
spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkey.llm.components import connected_components
from nearkey.llm.shared import documents, id_and_text, in_tasks, materialised, text_chunks

RADIUS = 3
#: Rows of a tile; 2,048 squared links are 4 MB as booleans.
TILE = 2048
#: Rows of the tiles that one task compares inside a smaller bucket.
INNER_TILE = 256
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LANES = np.uint64(0x0101010101010101)


def _hashes(text: bytes, width: int) -> list[int]:
    words = text.translate(_LOWER).split()
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    digest = xxhash.xxh64_intdigest
    return [digest(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(width))))]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes; ``counts`` are the groups' sizes.

    Eight bit positions are counted at once in the byte lanes of 64-bit sums over at most 255 rows.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sizes = counts[full]
    starts = np.cumsum(sizes) - sizes
    blocks = -(-sizes // 255)
    first = np.cumsum(blocks) - blocks
    inner = np.arange(blocks.sum()) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 255 * inner
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, at).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        out[full] |= ((2 * total > sizes[:, None]).astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit))).sum(1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, text_hash, fp)``: one row per input row; null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buffer, offsets in text_chunks(batch, "text"):
                data = buffer.tobytes()
                lists = [_hashes(data[a:b], width) for a, b in zip(offsets[:-1], offsets[1:])]
                counts = np.fromiter(map(len, lists), np.int64, len(lists))
                flat = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(majority(flat, counts).view(np.int64))], ["doc_id", "text_hash", "fp"])

    return in_tasks(id_and_text(docs).withColumn("text_hash", F.xxhash64("text")), run, "doc_id long, text_hash long, fp long")


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (as stars) of the links ``near`` between nodes ``left`` and ``right``."""
    far = np.iinfo(np.int64).max
    label_l, label_r = left.copy(), right.copy()
    linked_l, linked_r = near.any(1), near.any(0)
    near, label_l, label_r = near[linked_l][:, linked_r], label_l[linked_l], label_r[linked_r]
    left, right = left[linked_l], right[linked_r]
    if not len(left):
        return left, left
    while True:
        new_r = np.minimum(label_r, np.where(near, label_l[:, None], far).min(0))
        new_l = np.minimum(label_l, np.where(near, new_r[None, :], far).min(1))
        if (new_l == label_l).all() and (new_r == label_r).all():
            return np.r_[left, right], np.r_[label_l, label_r]
        label_l, label_r = new_l, new_r


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= radius


def _bucket_links(key: np.ndarray, pc: np.ndarray, node: np.ndarray, fp: np.ndarray, radius: int, tile: int = INNER_TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside runs of equal ``key``, rows sorted by (key, population count).

    Runs of up to 32 rows are compared side by side, each row with the next ones whose counts are within the
    radius; longer ones as pairs of tiles.
    """
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[cut, len(key)])
    short = np.repeat(sizes <= 32, sizes)
    k, c, n, f = key[short], pc[short], node[short], fp[short]
    for d in range(1, 32):
        near = np.flatnonzero((k[d:] == k[:-d]) & (c[d:] - c[:-d] <= radius))
        if not len(near):  # nor farther on, as counts rise
            break
        hit = near[np.bitwise_count(f[near + d] ^ f[near]) <= radius]
        yield n[hit], n[hit + d]
    for at, size in zip(cut[sizes > 32], sizes[sizes > 32]):
        tiles = [slice(x, min(x + tile, at + size)) for x in range(at, at + size, tile)]
        for i, one in enumerate(tiles):
            for two in tiles[i:]:
                if pc[two.start] - pc[one.stop - 1] > radius:
                    break
                yield _forest(_near(fp[one], fp[two], radius), node[one], node[two])


def links(reps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``reps(node, fp)``, fingerprints all different, to ``(a, b)``: edges that connect what links connect."""
    if radius > 3:
        raise ValueError("four quarters prove links of at most three bits")
    quarters = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(65535)).alias("v")) for i in range(4)])
    rows = reps.withColumn("q", F.explode(quarters)).select((F.col("q.i") * 65536 + F.col("q.v")).alias("key"), F.bit_count("fp").cast("int").alias("pc"), "node", "fp")
    hot = materialised(rows.groupBy("key").count().where(F.col("count") > tile).select("key"), "crowded")

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            got = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, ("key", "pc", "node", "fp"))]
            to = int(np.searchsorted(got[0], got[0][-1])) if len(got[0]) else 0  # the last bucket may go on
            held = [x[to:] for x in got]
            yield from out(*(x[:to] for x in got))
        yield from out(*held)

    def out(key, pc, node, fp):
        if len(key):
            for a, b in _bucket_links(key, pc, node, fp.view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    found = rows.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key", "pc").mapInArrow(cold, "a long, b long")

    crowded = rows.join(hot, "key")
    tiles = crowded.groupBy("key", "pc").agg(F.ceil(F.count("*") / tile).cast("int").alias("slots"))
    crowded = crowded.join(tiles, ["key", "pc"]).withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int"))
    one = tiles.select("key", F.col("pc").alias("pc1"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("s1"))
    two = tiles.select("key", F.col("pc").alias("pc2"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("s2"))
    units = one.join(two, "key").where(
        F.col("pc2").between(F.col("pc1"), F.col("pc1") + radius) & ((F.col("pc2") > F.col("pc1")) | (F.col("s2") >= F.col("s1")))
    )
    unit = ["key", "pc1", "s1", "pc2", "s2"]
    left = crowded.select("key", F.col("pc").alias("pc1"), F.col("slot").alias("s1"), "node", "fp").join(units, ["key", "pc1", "s1"])
    right = crowded.select("key", F.col("pc").alias("pc2"), F.col("slot").alias("s2"), "node", "fp").join(units, ["key", "pc2", "s2"])
    right = right.select(*[F.col(c).alias(c) for c in (*unit, "node", "fp")])  # attributes of its own for the cogroup

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        near = _near(a["fp"].to_numpy().view(np.uint64), b["fp"].to_numpy().view(np.uint64), radius)
        x, y = _forest(near, a["node"].to_numpy(), b["node"].to_numpy())
        return pd.DataFrame({"a": x, "b": y})

    dense = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInPandas(compare, "a long, b long")
    return found.unionByName(dense)


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs(doc_id, text)``; other columns are ignored.

    Every row is a node, so a null or repeated doc_id is allowed: component_id is the smallest
    non-null doc_id of the rows reachable (null if there is none). Equal fingerprints are compared
    once, under the fingerprint as node. No rows in, no rows out.
    """
    return grouped(docs, width, radius, tile).select("doc_id", "fp", "component_id")


def grouped(docs: DataFrame, width: int = 3, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """:func:`near_duplicates` with ``text_hash`` and ``component``, which tells groups of one component_id apart."""
    found = materialised(fingerprints(docs, width), "simhash")
    reps = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    component = connected_components(links(reps.select(F.col("fp").alias("node"), "fp"), radius, tile))
    named = reps.join(component.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return found.join(named.join(least, "component").select("fp", "component", "component_id"), "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
