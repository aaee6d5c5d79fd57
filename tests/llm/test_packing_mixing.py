import math
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from nearkey.llm import mixing, packing
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .conftest import SF, rows, same_as_oracle

PATH = packing.default_tokenizer()


def check_packing(docs, capacity=2048, most=1.06):
    got = packing.best_fit_packing(docs, PATH, capacity, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want, by_sequence = [], defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            want.append((r["doc_id"], k, at, len(cut), zlib.crc32(cut.tobytes()), cut.tolist()))
    key = lambda r: [(x is not None, x) for x in r]
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        total += at
    if total > 20 * capacity:
        assert len(by_sequence) <= most * math.ceil(total / capacity)


def test_packing_of_a_table(spark):
    check_packing(spark.read.parquet(f"{SF}/documents.parquet"))


def test_packing_of_odd_rows(odd_docs, no_docs):
    check_packing(odd_docs)
    check_packing(odd_docs, 16)
    check_packing(no_docs)


def test_word_ids_are_the_tokenizers():
    encoder = packing.WordEncoder(PATH)
    texts = ["It's we're DON'T 'sx ''s can't,stop! 123 ½ ² ﬁ", "日本 mixed", "İstanbul ǅ ß", "a\x85b\xa0c\x1cd​e", "<|endoftext|> x", "", "Σίσυφος ΟΔΟΣ", "'", "ª º µ", "--''--re'll", "é é"]
    assert encoder.encode(texts) == encoder._ids(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x24F) | st.sampled_from("'sStTmMdDrevll .,!̇̀")), max_size=4))
def test_word_ids_property(texts):
    encoder = packing.WordEncoder.__new__(packing.WordEncoder)
    encoder.__dict__.update(_shared.__dict__)
    assert encoder.encode(texts) == encoder._ids(texts)


_shared = packing.WordEncoder(PATH)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_best_fit_places_every_rank_once(counts):
    bins, seen = defaultdict(list), defaultdict(set)
    for length, a, b, first, offset in packing.best_fit(counts, 40):
        for r in range(a, b):
            assert r not in seen[length]
            seen[length].add(r)
            bins[first + r - a].append((offset, length))
    assert {k: len(v) for k, v in seen.items()} == counts
    free = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
        free += 2 * at <= 40
    assert free <= 1  # no two sequences that would fit in one


def test_mixing_equals_its_sql(spark):
    same_as_oracle(mixing.query(spark, SF), mixing.ORACLE)


def plain_targets(sizes):
    """Share by weight, cut at twice the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if rate * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: rate * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check_mix(mixed):
    by = defaultdict(list)
    for r in mixed.collect():
        by[r["source"]].append(r)
    sizes = {s: sum(r["size"] for r in x) for s, x in by.items()}
    want = plain_targets(sizes)
    for s, x in by.items():
        assert {r["source_size"] for r in x} == {sizes[s]}
        assert abs(x[0]["target"] - want[s]) < 1e-6 * max(1, want[s])
        epochs = int(want[s] // sizes[s]) if sizes[s] else 0
        assert all(r["size"] * epochs <= r["taken"] <= 2 * r["size"] for r in x)
        assert abs(sum(r["taken"] for r in x) - want[s]) <= max(r["size"] for r in x) / 2 + 1e-6


def test_mixing_targets_and_epochs(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_mix(mixing.mix(docs))
    check_mix(mixing.mix(docs, key_buckets=2))
    assert rows(mixing.mix(docs, key_buckets=2).drop("text")) == rows(mixing.mix(docs.repartition(3)).drop("text"))
    check_mix(mixing.mix(odd_docs.withColumn("source", F.coalesce("source", F.lit(None)))))


def test_mixing_of_odd_rows(odd_docs, no_docs):
    mixed = mixing.mix(odd_docs)
    assert mixed.count() == odd_docs.count()
    assert mixing.mix(no_docs).count() == 0
    assert {"size", "source_size", "target", "taken"} <= set(mixed.columns)
    assert rows(mixed.where("text is null").select("size", "taken").distinct()) == [(0, 0)]


def test_word_counts(spark):
    df = spark.createDataFrame([("a b\tc\x0bd e",), ("",), (None,), (" \n",), ("é  ß",)], "text string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("text"))).collect()] == [4, 0, 0, 0, 2]


def test_heavier_documents_come_first(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("source"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("w"))
    mixed = mixing.mix(df, F.col("w")).where("source = 'c'")
    means = {r["w"]: r["m"] for r in mixed.groupBy("w").agg(F.avg("taken").alias("m")).collect()}
    assert means[4.0] > means[1.0]
