"""The audit of sources against a plain computation."""

import re
from collections import Counter, defaultdict

import pytest
from nearkey.llm import divergence
from pyspark.sql import functions as F

from tests.llm.conftest import SF, same_as_oracle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, min_docs, top):
    """``docs`` of (text, lang, source) to the set of result rows."""
    n, holders, groups = defaultdict(Counter), defaultdict(set), set()
    for r, (text, lang, source) in enumerate(docs):
        text, lang, source = (x or "" for x in (text, lang, source))
        groups.add((lang, source))
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER)):
            n[lang, source][term] += 1
            holders[lang, term].add(r)
    kept = defaultdict(list)
    for (lang, term), own in holders.items():
        if len(own) >= min_docs:
            kept[lang].append(term)
    p = lambda count, total, size: 1 + 1_000_000_000 * (count + 5) // (total + 5 * size)
    out = set()
    totals = {(lang, s): sum(n[lang, s][t] for t in kept[lang]) for lang, s in groups}
    for lang, source in groups:
        terms = kept[lang]
        total = lambda s: totals[lang, s]
        others = [s for g, s in groups if g == lang and s != source]
        share = lambda s, t: p(n[lang, s][t], total(s), len(terms))
        pairs = [(sum(abs(share(source, t) - share(s, t)) for t in terms), s) for s in others]
        every = [s for g, s in groups if g == lang]
        whole = sum(total(s) for s in every)
        q = lambda t: p(sum(n[lang, s][t] for s in every), whole, len(terms))
        own = [(share(source, t) - q(t), t) for t in terms if n[lang, source][t] and share(source, t) > q(t)]
        for part, found, most in (("pair", pairs, None), ("term", own, top)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.add((lang, source, part, item, value, rank))
    return out


def found(df, *args, **options):
    rows = [tuple(r) for r in divergence.audit(df, *args, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source").repartition(5)


@pytest.mark.parametrize("options", [{}, {"tile": 7, "block_rows": 2000}, {"tile": 16}])
def test_tiles_and_blocks_do_not_change_the_result(spark, docs, options):
    assert found(docs, 6, 9, **options) == plain([tuple(r) for r in docs.collect()], 6, 9)


def test_small_tables_with_nulls_ties_repeats_and_groups_without_terms(spark):
    texts = ["b a É é", "A-b a", None, "", "ß x9y 日本 a"]
    data = [(t, lang, s) for i, t in enumerate(texts) for lang, s in [("en", "u"), ("en", "v"), (None, None), ("", "w"), ("fr", f"only{i}")]]
    data += [("a a b", "en", "u")] * 3 + [("zzz", "en", "none"), (None, "de", "alone"), (None, "de", None)]
    df = spark.createDataFrame(data, "text string, lang string, source string").withColumns({"term": F.lit("x"), "n": F.lit(1), "rank": F.lit(2)})
    for least in (1, 2, 4, 99):
        assert found(df, least, 2, tile=2, block_rows=3) == plain(data, least, 2)
    assert any(r[:3] == ("en", "none", "pair") for r in found(df, 4, 2))


def test_empty_table_and_a_text_of_over_a_megabyte(spark, no_docs):
    assert found(no_docs) == set()
    data = [("Aa bb\tcc-dd " * 120_000 + "q" * 700_000 + " end", "en", "x"), ("aa end é" * 9, "en", "y")]
    assert found(spark.createDataFrame(data, "text string, lang string, source string"), 1, 50) == plain(data, 1, 50)


def test_counts_flush_when_many_terms_are_held(spark, monkeypatch, docs):
    monkeypatch.setattr(divergence, "HELD", 50)
    assert found(docs, 6, 9) == plain([tuple(r) for r in docs.collect()], 6, 9)


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, size = 123_456_789_012_345_678, 987_654_321_098_765_432, 12_345
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(size)).alias("a"), divergence.share(F.lit(3), F.lit(total), F.lit(size)).alias("b")).first()
    assert row["a"] == 1 + 10**9 * (n + 5) // (total + 5 * size) and row["b"] == 1 + 8 * 10**9 // (total + 5 * size)


def test_query_equals_its_sql(spark):
    same_as_oracle(divergence.query(spark, SF), divergence.ORACLE)
