"""Line runs against a plain count, and the runs themselves."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from nearkey.llm import line_runs
from pyspark.sql import functions as F

from tests.llm.conftest import SF, rows, same_as_oracle

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(line_runs.UPPER, line_runs.LOWER)


def plain(docs, min_chars=40, min_docs=5):
    """``docs`` of (doc_id, text) to sorted (doc_id, n_lines, n_dropped, kept_text)."""
    key = lambda line: line.strip(WHITE).translate(LOWER)
    holders = defaultdict(list)
    for doc_id, text in docs:
        for k in {key(line) for line in (text or "").split("\n")}:
            holders[k].append(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        gone = lambda k: len(k) >= min_chars and len(holders[k]) >= min_docs and doc_id != max((h for h in holders[k] if h is not None), default=None)
        kept = [line for line in lines if not gone(key(line))]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def dropped(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = line_runs.drop_repeated_lines(df, **options).select("doc_id", "n_lines", "n_dropped", "kept_text")
    return sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0] is not None, r))


LINE = "This line is long enough to be judged, and many hold it"
OTHER = "Übergrößenträger straße ßßß and more letters, 40 code points at least"


def test_lines_of_many_documents_stay_in_the_last(spark):
    docs = [(i, f"a\n  {LINE.upper() if i % 2 else LINE}\t\n{OTHER}\nown {i}\n") for i in range(7)]
    docs += [(i, OTHER.replace("Ü", "ü")) for i in range(10, 13)] + [(20, f"{LINE}\n{LINE}\n\r{LINE}"), (21, ""), (22, None)]
    assert dropped(spark, docs) == plain(docs)
    assert ("\n".join([LINE, LINE, "\r" + LINE])) in {r[3] for r in dropped(spark, docs)}


def test_null_ids_repeated_rows_and_ties(spark):
    docs = [(None, f"{LINE}\nx")] * 6 + [(None, OTHER)] * 5 + [(3, f"{LINE}\n{LINE}")] * 2 + [(2, LINE)]
    assert dropped(spark, docs) == plain(docs)
    assert dropped(spark, docs, batches=1) == plain(docs)


def test_no_line_of_short_keys_or_few_documents_goes(spark):
    docs = [(i, "short line\n" + LINE) for i in range(4)] + [(9, "short line")]
    assert all(r[2] == 0 for r in dropped(spark, docs))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 6)), st.lists(st.sampled_from(["ab", "AB ", "cd", "", " e", "é"]), max_size=5).map("\n".join)), min_size=1, max_size=12))
def test_small_thresholds_equal_a_plain_count(spark, docs):
    assert dropped(spark, docs, min_chars=1, min_docs=3, batches=3) == plain(docs, 1, 3)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (6, 3)])
def test_batches_and_levels_do_not_change_the_result(spark, batches, fanout):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = [tuple(r) for r in docs.collect()]
    found = line_runs.drop_repeated_lines(docs, 10, 2, batches, fanout)
    assert sorted(tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()) == plain(texts, 10, 2)


def test_runs_are_disjoint_sorted_and_few(spark):
    store, seen = line_runs.LineRuns(spark, 2), []
    for batch in range(7):
        more = store.add(spark.range(batch * 50, batch * 50 + 100).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), F.lit(batch).alias("batch")))
        seen.append(0 if more is None else more.count())
    assert seen == [0] + [50] * 6
    held = [r["h2"] for run in store.runs() for r in run.collect()]
    assert sorted(held) == list(range(400))
    assert [len(level) for level in store.levels] == [1, 1, 1]
    assert store.fresh(spark.range(390, 410).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2"))).count() == 10
    plan = store.fresh(store.runs()[0])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    store.drop()
    assert not store.runs()


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    found = line_runs.drop_repeated_lines(odd_docs.withColumn("n_lines", F.lit("x")))
    assert set(odd_docs.columns) < set(found.columns) and found.count() == odd_docs.count()
    assert rows(found.select("doc_id", "n_lines", "n_dropped", "kept_text")) == rows(spark.createDataFrame(plain([tuple(r) for r in odd_docs.select("doc_id", "text").collect()]), "doc_id long, n_lines long, n_dropped long, kept_text string"))
    assert line_runs.drop_repeated_lines(no_docs).count() == 0


def test_a_text_of_over_a_megabyte(spark):
    text = "\n".join(f"{LINE} {i % 3000}" for i in range(20_000))
    docs = [(i, text) for i in range(3)] + [(i, f"{LINE} 7") for i in range(5, 8)]
    assert dropped(spark, docs, min_docs=4) == plain(docs, 40, 4)


def test_query_equals_its_sql(spark):
    same_as_oracle(line_runs.query(spark, SF), line_runs.ORACLE)
    some = line_runs.query(spark, SF).first()
    assert len(some["kept_sha256"]) == len(hashlib.sha256(b"").hexdigest())
