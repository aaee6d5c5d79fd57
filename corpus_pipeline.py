"""A corpus pipeline of five stages, each written as Parquet and reread as the next one's input.

Every stage but the last returns the columns of ``documents``. Copies of a document that the mix
repeats are rows of their own from there on, so packing packs each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkey.llm import mixing, packing, secrets, simhash, toxicity
from nearkey.llm.shared import materialised


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring at the threshold or above go; a null text scores as an empty one.

    Equal texts score alike whatever their other columns, so repeated rows stay or go together. A column ``_score`` must not be there.
    """
    model = toxicity.train(docs, _labels(spark, sf_dir))
    scored = toxicity.score(docs, model, tuple(docs.columns), "_score")
    return scored.where(F.col("_score") < toxicity.THRESHOLD).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the smallest doc_id stays; rows without a doc_id stay.

    Of rows that repeat that doc_id in one group, one stays: of several texts the one of least hash, of several rows with that
    text the least in the order of their other columns (nulls first). A null text is an empty one.
    """
    found = simhash.grouped(docs).where("doc_id = component_id")
    kept = found.groupBy(F.col("doc_id").alias("_id"), "component").agg(F.min("text_hash").alias("_kept")).select("_id", "_kept")
    named = docs.where("doc_id is not null").withColumn("_hash", F.xxhash64("text"))
    mine = named.join(kept, F.expr("doc_id = _id and _hash = _kept"), "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = mine.groupBy("doc_id", "_hash").agg(F.min(F.struct(*others, "text")).alias("_row")).select("doc_id", "_row.*")
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced in the text; all documents stay, repeated rows each. A null text stays null.

    Columns ``_found`` and ``_text`` must not be there.
    """
    carry = tuple(c for c in docs.columns if c != "text")
    clean = secrets.find_spans(docs, carry=carry, redact="[secret]", name="_found")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size("_found") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows equal in id, source and text are drawn together. A null text has no words, costs the mix nothing and may stay.

    The mix runs on sizes alone; texts are shuffled once, to meet the number of their copies.
    """
    key = ["doc_id", "source", "_text"]
    named = docs.withColumn("_text", F.xxhash64("text"))
    slim = materialised(named.select(*key, mixing.word_count(F.col("text")).alias("size")), "sizes")
    weighted = mixing.quality_weight(slim.groupBy(*key).agg(F.sum("size").alias("size")), _labels(spark, sf_dir))
    mixed = mixing.mix(weighted, F.col("draw_weight"), F.col("size")).where("times > 0")
    times = mixed.select(*[F.col(c).alias(f"_{c}") for c in key], "times")
    taken = named.join(times, F.expr("doc_id <=> _doc_id and source <=> _source and _text <=> __text"))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents in sequences, repeated rows each; a null doc_id stays null. Columns but doc_id and text are ignored."""
    return packing.best_fit_packing(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", one_of_each_group),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL expresses neither the trained score nor the tokenizer: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
