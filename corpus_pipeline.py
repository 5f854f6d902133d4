"""A training-corpus pipeline over ``documents``: identify, deduplicate, pseudonymise, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents; only the last one returns packed pieces. Every
stage's result is written as Parquet to the shared checkpoint folder and read again as the next stage's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import jaccard, langid, mixing, packing, pii
from orrery.llm.common import cut, ensure_checkpoint_dir, read, release

#: Ids of dropped documents that are broadcast at most (16 MB).
BROADCAST_IDS = 2_000_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay."""
    return langid.keep_identified(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest id stays, once.

    Texts are not shuffled: of each id that isn't its component's all rows go. Rows without an id stay. Ids are unique in documents;
    rows that share one are set apart, those with equal texts become one, and what has no near copy among the rows that stay, stays.
    """
    found = cut(jaccard.jaccard_components(docs))
    release(spark)
    repeated = cut(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    dropped = found.where("doc_id <> component_id").join(repeated, "doc_id", "left_anti").select("doc_id")
    gone = cut(dropped.union(repeated).distinct())
    if gone.count() <= BROADCAST_IDS:  # else texts are shuffled to the ids
        gone = F.broadcast(gone)
    names = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(gone, "doc_id", "left_anti").select(*names)
    if repeated.isEmpty():
        return kept
    again = docs.join(repeated, "doc_id", "left_semi").select("doc_id", F.struct(*names).alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    # they get numbers of their own above those of the rows that stay
    numbered = cut(again.groupBy("doc_id", "h").agg(F.first("row").alias("row")).withColumn("number", F.monotonically_increasing_id()))
    heads = kept.select((-1 - F.monotonically_increasing_id()).alias("doc_id"), "text").union(numbered.select("number", "row.text"))
    own = jaccard.jaccard_components(heads).where("doc_id >= 0 and doc_id = component_id").select(F.col("doc_id").alias("number"))
    return kept.union(numbered.join(own, "number", "left_semi").select("row.*").select(*names))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms."""
    return pii.replace_texts(docs, pii.setting_key(spark))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, with their ids, the document's row and the sequence and offset where they go."""
    return packing.pack_documents(docs, emit_ids=True)


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("PII pseudonyms", pii_stage),
    ("mixing to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the language model nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
