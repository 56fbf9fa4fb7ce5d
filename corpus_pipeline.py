"""Corpus pipeline: toxic documents go, near-duplicates and repeated passages
go, test items go, and what stays is encoded.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run`
writes each result as parquet in the shared folder and rereads it as the next
stage's ``docs``.  All stages but the last return the columns of ``documents``.
Tables that a stage needed on its way are deleted once its result is written.

Defined cases: rows of null ``doc_id`` stay through the dedup stages; null texts
count as empty and stay (they are no toxic text, hold no passage or test item and
encode to no ids), one of them where several link as near duplicates; of rows that
repeat a ``doc_id`` those of linked texts leave one, others are judged each on its
own text; an empty table gives no rows;
further columns are carried on by all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe_tree, decontaminate, near_copies, shared, simhash, suffix_dedup, toxicity

#: The stages train, hash and search; SQL cannot express them.
ORACLE_SQL = None


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Groups within 3 fingerprint bits keep one document; then so do near copies
    (5-word Jaccard similarity of 0.8 or more) that differ by more bits."""
    return near_copies.keep_one(shared.materialize(simhash.keep_one(docs), "pipeline-simhash"))


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs)


def test_items_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_tree.token_ids(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_near_dedup", near_duplicates_out),
    ("suffix_dedup", repeats_out),
    ("decontamination", test_items_out),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str, resume: str | None = None) -> DataFrame:
    """The stages one after another.  With ``resume``, a folder, stages are kept
    there by name, and those finished by an earlier run over the same tables are
    read instead of run again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{resume}/{name}" if resume else shared.fresh_dir(spark, f"pipeline-{name}")
        if not shared.exists(spark, f"{path}/_SUCCESS"):
            with shared.scratch(spark):
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
