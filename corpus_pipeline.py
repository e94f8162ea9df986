"""The corpus pipeline: five stages from raw documents to a mixed corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
what it returns as Parquet to the shared folder and rereads it as the next
stage's docs.  What a stage read is deleted once its own result is written, so
that two stages' documents are kept at most; the last stage's stay for the
caller.

docs holds doc_id, text, lang, source and n_chars; other columns may have any
name and type and are passed on.  NULL, empty and wordless texts go in the first
stage, which can't tell their language.  Rows with a NULL doc_id pass all stages
but the last, which can't draw a key for them.  Of rows that repeat a doc_id the
one with the least text that isn't NULL is kept from the second stage on.  Of
near copies, and of passages, the one with the least doc_id stays.  Very long
texts are read whole everywhere.  An empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontam, language, mixing, simhash, suffix_array
from gleaner.llm.common import discard, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; every row gets its own answer."""
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id."""
    return simhash.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of long passages; those of which nothing is left go."""
    return suffix_array.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal shares of tokens from every source, repeated where a source is too small; adds epoch and taken."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passage_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Language identification and near duplicates have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
