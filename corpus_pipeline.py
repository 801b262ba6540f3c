"""A training corpus from raw documents in five stages; each reads what the stage before wrote."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomtext.llm.common import remove, shared_dir, there
from loomtext.llm.decontamination import decontaminate
from loomtext.llm.ngram_join import drop_near_duplicates
from loomtext.llm.packing import digest, pack_documents
from loomtext.llm.quality_cnn import keep_quality
from loomtext.llm.substring_dedup import cut_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level classifier does not reject."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 and more."""
    return drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 35-word windows that also stand elsewhere; emptied documents go."""
    return cut_repeats(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; documents that are mostly benchmark go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048."""
    return digest(pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("benchmarks", benchmarks),
    ("packing", packing),
]

#: SQL can't express the classifier or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages, each written to the shared folder and read again for the next; a stage's input goes once its output
    is there.  With a ``folder`` all outputs stay in it, and a run that broke off goes on after its last whole stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = folder or os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    before = None
    for name, stage in STAGES[:-1]:
        path = os.path.join(base, name)
        if not there(spark, os.path.join(path, "_SUCCESS")):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before and not folder:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
