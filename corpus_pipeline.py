"""Training-data pipeline: every stage's rows are written as Parquet and read by the next.

All stages but the last return the columns of documents. Rows that the quality model scores
below its threshold go; of near-duplicates the smallest doc_id stays; passages that a
smaller doc_id has are cut out; documents with a benchmark passage go; the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weekcast.llm import bpe, decontaminate, quality_gam, simhash, suffix_dedup
from weekcast.llm.common import read, write_once


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_gam.accepted(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_group(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, brief=True)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

# The stages fit a model, link fingerprints transitively and use a vocabulary file, which
# SQL can't express; tests/llm/test_pipeline.py holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
