"""Corpus pipeline: quality rules, exact and near duplicates, source mixing, packing.

Each stage works on all that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import exact_dedup, mixing, ngram_join, packing, quality
from docspark.storage import fresh_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and from the others the boilerplate lines of their host."""
    return quality.keep_clean(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts equal but for white space stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near duplicates (five-word shingles, Jaccard 0.8 or more) stays."""
    return ngram_join.one_of_each(docs, words=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to three times."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("ngram_join", near_duplicates),
    ("mixing", source_mix),
    ("packing", packed),
]

#: SQL can't encode tokens; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``. The stages' files go when the driver ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = fresh_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
