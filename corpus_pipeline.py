"""Cleaning a corpus in five stages, each of them one operator of latticework.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.jaccard_join import first_of_classes
from latticework.llm.packing import pack_documents
from latticework.llm.pii import sanitise
from latticework.llm.quality_model import good_documents
from latticework.llm.suffix_dedup import counted, remove_repeats
from latticework.session import Scratch


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns; n_chars, where it is one of them, as the text now has them."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of shingle sets of five words with a similarity of 0.8."""
    return first_of_classes(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier; characters cut in two go as a whole."""
    _, n_removed, _, kept = counted(docs)
    cut = remove_repeats(docs, length=100, as_text=True)
    text = F.when(F.col(n_removed) > 0, F.col(kept)).otherwise(F.col("text"))
    return _sized(cut.withColumn("text", text), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, and terms that reveal it, generalised."""
    return _sized(sanitise(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all texts, packed into sequences of at most 1024."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("pii", personal_data),
    ("best_fit_packing", packing),
]

#: Trained scores and token ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for documents; every stage's rows are written, read again by the next, then dropped."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
