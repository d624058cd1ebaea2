"""From raw documents to packed sequences: what a training run reads.

Each stage gets the documents that its predecessor kept, with all columns of the table, and returns those it keeps; the
last one returns the packed pieces. Lengths, counts and models are taken from all that a stage is given.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import exact_dedup, near_dedup, packing, quality_model, quality_rules
from lodeworks.llm.common import Scratch, checkpoint, clear


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = f"_{uuid.uuid4().hex}"  # no column of the documents
    return model.score(docs, score_col=score).filter(F.col(score) >= 0.5).drop(score)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the document with the largest id."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep the document with the smallest id."""
    return near_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", classify), ("quality rules", rules), ("exact dedup", exact), ("near dedup", near), ("packing", pack)]

#: Robust estimates, MinHash groups and packing are beyond SQL on whole tables; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for k, (_, stage) in enumerate(STAGES):
            docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
            clear(spark, but=scratch.path)
        return checkpoint(docs)
