"""Corpus pipeline: documents through five stages, each one operator of ``sigframe.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each stage's
result as Parquet to the shared folder and gives the files to the next stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.llm import fm_quality, latent_decontam, line_windows, piece_sampling, simhash_pivot
from sigframe.llm.common import fresh, table
from sigframe.session import scratch_path

PIECE_FILE = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.5 or more)."""
    model = fm_quality.train(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "__score")
    return fm_quality.score(docs, model, name=name).filter(F.col(name) >= 0.5).drop(name)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of repeated three-line windows."""
    return line_windows.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash_pivot.keep_components(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return latent_decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled pieces of every document and what they decode to."""
    return piece_sampling.encode(docs, public_tokenizers.path(PIECE_FILE))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", pieces),
]

# Models and sampled pieces are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
