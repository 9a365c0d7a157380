"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Every stage judges all rows that the one before kept, by whole texts, and keeps the
columns of documents; the last adds those of the mixture.  As a stage's result is
written before the next one begins, a stage first clears what the one before left
in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, linededup, mixing, ngramjoin, toxicity
from tidemark.llm.common import clear_scratch, folder, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def _tidy(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            clear_scratch(spark, _left.pop())
        name = f"stage-{uuid.uuid4().hex}"
        _left.append(name)
        with folder(name):
            return stage(spark, docs, sf_dir)

    return run_stage


@_tidy
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the network predicts toxic; it learns from labels of documents outside the held-out fold."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out)


@_tidy
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated three-line windows; documents of which nothing is left go, empty ones stay as they came."""
    done = linededup.dedup_lines(docs)
    left = F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")) != ""
    changed = F.col("n_removed") > 0
    done = done.where(~changed | left).withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that is alike by five-word shingles (0.8 or more)."""
    return ngramjoin.one_of_each(docs)


@_tidy
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents with n_tokens, epoch, block and order_key."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
