"""Observations: JSON lines of what a watch has told, in batch or as a stream, and the current objects they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.cdc import KEY
from tidemark.sources.schema import OBSERVATIONS


def read(spark: SparkSession, path: str) -> DataFrame:
    return events(spark.read.schema(OBSERVATIONS).json(path))


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A file stream; the number of files taken at once is the back-pressure."""
    return events(spark.readStream.schema(OBSERVATIONS).option("maxFilesPerTrigger", files_per_trigger).json(path))


def events(rows: DataFrame) -> DataFrame:
    """A row without an object is a deletion that was seen late."""
    late = (F.col("op") == "upsert") & F.col("object_json").isNull()
    return rows.withColumn("op", F.when(late, "delete").otherwise(F.col("op")))


def current(rows: DataFrame) -> DataFrame:
    """The object of each key as last observed, without deleted ones."""
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct("op", "object_json", "seq"), F.struct("ts_ns", "seq")).alias("l"))
    return last.where("l.op = 'upsert'").select(*KEY, "l.object_json", "l.seq")


def coalesced(rows: DataFrame) -> DataFrame:
    """Only the last observation of each key: what a level-triggered reader sees of a batch."""
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in KEY]), F.struct("ts_ns", "seq")).alias("l"))
    return last.select(*KEY, "l.*")
