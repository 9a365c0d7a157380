"""Collapse of rows with the same sort key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.schema import IDENTITY


def final(rows: DataFrame, mode: str = "reference") -> DataFrame:
    """One row for each object and time: the one that arrived last.

    ``mode="safe"`` also keeps rows of different uid or event type apart, so that a
    close-out, which has the time of the row it closes, doesn't hide that row.
    ``mode="changes"`` also keeps different contents apart, of copies the one that
    arrived first: all changes of an instant, each once, to be replayed in order.
    Filters on key columns move below the window; others stay above it, as they must.
    """
    key = [*IDENTITY, "ts_ns" if "ts_ns" in rows.columns else "ts"]
    if mode in ("safe", "changes"):
        key += ["uid", "event_type"] + ["sha256"] * (mode == "changes")
    elif mode != "reference":
        raise ValueError(f"unknown mode {mode!r}")
    if "ingest_seq" not in rows.columns:
        return rows.dropDuplicates(key)  # the copies are equal
    # Of a close-out and its successor, which may share an instant and an arrival, the successor.
    newest = Window.partitionBy(*key).orderBy(F.col("ingest_seq") if mode == "changes" else F.desc("ingest_seq"), *([F.col("event_type") == "Deleted"] if "event_type" in rows.columns else []), *[F.col(c) for c in ("uid", "sha256") if c in rows.columns])
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
