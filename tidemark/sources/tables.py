"""The stored tables: partitioned Parquet, scans that prune, appends, retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.schema import HIDDEN, IDENTITY, RESOURCE_STATES, WATCH_SCOPES, encoded

PARTITIONS = ["cluster_id", "yyyymm"]


def month_of(ts: Column) -> Column:
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def create_tables(spark: SparkSession, database: str = "default", location: str | None = None) -> None:
    """Create the tables where they don't exist."""
    for name, schema, hidden, keys in (("resource_states", RESOURCE_STATES, f", {HIDDEN}, yyyymm INT", "cluster_id, yyyymm"), ("watch_scopes", WATCH_SCOPES, "", "cluster_id")):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + hidden
        at = f" LOCATION '{location}/{name}'" if location else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet PARTITIONED BY ({keys}){at}")


def append_states(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Append rows, a directory for each cluster and month, sorted by identity and time so that files prune by their statistics.

    Rows with a column ``sink`` go to a table of their own for each sink, in ``path``/sink=...
    With a name for the ``batch``, appending it again replaces what it had written.
    """
    rows = encoded(rows).withColumn("yyyymm", month_of(F.col("ts")))
    parts = ["sink", *PARTITIONS] if "sink" in rows.columns else PARTITIONS
    dealt = rows.repartition(*parts, F.pmod(F.xxhash64(*IDENTITY), F.lit(16))).sortWithinPartitions(*parts, *IDENTITY, "ts")
    if batch is None:
        dealt.write.mode("append").partitionBy(*parts).parquet(path)
    else:
        dealt.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts, "batch").parquet(path)


def read_states(spark: SparkSession, path: str, cluster: str | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Scan the table; bounds on ts also become bounds on its partitions, which a filter on ts alone doesn't prune."""
    rows = spark.read.parquet(path)
    if cluster is not None:
        rows = rows.where(F.col("cluster_id") == cluster)
    if start is not None:
        rows = rows.where((F.col("yyyymm") >= start.year * 100 + start.month) & (F.col("ts") >= F.lit(start)))
    if end is not None:
        rows = rows.where((F.col("yyyymm") <= end.year * 100 + end.month) & (F.col("ts") <= F.lit(end)))
    return rows.drop("yyyymm", "batch")


def expire_states(spark: SparkSession, path: str, before: datetime) -> list[str]:
    """Delete the partitions of months that end before ``before``, of one table or of all sinks' tables in ``path``; returns them."""
    conf = spark._jsc.hadoopConfiguration()
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    gone = []
    for within in ("cluster_id=*/yyyymm=*", "sink=*/cluster_id=*/yyyymm=*"):
        for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{within}")) or []:
            at = status.getPath()
            if int(at.getName().split("=")[1]) < before.year * 100 + before.month:
                fs.delete(at, True)
                gone.append("/".join(str(at).split("/")[-1 - within.count("/") :]))
    return sorted(gone)


def retained(rows: DataFrame, before: datetime) -> DataFrame:
    """Rows not older than ``before``, for months that are only partly expired."""
    return rows.where(F.col("ts") >= F.lit(before).cast(rows.schema["ts"].dataType))
