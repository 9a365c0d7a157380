"""Synthetic churn: observations of many objects of several kinds that change at random."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds take turns: (group, kind).
KINDS = (("", "ConfigMap"), ("apps", "Deployment"), ("", "ServiceAccount"))


def churn(spark: SparkSession, objects: int, mutations: int, payload: int = 1024, kinds: int = 3, deletes: float = 0.0, seed: int = 1) -> DataFrame:
    """Observations: every object created once, then ``mutations`` changes, of which a share are deletions."""
    rows = spark.range(objects + mutations).select(F.col("id").alias("seq"))
    created = F.col("seq") < objects
    rows = rows.withColumn("n", F.when(created, F.col("seq")).otherwise(F.pmod(F.xxhash64(F.lit(seed), "seq"), F.lit(objects))))
    gone = ~created & (F.pmod(F.xxhash64(F.lit(seed + 1), "seq"), F.lit(1_000_000)) < int(deletes * 1_000_000))
    return rows.select("seq", *_columns(gone, payload, kinds))


def churn_stream(spark: SparkSession, objects: int, per_second: int, payload: int = 1024, kinds: int = 3, deletes: float = 0.0, seed: int = 1) -> DataFrame:
    """The same as a stream of changes."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("value").alias("seq"))
    rows = rows.withColumn("n", F.pmod(F.xxhash64(F.lit(seed), "seq"), F.lit(objects)))
    gone = F.pmod(F.xxhash64(F.lit(seed + 1), "seq"), F.lit(1_000_000)) < int(deletes * 1_000_000)
    return rows.select("seq", *_columns(gone, payload, kinds))


def _columns(gone: Column, payload: int, kinds: int) -> list[Column]:
    def of(k: int) -> Column:
        return F.element_at(F.array(*[F.lit(x[k]) for x in KINDS[:kinds]]), (F.col("n") % kinds + 1).cast("int"))

    name = F.format_string("churn-%s-%05d", F.lower(of(1)), F.col("n"))
    meta = F.struct(
        name.alias("name"), F.lit("churn").alias("namespace"), F.concat(F.lit("uid-"), F.col("n").cast("string")).alias("uid"),
        F.col("seq").cast("string").alias("resourceVersion"),
        F.create_map(F.lit("revision"), F.col("seq").cast("string")).alias("labels"),
        F.create_map(F.lit("padding"), F.repeat(F.lit("x"), payload)).alias("annotations"),
        F.array(F.struct(F.lit("churner").alias("manager"))).alias("managedFields"),
    )
    doc = F.to_json(F.struct(F.when(of(0) == "", "v1").otherwise(F.concat(of(0), F.lit("/v1"))).alias("apiVersion"), of(1).alias("kind"), meta.alias("metadata"), F.struct(F.col("seq").alias("revision")).alias("spec")))
    return [
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("seq") * 1000).alias("ts"), (F.lit(1_700_000_000_000_000_000) + F.col("seq") * 1_000_000).alias("ts_ns"),
        F.lit("default").alias("sink"), F.when(gone, "delete").otherwise("upsert").alias("op"), F.lit("churn").alias("cluster_id"), of(0).alias("api_group"), F.lit("v1").alias("api_version"),
        of(1).alias("kind"), F.lit("churn").alias("namespace"), name.alias("name"), F.when(~gone, doc).alias("object_json"), F.lit(True).alias("scope_warm"),
    ]
