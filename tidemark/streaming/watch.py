"""Rules that change while a query runs: the watch plan of each batch, and the scopes that it starts and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import rules

SCOPE = ["cluster_id", "sink", "api_group", "kind", "namespace"]
SCOPES = "ts timestamp, cluster_id string, sink string, api_group string, kind string, namespace string, api_version string, action string, rule_ref string"
RULES = "ts timestamp, rule_key string, sink string, namespaces array<string>, resources array<struct<group:string,version:string,kind:string,selector:string>>, extra_redaction array<string>, deleted boolean"


def read_scopes(spark: SparkSession, path: str) -> DataFrame:
    """The transitions that :func:`follow_rules` has written to ``path``."""
    return spark.read.schema(f"{SCOPES}, batch long").parquet(f"{path}/scopes").drop("batch")


def rules_now(log: DataFrame) -> DataFrame:
    """The rules that a log of them adds up to: the last row of each, without deleted ones."""
    last = log.groupBy("rule_key").agg(F.max_by(F.struct(*[c for c in log.columns if c != "rule_key"]), F.struct("ts", F.coalesce("deleted", F.lit(False)))).alias("l"))
    return last.where("not coalesce(l.deleted, false)").select("rule_key", "l.*")


def scopes_of(targets: DataFrame, cluster: str) -> DataFrame:
    """The scopes of a watch plan: one for each sink, group, kind and namespace, whatever the versions."""
    scope = targets.select(F.lit(cluster).alias("cluster_id"), "sink", F.col("group").alias("api_group"), "kind", "namespace", "version", F.explode("rule_keys").alias("rule_key"))
    return scope.groupBy(*SCOPE).agg(F.max("version").alias("api_version"), F.min("rule_key").alias("rule_ref"))


def follow_rules(changes: DataFrame, path: str, checkpoint: str, cluster: str = "", policy: DataFrame | None = None, kinds: DataFrame | None = None, interval: str | None = None):
    """Start the query that evaluates the plan again whenever rules change (columns of ``RULES``), and appends what starts and stops.

    The ``interval`` gathers changes that come together; without one the query takes
    what there is and ends.  The log of rules is in ``path``/rules, that of scopes in
    ``path``/scopes, both by batch: a batch that runs again sees only what was
    written before it, and replaces what it had written.  Transitions carry the time of the
    batch's last change.  Both logs are as large as the rules' history, not as the data.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select(*[f.split()[0] for f in RULES.split(", ")], F.lit(number).alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/rules")
        log = spark.read.schema(f"{RULES}, batch long").parquet(f"{path}/rules").where(F.col("batch") <= number)
        # An empty partition, so that the first batch finds a table.
        spark.createDataFrame([], f"{SCOPES}, batch long").write.mode("append").parquet(f"{path}/scopes")
        last = spark.read.schema(f"{SCOPES}, batch long").parquet(f"{path}/scopes").where(F.col("batch") < number)
        running = last.groupBy(*SCOPE).agg(F.max_by(F.struct("action", "api_version", "rule_ref"), F.struct("batch", "ts")).alias("l")).where("l.action = 'Started'").select(*SCOPE, "l.api_version", "l.rule_ref")
        wanted = scopes_of(rules.plan(rules_now(log.drop("batch")), policy, kinds), cluster)
        moves = wanted.join(running, SCOPE, "left_anti").withColumn("action", F.lit("Started")).unionByName(running.join(wanted, SCOPE, "left_anti").withColumn("action", F.lit("Stopped")))
        at = log.where(F.col("batch") == number).agg(F.max("ts").alias("ts"))
        out = moves.crossJoin(F.broadcast(at)).select(*[f.split()[0] for f in SCOPES.split(", ")], F.lit(number).alias("batch"))
        # Few rows, and read from the folder they are written to: they are whole before it changes.
        rows = spark.createDataFrame(out.collect(), out.schema)
        rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/scopes")

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
