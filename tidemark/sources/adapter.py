"""Histories derived from the table events, for tests and benches: the same SQL in both engines.

Every tenth row comes twice (a repeated delivery), and every seventeenth has a
later row of the same key with other contents, so that collapsing is exercised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BASE = """
SELECT ts, 'c' || CAST(CAST(floor(user_id / 4) AS BIGINT) % 2 AS STRING) AS cluster_id,
  CASE event_type WHEN 'signup' THEN 'Added' WHEN 'view' THEN 'Snapshot' WHEN 'click' THEN 'Modified' WHEN 'purchase' THEN 'Checkpoint' ELSE 'Deleted' END AS event_type,
  CASE user_id % 4 WHEN 0 THEN 'apps' ELSE '' END AS api_group, 'v1' AS api_version,
  CASE user_id % 4 WHEN 0 THEN 'Deployment' WHEN 1 THEN 'ConfigMap' WHEN 2 THEN 'Event' ELSE 'Pod' END AS kind,
  CASE CAST(floor(user_id / 4) AS BIGINT) % 5 WHEN 0 THEN 'payments' WHEN 1 THEN 'checkout' WHEN 2 THEN 'infra' WHEN 3 THEN '' ELSE 'search' END AS namespace,
  'obj-' || CAST(user_id AS STRING) AS name,
  'obj-' || CAST(user_id AS STRING) || '-' || CAST(CAST(floor(day(ts) / 10) AS BIGINT) AS STRING) AS uid,
  'obj-' || CAST(user_id - 2 AS STRING) AS subject,
  'obj-' || CAST(user_id - 2 AS STRING) || '-' || CAST(CAST(floor(day(ts) / 10) AS BIGINT) AS STRING) AS subject_uid,
  value, event_id FROM {events}"""

_STATES = """
SELECT ts, cluster_id, CASE WHEN copy = 2 THEN 'Modified' ELSE event_type END AS event_type, api_group, api_version, kind, namespace, name, uid,
  CASE WHEN event_type = 'Deleted' AND copy < 2 THEN '' ELSE CAST(1000 + event_id AS STRING) END AS resource_version,
  CASE WHEN event_type = 'Deleted' AND copy < 2 OR value < 2 THEN {none}
       WHEN value < 20 THEN {split}('argocd-controller', ',') WHEN value < 40 THEN {split}('kubectl-edit,argocd-controller', ',')
       WHEN value < 80 THEN {split}('kube-controller-manager', ',') ELSE {split}('kubectl-edit,kube-controller-manager', ',') END AS actors,
  CASE WHEN event_type = 'Deleted' AND copy < 2 OR kind <> 'Event' AND (event_type = 'Modified' OR copy = 2) THEN ''
       WHEN kind = 'Event' THEN '{{"type":"' || CASE WHEN event_id % 5 < 3 THEN 'Warning' ELSE 'Normal' END || '","reason":"' || CASE event_id % 4 WHEN 0 THEN 'BackOff' WHEN 1 THEN 'Pulled' ELSE 'ScalingReplicaSet' END
         || '","message":"m ' || CAST(event_id AS STRING) || '","' || CASE WHEN event_id % 3 = 0 THEN 'deprecatedCount' ELSE 'count' END || '":' || CAST(event_id % 9 AS STRING)
         || ',"' || CASE WHEN event_id % 3 = 0 THEN 'regarding' ELSE 'involvedObject' END || '":{{"kind":"Deployment","name":"' || subject || '","namespace":"' || namespace || '","uid":"' || subject_uid || '"}}}}'
       ELSE '{{"kind":"' || kind || '","metadata":{{"name":"' || name || '","uid":"' || uid || '"}},"data":{{"feature_flags":"f' || CAST(event_id % 3 AS STRING) || '","password":"[REDACTED]"}},"spec":{{"replicas":' || CAST(event_id % 7 AS STRING) || '}}}}' END AS data,
  CASE WHEN kind <> 'Event' AND (event_type IN ('Modified', 'Checkpoint') OR copy = 2) THEN '[{{"op":"replace","path":"/spec/replicas","value":' || CAST(event_id % 7 + copy AS STRING) || '}}]' ELSE '' END AS diff,
  CASE WHEN event_type = 'Deleted' AND copy < 2 THEN '' ELSE {sha}('state ' || CAST(event_id + copy * 7 AS STRING){bits}) END AS sha256,
  event_id + copy * CAST(1000000000 AS BIGINT) AS ingest_seq
FROM (SELECT *, 0 AS copy FROM base UNION ALL SELECT *, CASE WHEN event_id % 17 = 0 THEN 2 ELSE 1 END AS copy FROM base WHERE event_id % 10 = 0 OR event_id % 17 = 0) AS copies"""

_SCOPES = """
SELECT ts, cluster_id, api_group, api_version, kind, namespace, CASE WHEN event_id % 3 = 0 THEN 'Stopped' ELSE 'Started' END AS action,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE 'StreamRule/' || namespace || '/r' || CAST(event_id % 4 AS STRING) END AS rule_ref
FROM base WHERE event_id % 7 = 0"""

_METRICS = """
SELECT ts, CASE event_id % 2 WHEN 0 THEN 'writes_total' ELSE 'queue_depth' END AS name, 's' || CAST(user_id % 3 AS STRING) AS sink,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS outcome, CASE WHEN event_id % 211 = 0 THEN 0.0 ELSE CAST(event_id AS DOUBLE) END AS value
FROM {events}"""

_SPARK = {"none": "CAST(array() AS array<string>)", "split": "split", "sha": "sha2", "bits": ", 256"}
_DUCKDB = {"none": "[]::VARCHAR[]", "split": "string_split", "sha": "sha256", "bits": ""}


def _sql(what: str, dialect: dict[str, str], events: str) -> str:
    body = {"states": _STATES, "scopes": _SCOPES}[what].format(**dialect)
    return f"SELECT * FROM (WITH base AS ({_BASE.format(events=events)}) {body}) AS {what}"


def duckdb_sql(what: str) -> str:
    """The same rows as a DuckDB statement over ``events``."""
    return _METRICS.format(events="events") if what == "metrics" else _sql(what, _DUCKDB, "events")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL over @events; its own braces aren't placeholders."""
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("@events", "{events}"), events=_events(spark, sf_dir))


def resource_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the table but labels, and ingest_seq."""
    return _run(spark, sf_dir, _sql("states", _SPARK, "@events"))


def watch_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, _sql("scopes", _SPARK, "@events"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, name, sink, outcome, value."""
    return _run(spark, sf_dir, _METRICS.format(events="@events"))
