"""Registered queries of the operators, over inputs derived from the driver's tables, with the same in DuckDB SQL.

Classification and replay have SQL too: it builds the documents and patches of this
input as texts, and the decisions as windows.  Only the synthetic churn has none
(its hashes aren't in DuckDB); tests compare it with decision tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import selectors
from tidemark.operators import cdc, metrics, recover, replay, rules
from tidemark.operators.final import final
from tidemark.plans import library
from tidemark.sources import adapter, churn

EPOCH, NOW = datetime(2024, 1, 20), datetime(2024, 2, 1)

_LABELS = "map('app', 'a' || CAST(user_id % 3 AS STRING), 'tier', CASE WHEN user_id % 5 = 0 THEN 'web' ELSE 'db' END)"
_RULES = [
    ("StreamRule/payments/r1", "s0", ["payments", "infra"], [("apps", "v1", "Deployment", "app in (a1,a0)"), ("", "v1", "Secret", "")], ["data.password"]),
    ("StreamRule/infra/r2", "s0", ["infra"], [("apps", "v1", "Deployment", "app in (a0, a1)"), ("", "v1", "Pod", "tier!=web")], []),
    ("ClusterStreamRule//r3", "s1", [], [("", "v1", "ConfigMap", "!missing,tier"), ("batch", "v1", "Job", "")], ["spec.token"]),
]
_POLICY = [("apps", ["*"]), ("", ["Pod", "ConfigMap", "Secret"])]


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RULES, "rule_key string, sink string, namespaces array<string>, resources array<struct<`group`:string,version:string,kind:string,selector:string>>, extra_redaction array<string>")


def _targets(spark: SparkSession) -> DataFrame:
    return rules.plan(_rules(spark), spark.createDataFrame(_POLICY, "`group` string, kinds array<string>"))


def watch_targets(spark: SparkSession, _: str) -> DataFrame:
    out = _targets(spark)
    return out.withColumns({c: F.array_join(c, ";") for c in ("rule_keys", "selectors", "redactions")})


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations from events: each event shows one of a user's objects in one of a few states; deliveries repeat, some with another state."""
    rows = adapter.resource_states(spark, sf_dir).withColumn("n", F.expr("ingest_seq % 1000000000 + CASE WHEN ingest_seq >= 2000000000 THEN 7 ELSE 0 END"))
    doc = F.to_json(F.struct(
        F.lit("v1").alias("apiVersion"), "kind",
        F.struct("name", "namespace", "uid", F.create_map(F.lit("rev"), F.pmod("n", F.lit(3)).cast("string")).alias("labels"), F.col("n").cast("string").alias("resourceVersion")).alias("metadata"),
        F.struct(F.pmod(F.floor(F.col("n") / 3), F.lit(4)).alias("replicas"), F.array(F.lit("a"), F.pmod("n", F.lit(2)).cast("string")).alias("args"), F.repeat(F.lit("y"), 200).alias("note")).alias("spec"),
    ))
    deleted = F.col("event_type") == "Deleted"
    return rows.select(F.col("ingest_seq").alias("seq"), "ts", F.when(deleted, "delete").otherwise("upsert").alias("op"), "cluster_id", "api_group", "kind", "namespace", "name", F.when(~deleted, doc).alias("object_json"), (F.col("ts") > F.lit("2024-01-02").cast("timestamp_ntz")).alias("scope_warm"))


def classify_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.classify(_observed(spark, sf_dir), cdc.Classifier(checkpoint_every=5)).drop("labels")


def classify_churn(spark: SparkSession, _: str) -> DataFrame:
    return cdc.classify(churn.churn(spark, 500, 4000, 256, deletes=0.1)).drop("labels")


def reconstruct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = cdc.as_states(cdc.classify(_observed(spark, sf_dir), cdc.Classifier(checkpoint_every=5)))
    return replay.reconstruct_at(states, datetime(2024, 1, 21, 12)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def digest_of_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of one object whose name several have had, on the classifier's own output."""
    states = cdc.as_states(cdc.classify(_observed(spark, sf_dir), cdc.Classifier(checkpoint_every=5)))
    return library.object_digest(states, "c0", "apps", "Deployment", "infra", "obj-8").withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


def final_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final(adapter.resource_states(spark, sf_dir))


def final_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final(adapter.resource_states(spark, sf_dir), "safe")


def tail_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.tail(adapter.resource_states(spark, sf_dir), datetime(2024, 1, 26), timedelta(hours=36)).select("ts", "name", "uid", "event_type", "ingest_seq")


def unchanged_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.resource_states(spark, sf_dir).withColumn("sha256", F.substring("sha256", 1, 1))
    return cdc.unchanged_dropped(rows, ["ts", "ingest_seq"]).select("cluster_id", "name", "uid", "ts", "sha256", "ingest_seq")


def _live(rs: DataFrame) -> DataFrame:
    """An inventory: of each object in three, one is as in history, one has another uid, one is gone."""
    number = F.regexp_extract("name", "[0-9]+", 0).cast("int")
    current = recover.split_incarnations(recover.known(rs)).where("current")
    return current.where(number % 3 != 2).select("cluster_id", "api_group", "kind", "namespace", "name", F.when(number % 3 == 0, F.col("uid")).otherwise(F.concat("uid", F.lit("-new"))).alias("uid"))


def zombies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rs = adapter.resource_states(spark, sf_dir)
    return recover.zombies(rs, _live(rs))


def unclosed_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recover.unclosed_priors(adapter.resource_states(spark, sf_dir))


def orphan_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = adapter.watch_scopes(spark, sf_dir)
    return recover.orphan_scopes(ws, ws.where("kind = 'Pod'"))


def recovered_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rs, ws = adapter.resource_states(spark, sf_dir), adapter.watch_scopes(spark, sf_dir)
    return recover.recover(rs, ws, _live(rs), ws.where("kind = 'Pod'"), EPOCH, NOW).deleted.select("ts", "cluster_id", "kind", "namespace", "name", "uid", "api_version")


def converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rs = adapter.resource_states(spark, sf_dir)
    live = recover.split_incarnations(recover.known(rs)).where("current")
    return library.expect_converged(rs, live)


def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "event_id AS seq", f"{_LABELS} AS labels")
    objects = adapter.resource_states(spark, sf_dir).select("cluster_id", "api_group", "kind", "namespace", "name", F.col("ingest_seq").alias("seq"), F.expr("ingest_seq % 1000000000").alias("event"))
    return rules.fan_out(objects.join(rows.withColumnRenamed("seq", "event"), "event"), _targets(spark)).select("sink", "cluster_id", "kind", "namespace", "name", "seq")


def selector_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{_LABELS} AS labels")
    texts = {"both": "app in (a0,a2),tier!=web", "none": "", "absent": "!app", "present": "tier,app notin (a1)"}
    return rows.select("event_id", *[selectors.condition(t).alias(n) for n, t in texts.items()])


def scope_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = adapter.watch_scopes(spark, sf_dir).where("rule_ref <> ''")
    rules_of = Window.partitionBy("cluster_id", "api_group", "kind", "namespace", "rule_ref").orderBy("ts")
    # A rule comes and goes by turns.
    log = ws.withColumn("delta", F.when(F.row_number().over(rules_of) % 2 == 1, 1).otherwise(-1)).withColumn("sink", F.lit("s")).withColumnRenamed("rule_ref", "rule_key")
    return rules.scope_transitions(log)


def write_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.metrics(spark, sf_dir).where("name = 'writes_total'")
    return metrics.rate_by_step(rows, ["sink", "outcome"], ["sink"], 86400).withColumn("rate", F.round("rate", 6))


def _samples(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Samples with labels: two pods report for each sink and outcome."""
    labels = "map('sink', sink, 'outcome', outcome, 'pod', 'p' || CAST(CAST(floor(value / 2) AS BIGINT) % 2 AS STRING), 'condition', 'Ready', 'status', CASE outcome WHEN 'failed' THEN 'false' ELSE 'true' END)"
    return adapter.metrics(spark, sf_dir).where(F.col("name") == name).withColumn("labels", F.expr(labels)).select("ts", "name", "labels", "value")


def alert_write_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.writes_failing(_samples(spark, sf_dir, "writes_total"), seconds=6 * 3600, window=86400).withColumn("rate", F.round("rate", 6))


def alert_enqueue_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.enqueue_timeouts(_samples(spark, sf_dir, "queue_depth"), "queue_depth", seconds=3600, window=3600).withColumn("rate", F.round("rate", 6))


def alert_rules_not_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir, "queue_depth").withColumn("value", F.expr("CAST(CAST(floor(value / 8) AS BIGINT) % 5 AS DOUBLE)"))
    return metrics.rules_not_ready(rows, "queue_depth", 86400).select("ts", F.col("labels.sink").alias("sink"), F.col("labels.pod").alias("pod"), "value", "since")


def gauges_by_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest_gauges(_samples(spark, sf_dir, "queue_depth"), "queue_depth", "sink")


def failing_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.metrics(spark, sf_dir).where("name = 'queue_depth'")
    return metrics.held(rows, F.col("outcome") == "ok", ["sink"], 3600).select("sink", "ts", "since")


def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    edges = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, float("inf")]
    counted = events.groupBy("event_type").agg(*[F.count_if(F.col("value") <= e).cast("double").alias(f"b{k}") for k, e in enumerate(edges)])
    buckets = counted.select("event_type", F.inline(F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"b{k}").alias("value")) for k, e in enumerate(edges)])))
    return metrics.histogram_quantile(0.9, buckets, ["event_type"]).withColumn("quantile", F.round("quantile", 6))


def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.load_percentiles(spark.read.parquet(f"{sf_dir}/events.parquet"))


def rule_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_type AS condition", "CASE WHEN value < 10 THEN 'true' WHEN value < 50 THEN 'false' ELSE 'other' END AS status")
    return metrics.condition_counts(rows)


_D = adapter.duckdb_sql
_KEY = "cluster_id, api_group, kind, namespace, name"
_FIRST = "ORDER BY ts DESC, event_type = 'Deleted' DESC, ingest_seq DESC"
_KNOWN = f"""k AS (SELECT * EXCLUDE (event_type) FROM (SELECT {_KEY}, uid, first(sha256 {_FIRST}) AS sha256, first(api_version {_FIRST}) AS api_version, first(event_type {_FIRST}) AS event_type,
  max(ts) AS ts, first(ingest_seq {_FIRST}) AS sq, first(event_type = 'Deleted' {_FIRST}) AS de FROM rs GROUP BY {_KEY}, uid) WHERE event_type <> 'Deleted'),
s AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY ts DESC, de DESC, sq DESC, uid DESC) = 1 AS cur FROM k),
live AS (SELECT {_KEY}, CASE WHEN n % 3 = 0 THEN uid ELSE uid || '-new' END AS uid FROM (SELECT *, regexp_extract(name, '[0-9]+')::INT AS n FROM s WHERE cur) WHERE n % 3 <> 2)"""
_RS = f"WITH rs AS ({_D('states')})"
_WS = f"ws AS ({_D('scopes')})"
_ZOMBIES = f"z AS (SELECT {_KEY}, uid, sha256, api_version, ts, EXISTS (SELECT 1 FROM live l WHERE l.cluster_id = s.cluster_id AND l.api_group = s.api_group AND l.kind = s.kind AND l.namespace = s.namespace AND l.name = s.name) AS replaced FROM s WHERE cur AND NOT (kind = 'Event' AND api_group IN ('', 'events.k8s.io')) AND (({_KEY}, uid)) NOT IN (SELECT ({_KEY}, uid) FROM live))"
_SC = "cluster_id, api_group, kind, namespace"
#: Decisions by the observation before: after a deletion or nothing there is no state, after anything else its document.
_CLASSIFIED = f"""o AS (SELECT ingest_seq AS seq, epoch_us(ts) * 1000 AS ts_ns, {_KEY}, uid, event_type = 'Deleted' AS gone, kind = 'Event' AS ev, ts > TIMESTAMP '2024-01-02' AS warm, ingest_seq % 1000000000 + CASE WHEN ingest_seq >= 2000000000 THEN 7 ELSE 0 END AS n FROM rs),
d AS (SELECT *, (n % 3)::VARCHAR AS rev, (n % 2)::VARCHAR AS arg, (n // 3) % 4 AS q, lag(gone) OVER w AS p_gone, lag(uid) OVER w AS p_uid, lag(n % 3) OVER w AS p_rev, lag(n % 2) OVER w AS p_arg, lag((n // 3) % 4) OVER w AS p_q,
  CASE WHEN NOT gone THEN '{{"apiVersion":"v1","kind":"' || kind || '","metadata":{{"labels":{{"rev":"' || (n % 3) || '"}},"name":"' || name || '","namespace":"' || namespace || '","uid":"' || uid || '"}},"spec":{{"args":["a","' || (n % 2) || '"],"note":"' || repeat('y', 200) || '","replicas":' || ((n // 3) % 4) || '}}}}' END AS doc
  FROM o WINDOW w AS (PARTITION BY {_KEY} ORDER BY ts_ns, seq)),
e AS (SELECT *, coalesce(p_gone, true) AS fresh, list_filter([CASE WHEN p_rev <> n % 3 THEN '{{"op":"replace","path":"/metadata/labels/rev","value":"' || rev || '"}}' END, CASE WHEN p_arg <> n % 2 THEN '{{"op":"replace","path":"/spec/args/1","value":"' || arg || '"}}' END, CASE WHEN p_q <> q THEN '{{"op":"replace","path":"/spec/replicas","value":' || q || '}}' END], lambda x: x IS NOT NULL) AS ops FROM d),
c AS (SELECT *, CASE WHEN gone THEN CASE WHEN NOT fresh AND NOT ev THEN 'Deleted' END WHEN fresh THEN CASE WHEN ev OR warm THEN 'Added' ELSE 'Snapshot' END WHEN p_uid <> uid THEN 'Added' WHEN len(ops) > 0 THEN 'Modified' END AS what FROM e),
l AS (SELECT *, sum(CASE WHEN what IN ('Added', 'Snapshot') THEN 1 ELSE 0 END) OVER w AS life, max(CASE WHEN what IS NOT NULL THEN ts_ns END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ns FROM c WINDOW w AS (PARTITION BY {_KEY} ORDER BY ts_ns, seq)),
m AS (SELECT *, CASE WHEN ev OR what <> 'Modified' THEN 0 ELSE sum(CASE WHEN what = 'Modified' THEN 1 ELSE 0 END) OVER (PARTITION BY {_KEY}, life ORDER BY ts_ns, seq) % 5 END::BIGINT AS steps FROM l),
y AS (SELECT seq, ts_ns, 'default' AS sink, cluster_id, CASE WHEN what = 'Modified' AND NOT ev AND steps = 0 THEN 'Checkpoint' ELSE what END AS event_type, api_group, 'v1' AS api_version, kind, namespace, name, CASE WHEN gone THEN p_uid ELSE uid END AS uid,
  CASE WHEN gone THEN '' ELSE n::VARCHAR END AS resource_version, []::VARCHAR[] AS actors, CASE WHEN gone OR steps > 0 THEN '' ELSE doc END AS data, CASE WHEN what = 'Modified' AND NOT ev THEN '[' || array_to_string(ops, ',') || ']' ELSE '' END AS diff, CASE WHEN gone THEN '' ELSE sha256(doc) END AS sha256, NULL::VARCHAR AS error, steps, doc FROM m WHERE what IS NOT NULL
  UNION ALL SELECT seq, ts_ns - CASE WHEN last_ns < ts_ns - 1 THEN 1 ELSE 0 END, 'default', cluster_id, 'Deleted', api_group, 'v1', kind, namespace, name, p_uid, '', [], '', '', '', NULL, 0, NULL FROM m WHERE NOT gone AND NOT fresh AND NOT ev AND p_uid <> uid)"""
_ARRIVED = "ORDER BY ts_ns DESC, seq DESC, event_type = 'Deleted'"
_APP, _TIER = "'a' || (user_id % 3)::VARCHAR", "CASE WHEN user_id % 5 = 0 THEN 'web' ELSE 'db' END"


_POD = "'p' || (floor(value / 2)::BIGINT % 2)::VARCHAR"


def _alert(which: str, window: int, seconds: int) -> str:
    """Sums of the series' rates by sink that have been above 0 for ``seconds``."""
    return f"""WITH m AS (SELECT *, {_POD} AS pod FROM ({_D('metrics')}) WHERE {which}), i AS (SELECT *, lag(value) OVER (PARTITION BY sink, outcome, pod ORDER BY ts) AS p FROM m),
          g AS (SELECT sink, ts, epoch_us(ts) AS us, coalesce(sum(CASE WHEN p IS NULL THEN NULL WHEN value >= p THEN value - p ELSE value END), 0) AS inc FROM i GROUP BY ALL),
          t AS (SELECT sink, ts, us, sum(inc) OVER (PARTITION BY sink ORDER BY us RANGE BETWEEN {window * 1000000 - 1} PRECEDING AND CURRENT ROW) / {window} AS rate FROM g),
          r AS (SELECT *, sum(CASE WHEN rate > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY sink ORDER BY us) AS run FROM t), h AS (SELECT *, min(CASE WHEN rate > 0 THEN ts END) OVER (PARTITION BY sink, run) AS since FROM r)
          SELECT sink, ts, round(rate, 6) AS rate, since FROM h WHERE rate > 0 AND us - epoch_us(since) >= {seconds * 1000000}"""


def _pairs() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return {
        "final_reference": (final_reference, f"{_RS} SELECT * FROM rs QUALIFY row_number() OVER (PARTITION BY {_KEY}, ts ORDER BY ingest_seq DESC) = 1"),
        "final_safe": (final_safe, f"{_RS} SELECT * FROM rs QUALIFY row_number() OVER (PARTITION BY {_KEY}, ts, uid, event_type ORDER BY ingest_seq DESC) = 1"),
        "tail_lookback": (tail_lookback, f"{_RS} SELECT ts, name, uid, event_type, ingest_seq FROM (SELECT * FROM rs WHERE ts > TIMESTAMP '2024-01-24 12:00:00' QUALIFY row_number() OVER (PARTITION BY {_KEY}, ts, uid, event_type ORDER BY ingest_seq DESC) = 1)"),
        "unchanged_dropped": (unchanged_dropped, f"{_RS}, h AS (SELECT *, substring(sha256, 1, 1) AS c, lag(substring(sha256, 1, 1)) OVER (PARTITION BY {_KEY}, uid ORDER BY ts, ingest_seq) AS p FROM rs) SELECT cluster_id, name, uid, ts, c AS sha256, ingest_seq FROM h WHERE p IS NULL OR p <> c"),
        "zombies": (zombies, f"{_RS}, {_KNOWN}, {_ZOMBIES} SELECT * FROM z"),
        "unclosed_priors": (unclosed_priors, f"{_RS}, {_KNOWN} SELECT {_KEY}, uid, sha256, api_version, ts FROM s WHERE NOT cur"),
        "orphan_scopes": (orphan_scopes, f"WITH {_WS} SELECT {_SC}, v AS api_version FROM (SELECT {_SC}, first(action ORDER BY ts DESC, action DESC) AS a, first(api_version ORDER BY ts DESC, action DESC) AS v FROM ws GROUP BY ALL) WHERE a = 'Started' AND kind <> 'Pod'"),
        "recovered_deletions": (recovered_deletions, f"""{_RS}, {_WS}, {_KNOWN}, {_ZOMBIES},
          a AS (SELECT {_SC} FROM (SELECT {_SC}, first(action ORDER BY ts DESC, action DESC) AS x FROM ws WHERE ts < TIMESTAMP '{EPOCH}' GROUP BY ALL) WHERE x = 'Started'),
          d AS (SELECT CASE WHEN replaced THEN ts ELSE TIMESTAMP '{NOW}' END AS ts, {_KEY}, uid, CASE WHEN replaced THEN api_version ELSE '' END AS api_version FROM z
            UNION ALL SELECT ts, {_KEY}, uid, api_version FROM s WHERE NOT cur AND kind <> 'Event' AND (({_KEY}, uid)) NOT IN (SELECT ({_KEY}, uid) FROM live))
          SELECT ts, cluster_id, kind, namespace, name, uid, api_version FROM d WHERE ({_SC}) IN (SELECT ({_SC}) FROM a) OR namespace <> '' AND (cluster_id, api_group, kind) IN (SELECT (cluster_id, api_group, kind) FROM a WHERE namespace = '')"""),
        "converged": (converged, f"""{_RS}, {_KNOWN}, f AS (SELECT * FROM rs QUALIFY row_number() OVER (PARTITION BY {_KEY}, ts ORDER BY ingest_seq DESC) = 1)
          SELECT {_KEY}, first(f.sha256 ORDER BY f.ts DESC, f.event_type = 'Deleted' DESC, f.ingest_seq DESC) = l.live AND count(*) FILTER (f.sha256 = l.live) = 1 AS converged FROM f JOIN (SELECT {_KEY}, sha256 AS live FROM s WHERE cur) l USING ({_KEY}) GROUP BY {_KEY}, l.live"""),
        "fan_out": (fan_out, f"""{_RS}, e AS (SELECT event_id, {_APP} AS app, {_TIER} AS tier FROM events), o AS (SELECT * FROM rs JOIN e ON ingest_seq % 1000000000 = event_id)
          SELECT DISTINCT 's0' AS sink, cluster_id, kind, namespace, name, ingest_seq AS seq FROM o WHERE kind = 'Deployment' AND namespace IN ('payments', 'infra') AND app IN ('a0', 'a1') OR kind = 'Pod' AND namespace = 'infra' AND tier <> 'web'
          UNION ALL SELECT 's1', cluster_id, kind, namespace, name, ingest_seq FROM o WHERE kind = 'ConfigMap'"""),
        "selector_match": (selector_match, f'SELECT event_id, {_APP} IN (\'a0\', \'a2\') AND {_TIER} <> \'web\' AS "both", true AS "none", false AS absent, {_APP} <> \'a1\' AS present FROM events'),
        "watch_targets": (watch_targets, """SELECT * FROM (VALUES
          ('s0', 'apps', 'v1', 'Deployment', 'infra', 'StreamRule/infra/r2;StreamRule/payments/r1', 'app in (a0,a1)', 'data.password'),
          ('s0', 'apps', 'v1', 'Deployment', 'payments', 'StreamRule/payments/r1', 'app in (a0,a1)', 'data.password'),
          ('s0', '', 'v1', 'Pod', 'infra', 'StreamRule/infra/r2', 'tier!=web', ''),
          ('s1', '', 'v1', 'ConfigMap', '', 'ClusterStreamRule//r3', '!missing,tier', 'spec.token')) t(sink, "group", version, kind, namespace, rule_keys, selectors, redactions)"""),
        "scope_transitions": (scope_transitions, f"""WITH {_WS}, l AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {_SC}, rule_ref ORDER BY ts) % 2 = 1 THEN 1 ELSE -1 END AS delta FROM ws WHERE rule_ref <> ''),
          g AS (SELECT {_SC}, ts, sum(delta)::BIGINT AS d, min(rule_ref) AS rule_ref, max(api_version) AS api_version FROM l GROUP BY {_SC}, ts), n AS (SELECT *, sum(d) OVER (PARTITION BY {_SC} ORDER BY ts) AS n FROM g)
          SELECT ts, cluster_id, 's' AS sink, api_group, kind, namespace, api_version, CASE WHEN n > 0 THEN 'Started' ELSE 'Stopped' END AS action, rule_ref FROM n WHERE (n - d <= 0) <> (n <= 0)"""),
        "write_rates": (write_rates, f"""WITH m AS ({_D('metrics')}), i AS (SELECT *, lag(value) OVER (PARTITION BY sink, outcome ORDER BY ts) AS p FROM m WHERE name = 'writes_total')
          SELECT sink, time_bucket(INTERVAL '1 day', ts) AS time, round(coalesce(sum(CASE WHEN p IS NULL THEN NULL WHEN value >= p THEN value - p ELSE value END), 0) / 86400, 6) AS rate FROM i GROUP BY ALL"""),
        "failing_writes": (failing_writes, f"""WITH m AS ({_D('metrics')}), r AS (SELECT *, outcome = 'ok' AS f, sum(CASE WHEN outcome = 'ok' THEN 0 ELSE 1 END) OVER (PARTITION BY sink ORDER BY ts) AS run FROM m WHERE name = 'queue_depth'),
          h AS (SELECT *, min(CASE WHEN f THEN ts END) OVER (PARTITION BY sink, run) AS since FROM r) SELECT sink, ts, since FROM h WHERE f AND epoch_us(ts) - epoch_us(since) >= 3600000000"""),
        "alert_write_failures": (alert_write_failures, _alert("name = 'writes_total' AND outcome = 'failed'", 86400, 6 * 3600)),
        "alert_enqueue_timeouts": (alert_enqueue_timeouts, _alert("name = 'queue_depth'", 3600, 3600)),
        "alert_rules_not_ready": (alert_rules_not_ready, f"""WITH m AS (SELECT *, {_POD} AS pod, (floor(value / 8)::BIGINT % 5)::DOUBLE AS v FROM ({_D('metrics')}) WHERE name = 'queue_depth' AND outcome = 'failed'),
          r AS (SELECT *, sum(CASE WHEN v > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY sink, pod ORDER BY ts) AS run FROM m), h AS (SELECT *, min(CASE WHEN v > 0 THEN ts END) OVER (PARTITION BY sink, pod, run) AS since FROM r)
          SELECT ts, sink, pod, v AS value, since FROM h WHERE v > 0 AND epoch_us(ts) - epoch_us(since) >= 86400000000"""),
        "gauges_by_sink": (gauges_by_sink, f"SELECT sink, sum(v) AS value FROM (SELECT sink, outcome, {_POD} AS pod, arg_max(value, ts) AS v FROM ({_D('metrics')}) WHERE name = 'queue_depth' GROUP BY ALL) GROUP BY sink"),
        "latency_quantiles": (latency_quantiles, """WITH e AS (SELECT * FROM (VALUES (0.0::DOUBLE, 5.0::DOUBLE), (5, 10), (10, 25), (25, 50), (50, 100), (100, 250), (250, 'inf')) t(lo, le)),
          c AS (SELECT event_type, lo, le, count(*) FILTER (value <= le)::DOUBLE AS v, count(*) FILTER (value <= lo AND lo > 0)::DOUBLE AS below, count(*) AS n FROM events, e GROUP BY ALL)
          SELECT event_type, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * CASE WHEN v > below THEN (0.9 * n - below) / (v - below) ELSE 0 END END, 6) AS quantile FROM c WHERE v >= 0.9 * n QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1"""),
        "exact_percentiles": (exact_percentiles, "SELECT quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99 FROM events"),
        "rule_conditions": (rule_conditions, "SELECT event_type AS condition, s AS status, count(*) FILTER (CASE WHEN value < 10 THEN 'true' WHEN value < 50 THEN 'false' ELSE 'other' END = s) AS rules FROM events, (VALUES ('true'), ('false'), ('unknown')) t(s) GROUP BY ALL"),
        "classify_events": (classify_events, f"{_RS}, {_CLASSIFIED} SELECT * EXCLUDE (steps, doc) FROM y"),
        "classify_churn": (classify_churn, None),
        "reconstruct_events": (reconstruct_events, f"""{_RS}, {_CLASSIFIED} SELECT {_KEY}, uid, make_timestamp(ts_ns // 1000) AS ts, event_type <> 'Deleted' AS exists, doc AS state, sha256(doc) AS sha256, CASE WHEN doc IS NOT NULL THEN sha256(doc) = sha256 END AS verified, steps, error
          FROM y WHERE make_timestamp(ts_ns // 1000) <= TIMESTAMP '2024-01-21 12:00:00' QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY ts_ns DESC, seq DESC, event_type = 'Deleted') = 1"""),
        "digest_of_classified": (digest_of_classified, f"""{_RS}, {_CLASSIFIED} SELECT first(event_type {_ARRIVED}) AS last_event, first(sha256 {_ARRIVED}) AS sha256, first(resource_version {_ARRIVED}) AS resource_version, make_timestamp(max(ts_ns) // 1000) AS last_seen, count(DISTINCT uid) AS incarnations
          FROM y WHERE cluster_id = 'c0' AND api_group = 'apps' AND kind = 'Deployment' AND namespace = 'infra' AND name = 'obj-8'"""),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _pairs().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _pairs().items() if sql}
