"""The registered queries over the histories derived from the table events, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import dashboards as d
from tidemark.plans import library as q
from tidemark.plans import samples
from tidemark.sources import adapter

CLUSTER, GROUP, KIND, NAMESPACE, NAME, UID = "c0", "apps", "Deployment", "infra", "obj-8", "obj-8-1"
START, END, AT = datetime(2024, 1, 4), datetime(2024, 1, 26, 12), datetime(2024, 1, 15, 6)
MANAGER, THRESHOLD = "argocd-controller", 5
_OF = (CLUSTER, KIND, NAMESPACE, NAME)
_PANEL = d.Panel(CLUSTER, START, END, 86400, ["payments", "infra", ""], ["Deployment", "ConfigMap"], ["Added", "Modified", "Checkpoint", "Deleted"], MANAGER, THRESHOLD)

_WITH = f"WITH rs AS ({adapter.duckdb_sql('states')}), ws AS ({adapter.duckdb_sql('scopes')}), fin AS (SELECT * FROM rs QUALIFY row_number() OVER (PARTITION BY cluster_id, api_group, kind, namespace, name, ts ORDER BY ingest_seq DESC) = 1)"
_IN = f"cluster_id = '{CLUSTER}' AND ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
_CHANGED = f"{_IN} AND event_type IN ('Modified', 'Checkpoint')"
_OBJ = f"cluster_id = '{CLUSTER}' AND kind = '{KIND}' AND namespace = '{NAMESPACE}' AND name = '{NAME}'"
_TIES = "cluster_id, api_group, kind, namespace, name, uid, event_type"
_MANAGERS = "array_to_string(list_sort(actors), ', ')"
_UNION = "coalesce(array_to_string(list_sort(list_distinct(flatten(list(actors)))), ', '), '')"
_CHANGE = "CASE WHEN diff <> '' THEN diff WHEN data <> '' THEN '(full state' || {} || ')' ELSE '' END AS change"
_SIZE = "', ' || strlen(data)::VARCHAR || ' bytes'"
_LAST = "ORDER BY ts DESC, event_type = 'Deleted' DESC, ingest_seq DESC"
_NEWEST = "ORDER BY ts DESC, ingest_seq DESC, event_type = 'Deleted'"
_VARS = "namespace IN ('payments', 'infra', '')"
_KINDS = "kind IN ('Deployment', 'ConfigMap')"
_TYPES = "event_type IN ('Added', 'Modified', 'Checkpoint', 'Deleted')"
_DAY = "time_bucket(INTERVAL '1 day', ts) AS time"


def _j(*path: str) -> str:
    """A string inside data, '' where there is none; data that is '' isn't JSON."""
    p = "$." + ".".join(path)
    return f"CASE WHEN data = '' THEN '' WHEN json_type(data, '{p}') = 'VARCHAR' THEN json_extract_string(data, '{p}') ELSE '' END"


def _n(*path: str) -> str:
    return f"CASE WHEN data = '' THEN 0 ELSE coalesce(json_extract(data, '$.{'.'.join(path)}')::BIGINT, 0) END"


def _subject(field: str) -> str:
    return f"coalesce(nullif({_j('involvedObject', field)}, ''), nullif({_j('regarding', field)}, ''))"


_OCCURS = f"greatest({_n('count')}, {_n('deprecatedCount')}, {_n('series', 'count')}) AS occurrences"
_TOLD = f"{_j('type')} AS severity, {_j('reason')} AS reason, {_j('message')} AS message"
_FLAPPING = f"SELECT namespace, kind, name FROM fin WHERE {_CHANGED} AND {_VARS} AND {_KINDS} GROUP BY ALL HAVING count(*) >= {THRESHOLD}"
_AGO, _AFTER = "TIMESTAMP '2024-01-15 06:00:00' - INTERVAL 15 HOUR", "TIMESTAMP '2024-01-15 06:00:00' + INTERVAL 15 HOUR"


def _rs(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(adapter.resource_states(spark, sf_dir))


def _ws(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(adapter.watch_scopes(spark, sf_dir))


def _pairs() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """Query and SQL by name."""
    drift = f"SELECT namespace, kind, name, count(*) AS modifications, max(ts) AS last_change, {_UNION} AS field_managers FROM fin WHERE {_CHANGED} AND NOT list_contains(actors, '{MANAGER}')"
    flap = f"SELECT namespace, kind, name, count(*) AS modifications, {_UNION} AS field_managers, min(ts) AS first_change, max(ts) AS last_change FROM fin WHERE {_CHANGED} GROUP BY namespace, kind, name HAVING count(*) >= {THRESHOLD}"
    order = "ORDER BY modifications DESC, namespace, kind, name"
    window = f"FROM fin WHERE {_IN} AND namespace = '{NAMESPACE}'"
    states = "SELECT api_group, kind, namespace, first(action ORDER BY ts DESC, action DESC) AS action FROM ws WHERE cluster_id = 'c0' GROUP BY ALL"
    about = f"FROM fin WHERE cluster_id = '{CLUSTER}' AND kind = 'Event' AND namespace = '{NAMESPACE}'"
    actor = f"SELECT ts, unnest(actors) AS actor FROM fin WHERE {_CHANGED} AND {_VARS}"
    panel = f"FROM fin WHERE {_CHANGED} AND {_VARS}"
    return {
        "recent_changes": (_rs(lambda r: q.recent_changes(r, CLUSTER)), f"SELECT ts, event_type, kind, namespace, name, {_MANAGERS} AS field_managers FROM rs WHERE cluster_id = '{CLUSTER}' ORDER BY ts DESC, {_TIES}, ingest_seq DESC LIMIT 20"),
        "incident_window_brief": (_rs(lambda r: q.incident_window_brief(r, CLUSTER, NAMESPACE, START, END)), f"SELECT ts, event_type, kind, name, {_CHANGE.format(chr(39) * 2)} {window}"),
        "incident_window": (_rs(lambda r: q.incident_window(r, CLUSTER, NAMESPACE, START, END)), f"SELECT ts, event_type, kind, name, resource_version, {_MANAGERS} AS field_managers, {_CHANGE.format(_SIZE)} {window}"),
        "latest_full_state_at": (_rs(lambda r: q.latest_full_state_at(r, *_OF, AT)), f"SELECT ts, event_type, data FROM fin WHERE {_OBJ} AND data <> '' AND ts <= TIMESTAMP '{AT}' ORDER BY ts DESC LIMIT 1"),
        "gitops_drift_brief": (_rs(lambda r: q.gitops_drift_brief(r, CLUSTER, START, END, MANAGER)), f"SELECT * EXCLUDE (field_managers) FROM ({drift} GROUP BY namespace, kind, name) {order} LIMIT 20"),
        "gitops_drift": (_rs(lambda r: q.gitops_drift(r, CLUSTER, START, END, MANAGER)), f"{drift} GROUP BY namespace, kind, name {order} LIMIT 100"),
        "top_flappers": (_rs(lambda r: q.top_flappers(r, CLUSTER, START, END, THRESHOLD)), f"{flap} {order} LIMIT 50"),
        "flappers_brief": (_rs(lambda r: q.flappers_brief(r, CLUSTER, START, END, THRESHOLD)), f"SELECT * EXCLUDE (first_change, last_change) FROM ({flap}) {order} LIMIT 20"),
        "object_history_to": (_rs(lambda r: q.object_history_to(r, CLUSTER, GROUP, KIND, NAMESPACE, NAME, AT)), f"SELECT ts, event_type, uid, data, diff, sha256 FROM fin WHERE {_OBJ} AND api_group = '{GROUP}' AND ts <= TIMESTAMP '{AT}'"),
        "object_digest": (_rs(lambda r: q.object_digest(r, CLUSTER, GROUP, KIND, NAMESPACE, NAME)), f"SELECT coalesce(first(event_type {_NEWEST}), '') AS last_event, coalesce(first(sha256 {_NEWEST}), '') AS sha256, coalesce(first(resource_version {_NEWEST}), '') AS resource_version, max(ts) AS last_seen, count(DISTINCT uid) AS incarnations FROM rs WHERE {_OBJ} AND api_group = '{GROUP}'"),
        "deleted_last_state": (_rs(lambda r: q.deleted_last_state(r, CLUSTER, START, END)), f"SELECT d.namespace, d.kind, d.name, d.uid, deleted_at, arg_max(s.data, s.ts) AS last_full_state, max(s.ts) AS state_captured_at FROM (SELECT namespace, kind, name, uid, max(ts) AS deleted_at FROM fin WHERE {_IN} AND event_type = 'Deleted' GROUP BY ALL) d JOIN (SELECT * FROM fin WHERE cluster_id = '{CLUSTER}' AND data <> '') s ON s.namespace = d.namespace AND s.kind = d.kind AND s.name = d.name AND s.uid = d.uid WHERE s.ts <= deleted_at GROUP BY ALL"),
        "events_by_uid": (_rs(lambda r: q.events_by_uid(r, CLUSTER, NAMESPACE, AT, UID, 15 * 60)), f"SELECT ts, {_TOLD}, {_OCCURS}, name AS event_name {about} AND ts BETWEEN {_AGO} AND {_AFTER} AND {_subject('uid')} = '{UID}'"),
        "events_by_name": (_rs(lambda r: q.events_by_name(r, *_OF, START, END)), f"SELECT ts, {_j('reason')} AS reason, {_j('message')} AS message {about} AND {_IN} AND {_subject('name')} = '{NAME}' AND {_subject('kind')} = '{KIND}'"),
        "changes_and_events": (_rs(lambda r: q.changes_and_events(r, CLUSTER, GROUP, KIND, NAMESPACE, NAME, UID, START, END)), f"SELECT ts, 'change' AS source, event_type AS what, diff AS detail FROM fin WHERE {_OBJ} AND api_group = '{GROUP}' AND {_IN} UNION ALL SELECT ts, 'event', {_j('reason')}, {_j('message')} {about} AND {_IN} AND {_subject('uid')} = '{UID}'"),
        "noisy_reasons": (_rs(lambda r: q.noisy_reasons(r, CLUSTER, START, END)), f"SELECT {_j('reason')} AS reason, {_subject('kind')} AS subject_kind, count(*) AS rows, count(DISTINCT (namespace, name)) AS distinct_events FROM fin WHERE {_IN} AND kind = 'Event' AND {_j('type')} = 'Warning' GROUP BY ALL ORDER BY rows DESC, reason, subject_kind LIMIT 25"),
        "scope_was_active": (_ws(lambda w: q.scope_was_active(w, CLUSTER, GROUP, KIND, NAMESPACE, AT)), f"SELECT coalesce(first(action ORDER BY ts DESC, action DESC), '') = 'Started' AS active FROM ws WHERE cluster_id = '{CLUSTER}' AND api_group = '{GROUP}' AND kind = '{KIND}' AND namespace = '{NAMESPACE}' AND ts < TIMESTAMP '{AT}'"),
        "open_scopes": (_ws(lambda w: q.open_scopes(w, CLUSTER)), f"SELECT api_group, kind, namespace FROM ({states}) WHERE action = 'Started'"),
        "scope_states": (_ws(lambda w: q.scope_states(w, CLUSTER)), states),
        "last_known_states": (_rs(lambda r: q.last_known_states(r, CLUSTER, GROUP, KIND)), f"SELECT * EXCLUDE (event_type) FROM (SELECT namespace, name, uid, first(sha256 {_LAST}) AS sha256, first(api_version {_LAST}) AS api_version, max(ts) AS ts, first(event_type {_LAST}) AS event_type FROM rs WHERE cluster_id = '{CLUSTER}' AND api_group = '{GROUP}' AND kind = '{KIND}' GROUP BY namespace, name, uid) WHERE event_type <> 'Deleted'"),
        "duplicate_deletes": (_rs(lambda r: q.duplicate_deletes(r, CLUSTER)), f"SELECT uid, min(name) AS name, count(*) AS c FROM fin WHERE cluster_id = '{CLUSTER}' AND event_type = 'Deleted' GROUP BY uid HAVING count(*) > 1"),
        "resource_rows": (_rs(lambda r: q.resource_rows(r, CLUSTER, GROUP, KIND, NAMESPACE, NAME, event_types=["Added", "Deleted"])), f"SELECT * FROM fin WHERE {_OBJ} AND api_group = '{GROUP}' AND event_type IN ('Added', 'Deleted')"),
        "scope_rows": (_ws(lambda w: q.scope_rows(w, CLUSTER, GROUP, KIND, NAMESPACE, "Started")), f"SELECT * FROM ws WHERE cluster_id = '{CLUSTER}' AND api_group = '{GROUP}' AND kind = '{KIND}' AND namespace = '{NAMESPACE}' AND action = 'Started'"),
        "naive_tail": (_rs(lambda r: q.naive_tail(r, END).select("ts", "name", "event_type", "ingest_seq")), f"SELECT ts, name, event_type, ingest_seq FROM rs WHERE ts > TIMESTAMP '{END}'"),
        "first_rows": (_rs(lambda r: q.first_rows(r, CLUSTER)), f"SELECT event_type, kind, namespace, name, ts FROM rs WHERE cluster_id = '{CLUSTER}' ORDER BY ts, {_TIES}, ingest_seq LIMIT 20"),
        "last_patch": (_rs(lambda r: q.last_patch(r, CLUSTER, KIND, NAME)), f"SELECT ts, name, diff FROM rs WHERE cluster_id = '{CLUSTER}' AND kind = '{KIND}' AND name = '{NAME}' AND event_type = 'Modified' ORDER BY ts DESC, {_TIES}, ingest_seq DESC LIMIT 1"),
        "diff_heads": (_rs(lambda r: q.diff_heads(r, CLUSTER, KIND)), f"SELECT ts, name, event_type, substring(diff, 1, 120) AS diff_head FROM rs WHERE cluster_id = '{CLUSTER}' AND kind = '{KIND}' AND event_type = 'Modified' ORDER BY ts DESC, {_TIES}, ingest_seq DESC LIMIT 3"),
        "redaction_check": (_rs(lambda r: q.redaction_check(r, CLUSTER, KIND, NAME)), f"SELECT name, {_j('data', 'feature_flags')} AS feature_flags, {_j('data', 'password')} AS password FROM rs WHERE cluster_id = '{CLUSTER}' AND kind = '{KIND}' AND name = '{NAME}' AND data <> '' ORDER BY ts, {_TIES} LIMIT 1"),
        "scopes_log": (_ws(lambda w: q.scopes_log(w, CLUSTER)), f"SELECT ts, action, api_group, kind, namespace, rule_ref FROM ws WHERE cluster_id = '{CLUSTER}'"),
        "gitops_share_pct": (_rs(lambda r: d.gitops_share_pct(r, _PANEL)), f"SELECT round(100 * count(*) FILTER (list_contains(actors, '{MANAGER}')) / greatest(count(*), 1), 1) AS gitops_share_pct {panel}"),
        "objects_with_drift": (_rs(lambda r: d.objects_with_drift(r, _PANEL)), f"SELECT count(DISTINCT (api_group, kind, namespace, name)) AS objects_with_drift {panel} AND NOT list_contains(actors, '{MANAGER}')"),
        "top_actors_excl_gitops": (_rs(lambda r: d.top_actors_excl_gitops(r, _PANEL)), f"SELECT actor, count(*) AS modifications FROM ({actor}) WHERE actor <> '{MANAGER}' GROUP BY actor ORDER BY modifications DESC, actor LIMIT 20"),
        "modifications_by_actor_over_time": (_rs(lambda r: d.modifications_by_actor_over_time(r, _PANEL)), f"SELECT {_DAY}, actor, count(*) AS modifications FROM ({actor}) GROUP BY ALL"),
        "objects_changed_without_gitops": (_rs(lambda r: d.objects_changed_without_gitops(r, _PANEL)), f"{drift} AND {_VARS} GROUP BY namespace, kind, name {order} LIMIT 100"),
        "objects_over_threshold": (_rs(lambda r: d.objects_over_threshold(r, _PANEL)), f"SELECT count(*) AS objects_over_threshold FROM ({_FLAPPING})"),
        "modified_rows_in_window": (_rs(lambda r: d.modified_rows_in_window(r, _PANEL)), f"SELECT count(*) AS modified_rows {panel} AND {_KINDS}"),
        "flapping_over_time": (_rs(lambda r: d.flapping_over_time(r, _PANEL)), f"SELECT {_DAY}, namespace || '/' || kind || '/' || name AS object, count(*) AS modifications {panel} AND {_KINDS} AND (namespace, kind, name) IN ({_FLAPPING}) GROUP BY ALL"),
        "threshold_series": (_rs(lambda r: d.threshold_series(r, _PANEL)), f"SELECT DISTINCT {_DAY}, {THRESHOLD}::INT AS threshold FROM rs WHERE {_IN}"),
        "objects_by_change_count": (_rs(lambda r: d.objects_by_change_count(r, _PANEL)), f"SELECT namespace, kind, name, count(*) AS modifications, max(ts) AS last_change, {_UNION} AS field_managers, {THRESHOLD}::INT AS threshold {panel} AND {_KINDS} GROUP BY namespace, kind, name {order} LIMIT 100"),
        "change_volume_by_namespace": (_rs(lambda r: d.change_volume_by_namespace(r, _PANEL)), f"SELECT {_DAY}, if(namespace = '', '(cluster-scoped)', namespace) AS ns, count(*) AS changes FROM fin WHERE {_IN} AND {_KINDS} AND {_TYPES} GROUP BY ALL"),
        "change_volume_by_event_type": (_rs(lambda r: d.change_volume_by_event_type(r, _PANEL)), f"SELECT {_DAY}, event_type, count(*) AS changes FROM fin WHERE {_IN} AND {_KINDS} GROUP BY ALL"),
        "kinds_by_volume": (_rs(lambda r: d.kinds_by_volume(r, _PANEL)), f"SELECT if(api_group = '', 'core', api_group) || '/' || kind AS gvk, count(*) AS changes, count(DISTINCT (namespace, name)) AS objects, max(ts) AS last_change FROM fin WHERE {_IN} AND {_TYPES} GROUP BY gvk ORDER BY changes DESC, gvk LIMIT 50"),
        "busiest_namespaces": (_rs(lambda r: d.busiest_namespaces(r, _PANEL)), f"SELECT if(namespace = '', '(cluster-scoped)', namespace) AS ns, count(*) FILTER (event_type = 'Added') AS added, count(*) FILTER (event_type IN ('Modified', 'Checkpoint')) AS modified, count(*) FILTER (event_type = 'Deleted') AS deleted, count(*) FILTER (event_type = 'Snapshot') AS snapshot, count(*) AS total, count(DISTINCT (api_group, kind, name)) AS objects FROM fin WHERE {_IN} AND {_KINDS} GROUP BY ns ORDER BY total DESC, ns LIMIT 50"),
        "object_changes_over_time": (_rs(lambda r: d.object_changes_over_time(r, _PANEL, KIND, NAMESPACE, NAME)), f"SELECT {_DAY}, event_type, count(*) AS changes FROM fin WHERE {_OBJ} AND {_IN} GROUP BY ALL"),
        "object_field_managers": (_rs(lambda r: d.object_field_managers(r, _PANEL, KIND, NAMESPACE, NAME)), f"SELECT actor, count(*) AS rows_touched FROM (SELECT unnest(actors) AS actor FROM fin WHERE {_OBJ} AND {_IN}) GROUP BY actor"),
        "object_latest_state": (_rs(lambda r: d.object_latest_state(r, _PANEL, KIND, NAMESPACE, NAME)), f"SELECT first(event_type {_NEWEST}) AS last_event, max(ts) AS last_seen, first(uid {_NEWEST}) AS current_uid, first(resource_version {_NEWEST}) AS resource_version, first(sha256 {_NEWEST}) AS sha256, count(*) AS rows_recorded, count(DISTINCT uid) AS incarnations FROM rs WHERE {_OBJ}"),
        "object_rows_and_diffs": (_rs(lambda r: d.object_rows_and_diffs(r, _PANEL, KIND, NAMESPACE, NAME)), f"SELECT ts, event_type, uid, resource_version, {_MANAGERS} AS field_managers, {_CHANGE.format(_SIZE)}, sha256 FROM fin WHERE {_OBJ} AND {_IN}"),
        "object_events": (_rs(lambda r: d.object_events(r, _PANEL, KIND, NAMESPACE, NAME)), f"SELECT ts, {_TOLD}, {_OCCURS} {about} AND {_IN} AND {_subject('name')} = '{NAME}' AND {_subject('kind')} = '{KIND}' ORDER BY ts DESC LIMIT 200"),
        "picker_clusters": (_rs(lambda r: d.picker(r, "cluster_id")), "SELECT DISTINCT cluster_id FROM rs"),
        "picker_namespaces": (_rs(lambda r: d.picker(r, "namespace", cluster_id=CLUSTER)), f"SELECT DISTINCT namespace FROM rs WHERE cluster_id = '{CLUSTER}'"),
        "picker_kinds": (_rs(lambda r: d.picker(r, "kind", cluster_id=CLUSTER)), f"SELECT DISTINCT kind FROM rs WHERE cluster_id = '{CLUSTER}'"),
        "picker_namespaces_of_kind": (_rs(lambda r: d.picker(r, "namespace", cluster_id=CLUSTER, kind=KIND)), f"SELECT DISTINCT namespace FROM rs WHERE cluster_id = '{CLUSTER}' AND kind = '{KIND}'"),
        "picker_names": (_rs(lambda r: d.picker(r, "name", cluster_id=CLUSTER, kind=KIND, namespace=NAMESPACE)), f"SELECT DISTINCT name FROM rs WHERE cluster_id = '{CLUSTER}' AND kind = '{KIND}' AND namespace = '{NAMESPACE}'"),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _pairs().items()} | samples.queries()


def oracle_sql() -> dict[str, str]:
    return {name: f"{_WITH} {sql}" for name, (_, sql) in _pairs().items()} | samples.oracle_sql()
