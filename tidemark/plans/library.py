"""The published query library over resource_states and watch_scopes.

Each function takes the tables' DataFrames and typed parameters; no value is ever
put into SQL text.  Orders end in the identity and arrival, so that limits are
deterministic.  Like the published statements, object queries go by kind,
namespace and name; ``group=`` narrows them.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import between, change_text, first_filled, json_str, literal_like, managers, occurrences, subject, union_of
from tidemark.operators.final import final
from tidemark.sources.schema import CHANGES, latest

_TIES = ["cluster_id", "api_group", "kind", "namespace", "name", "uid", "event_type"]


def _object(rs: DataFrame, cluster: str, kind: str, namespace: str, name: str, group: str | None = None) -> DataFrame:
    rows = rs.where((F.col("cluster_id") == cluster) & (F.col("kind") == kind) & (F.col("namespace") == namespace) & (F.col("name") == name))
    return rows if group is None else rows.where(F.col("api_group") == group)


def _newest_first(df: DataFrame) -> list[Column]:
    return [F.desc("ts"), *[F.col(c) for c in _TIES if c in df.columns], *([F.desc("ingest_seq")] if "ingest_seq" in df.columns else [])]


def recent_changes(rs: DataFrame, cluster: str, limit: int = 20) -> DataFrame:
    rows = rs.where(F.col("cluster_id") == cluster)
    return rows.orderBy(*_newest_first(rows)).limit(limit).select("ts", "event_type", "kind", "namespace", "name", managers().alias("field_managers"))


def _window_rows(rs: DataFrame, cluster: str, namespace: str, start: datetime, end: datetime) -> DataFrame:
    return final(rs.where((F.col("cluster_id") == cluster) & (F.col("namespace") == namespace) & between(rs, start, end)))


def incident_window_brief(rs: DataFrame, cluster: str, namespace: str, start: datetime, end: datetime) -> DataFrame:
    rows = _window_rows(rs, cluster, namespace, start, end)
    return rows.orderBy("ts", *_TIES).select("ts", "event_type", "kind", "name", change_text(False).alias("change"))


def incident_window(rs: DataFrame, cluster: str, namespace: str, start: datetime, end: datetime) -> DataFrame:
    rows = _window_rows(rs, cluster, namespace, start, end)
    return rows.orderBy("ts", *_TIES).select("ts", "event_type", "kind", "name", "resource_version", managers().alias("field_managers"), change_text().alias("change"))


def latest_full_state_at(rs: DataFrame, cluster: str, kind: str, namespace: str, name: str, at: datetime) -> DataFrame:
    rows = final(_object(rs, cluster, kind, namespace, name).where(F.col("ts") <= literal_like(rs, "ts", at))).where("data <> ''")
    return rows.orderBy(*_newest_first(rows)).limit(1).select("ts", "event_type", "data")


def _changes(rs: DataFrame, cluster: str, start: datetime, end: datetime) -> DataFrame:
    return final(rs.where((F.col("cluster_id") == cluster) & between(rs, start, end))).where(F.col("event_type").isin(*CHANGES))


_OBJECT = ["namespace", "kind", "name"]


def gitops_drift(rs: DataFrame, cluster: str, start: datetime, end: datetime, manager: str, limit: int = 100, namespaces: Sequence[str] | None = None) -> DataFrame:
    """Changes of objects that ``manager`` doesn't own a part of."""
    rows = _changes(rs if namespaces is None else rs.where(F.col("namespace").isin(*namespaces)), cluster, start, end).where(~F.array_contains("actors", manager))
    return rows.groupBy(*_OBJECT).agg(F.count("*").alias("modifications"), F.max("ts").alias("last_change"), F.array_join(union_of(), ", ").alias("field_managers")).orderBy(F.desc("modifications"), *_OBJECT).limit(limit)


def gitops_drift_brief(rs: DataFrame, cluster: str, start: datetime, end: datetime, manager: str) -> DataFrame:
    return gitops_drift(rs, cluster, start, end, manager, 20).drop("field_managers")


def top_flappers(rs: DataFrame, cluster: str, start: datetime, end: datetime, threshold: int, limit: int = 50) -> DataFrame:
    grouped = _changes(rs, cluster, start, end).groupBy(*_OBJECT)
    found = grouped.agg(F.count("*").alias("modifications"), F.array_join(union_of(), ", ").alias("field_managers"), F.min("ts").alias("first_change"), F.max("ts").alias("last_change"))
    return found.where(F.col("modifications") >= threshold).orderBy(F.desc("modifications"), *_OBJECT).limit(limit)


def flappers_brief(rs: DataFrame, cluster: str, start: datetime, end: datetime, threshold: int) -> DataFrame:
    return top_flappers(rs, cluster, start, end, threshold, 20).drop("first_change", "last_change")


def object_history_to(rs: DataFrame, cluster: str, group: str, kind: str, namespace: str, name: str, at: datetime) -> DataFrame:
    rows = final(_object(rs, cluster, kind, namespace, name, group).where(F.col("ts") <= literal_like(rs, "ts", at)))
    return rows.orderBy("ts", *_TIES).select("ts", "event_type", "uid", "data", "diff", "sha256")


def object_digest(rs: DataFrame, cluster: str, group: str, kind: str, namespace: str, name: str) -> DataFrame:
    """One row, also for an object without history; by design over uncollapsed rows."""
    order = latest(rs, incarnations=True)
    last = [F.coalesce(F.max_by(c, order), F.lit("")).alias(a) for c, a in (("event_type", "last_event"), ("sha256", "sha256"), ("resource_version", "resource_version"))]
    return _object(rs, cluster, kind, namespace, name, group).agg(*last, F.max("ts").alias("last_seen"), F.count_distinct("uid").alias("incarnations"))


def deleted_last_state(rs: DataFrame, cluster: str, start: datetime, end: datetime) -> DataFrame:
    """Each deletion with the newest full state of its incarnation at or before it."""
    of = [*_OBJECT, "uid"]
    inside = rs.where(F.col("cluster_id") == cluster)
    deletions = final(inside.where(between(rs, start, end))).where("event_type = 'Deleted'").groupBy(*of).agg(F.max("ts").alias("deleted_at"))
    # States after the window can't precede a deletion in it; only objects with deletions are collapsed.
    before = inside.where(F.col("ts") <= literal_like(rs, "ts", end)).join(deletions.select(*_OBJECT).distinct(), _OBJECT, "left_semi")
    states = final(before).where("data <> ''")
    states = states.select(*of, F.col("ts").alias("at"), "data", latest(states).alias("order"))
    found = deletions.join(states, of).where("at <= deleted_at")
    return found.groupBy(*of, "deleted_at").agg(F.max_by("data", "order").alias("last_full_state"), F.max("at").alias("state_captured_at")).orderBy(F.desc("deleted_at"), *of)


def _events(rs: DataFrame, cluster: str, namespace: str, start: datetime, end: datetime) -> DataFrame:
    rows = rs.where((F.col("cluster_id") == cluster) & (F.col("kind") == "Event") & (F.col("namespace") == namespace) & between(rs, start, end))
    return final(rows)


def events_by_uid(rs: DataFrame, cluster: str, namespace: str, at: datetime, uid: str, minutes: int = 15) -> DataFrame:
    rows = _events(rs, cluster, namespace, at - timedelta(minutes=minutes), at + timedelta(minutes=minutes)).where(subject("uid") == uid)
    text = [json_str("data", c).alias(a) for c, a in (("type", "severity"), ("reason", "reason"), ("message", "message"))]
    return rows.orderBy("ts", *_TIES).select("ts", *text, occurrences().alias("occurrences"), F.col("name").alias("event_name"))


def events_by_name(rs: DataFrame, cluster: str, kind: str, namespace: str, name: str, start: datetime, end: datetime) -> DataFrame:
    rows = _events(rs, cluster, namespace, start, end).where((subject("name") == name) & (subject("kind") == kind))
    return rows.orderBy("ts", *_TIES).select("ts", json_str("data", "reason").alias("reason"), json_str("data", "message").alias("message"))


def changes_and_events(rs: DataFrame, cluster: str, group: str, kind: str, namespace: str, name: str, uid: str, start: datetime, end: datetime) -> DataFrame:
    """One timeline of an object's changes and the Events about it."""
    changes = final(_object(rs, cluster, kind, namespace, name, group).where(between(rs, start, end))).select("ts", F.lit("change").alias("source"), F.col("event_type").alias("what"), F.col("diff").alias("detail"))
    told = _events(rs, cluster, namespace, start, end).where(subject("uid") == uid).select("ts", F.lit("event").alias("source"), json_str("data", "reason").alias("what"), json_str("data", "message").alias("detail"))
    return changes.unionByName(told).orderBy("ts", "source", "what", "detail")


def noisy_reasons(rs: DataFrame, cluster: str, start: datetime, end: datetime, limit: int = 25) -> DataFrame:
    rows = final(rs.where((F.col("cluster_id") == cluster) & (F.col("kind") == "Event") & between(rs, start, end))).where(json_str("data", "type") == "Warning")
    parsed = rows.select(json_str("data", "reason").alias("reason"), first_filled(json_str("data", "involvedObject", "kind"), json_str("data", "regarding", "kind")).alias("subject_kind"), "namespace", "name")
    return parsed.groupBy("reason", "subject_kind").agg(F.count("*").alias("rows"), F.count_distinct("namespace", "name").alias("distinct_events")).orderBy(F.desc("rows"), "reason", "subject_kind").limit(limit)


_SCOPE = ["api_group", "kind", "namespace"]


def scope_states(ws: DataFrame, cluster: str) -> DataFrame:
    return ws.where(F.col("cluster_id") == cluster).groupBy(*_SCOPE).agg(F.max_by("action", F.struct("ts", "action")).alias("action")).orderBy(*_SCOPE)


def open_scopes(ws: DataFrame, cluster: str) -> DataFrame:
    return scope_states(ws, cluster).where("action = 'Started'").select(*_SCOPE)


def scope_was_active(ws: DataFrame, cluster: str, group: str, kind: str, namespace: str, as_of: datetime) -> DataFrame:
    """Whether the scope's last action strictly before ``as_of`` was Started; the namespace is exact, '' is the cluster-wide scope."""
    rows = ws.where((F.col("cluster_id") == cluster) & (F.col("api_group") == group) & (F.col("kind") == kind) & (F.col("namespace") == namespace) & (F.col("ts") < literal_like(ws, "ts", as_of)))
    return rows.agg((F.coalesce(F.max_by("action", F.struct("ts", "action")), F.lit("")) == "Started").alias("active"))


def last_known_states(rs: DataFrame, cluster: str, group: str, kind: str, namespace: str = "") -> DataFrame:
    """The last state of each incarnation that isn't deleted; '' means any namespace."""
    rows = rs.where((F.col("cluster_id") == cluster) & (F.col("api_group") == group) & (F.col("kind") == kind))
    if namespace:
        rows = rows.where(F.col("namespace") == namespace)
    order = latest(rs)
    last = rows.groupBy("namespace", "name", "uid").agg(F.max_by(F.struct("sha256", "api_version", "event_type"), order).alias("s"), F.max("ts").alias("ts"))
    return last.where("s.event_type <> 'Deleted'").select("namespace", "name", "uid", "s.sha256", "s.api_version", "ts")


def duplicate_deletes(rs: DataFrame, cluster: str) -> DataFrame:
    rows = final(rs.where(F.col("cluster_id") == cluster)).where("event_type = 'Deleted'")
    return rows.groupBy("uid").agg(F.min("name").alias("name"), F.count("*").alias("c")).where("c > 1")


def resource_rows(rs: DataFrame, cluster: str, group: str, kind: str, namespace: str, name: str = "", uid: str = "", event_types: Sequence[str] = ()) -> DataFrame:
    """History of a scope, narrowed by what is given."""
    rows = final(rs.where((F.col("cluster_id") == cluster) & (F.col("api_group") == group) & (F.col("kind") == kind) & (F.col("namespace") == namespace)))
    for column, value in (("name", name), ("uid", uid)):
        if value:
            rows = rows.where(F.col(column) == value)
    if event_types:
        rows = rows.where(F.col("event_type").isin(*event_types))
    return rows.orderBy("ts", *_TIES)


def scope_rows(ws: DataFrame, cluster: str, group: str, kind: str, namespace: str, action: str = "", rule_ref: str = "") -> DataFrame:
    rows = ws.where((F.col("cluster_id") == cluster) & (F.col("api_group") == group) & (F.col("kind") == kind) & (F.col("namespace") == namespace))
    for column, value in (("action", action), ("rule_ref", rule_ref)):
        if value:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy("ts")


def naive_tail(rs: DataFrame, cursor: datetime) -> DataFrame:
    """Rows after a cursor: loses recovered rows, which are dated before they arrive; see :func:`tail`."""
    return rs.where(F.col("ts") > literal_like(rs, "ts", cursor))


def tail(rs: DataFrame, cursor: datetime, lookback: timedelta) -> DataFrame:
    """Rows after a cursor, from ``lookback`` before it, one for each (object, incarnation, time, event type): merge them by that key."""
    return final(naive_tail(rs, cursor - lookback), mode="safe")


def expect_converged(rs: DataFrame, live: DataFrame) -> DataFrame:
    """For each live object (identity, uid, sha256): whether the newest row has its hash, and that hash occurs once."""
    keys = ["cluster_id", "api_group", "kind", "namespace", "name"]
    order = latest(rs)
    rows = final(rs).join(live.select(*keys, F.col("sha256").alias("live_sha")), keys)
    found = rows.groupBy(*keys, "live_sha").agg(F.max_by("sha256", order).alias("newest"), F.count_if(F.col("sha256") == F.col("live_sha")).alias("times"))
    return found.select(*keys, ((F.col("newest") == F.col("live_sha")) & (F.col("times") == 1)).alias("converged"))


def first_rows(rs: DataFrame, cluster: str, limit: int = 20) -> DataFrame:
    return rs.where(F.col("cluster_id") == cluster).orderBy("ts", *_TIES, *(["ingest_seq"] if "ingest_seq" in rs.columns else [])).limit(limit).select("event_type", "kind", "namespace", "name", "ts")


def last_patch(rs: DataFrame, cluster: str, kind: str, name: str) -> DataFrame:
    rows = rs.where((F.col("cluster_id") == cluster) & (F.col("kind") == kind) & (F.col("name") == name) & (F.col("event_type") == "Modified"))
    return rows.orderBy(*_newest_first(rows)).limit(1).select("ts", "name", "diff")


def diff_heads(rs: DataFrame, cluster: str, kind: str, limit: int = 3, length: int = 120) -> DataFrame:
    rows = rs.where((F.col("cluster_id") == cluster) & (F.col("kind") == kind) & (F.col("event_type") == "Modified"))
    return rows.orderBy(*_newest_first(rows)).limit(limit).select("ts", "name", "event_type", F.substring("diff", 1, length).alias("diff_head"))


def redaction_check(rs: DataFrame, cluster: str, kind: str, name: str, fields: Sequence[str] = ("feature_flags", "password")) -> DataFrame:
    rows = rs.where((F.col("cluster_id") == cluster) & (F.col("kind") == kind) & (F.col("name") == name) & (F.col("data") != ""))
    return rows.orderBy("ts", *_TIES).limit(1).select("name", *[json_str("data", "data", f).alias(f) for f in fields])


def scopes_log(ws: DataFrame, cluster: str) -> DataFrame:
    return ws.where(F.col("cluster_id") == cluster).orderBy("ts").select("ts", "action", "api_group", "kind", "namespace", "rule_ref")
