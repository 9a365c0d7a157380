"""The dashboard panels and their variable pickers.

``Panel`` holds the variables that all panels of a dashboard share.  Intervals
are tumbling and aligned to the epoch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import between, bucket, change_text, json_str, managers, occurrences, subject, union_of
from tidemark.operators.final import final
from tidemark.plans import library
from tidemark.sources.schema import CHANGES, EVENT_TYPES, latest

_OBJECT = ["namespace", "kind", "name"]


@dataclass(frozen=True)
class Panel:
    cluster: str
    start: datetime
    end: datetime
    seconds: int = 3600
    namespaces: Sequence[str] | None = None
    kinds: Sequence[str] | None = None
    event_types: Sequence[str] = EVENT_TYPES
    manager: str = "argocd-controller"
    threshold: int = 10

    def rows(self, rs: DataFrame, *, namespaces: bool = False, kinds: bool = False, events: Sequence[str] | None = None) -> DataFrame:
        """Collapsed rows of the window, by the variables that the panel uses; event types are no key and so are filtered after."""
        rows = rs.where((F.col("cluster_id") == self.cluster) & between(rs, self.start, self.end))
        if namespaces and self.namespaces is not None:
            rows = rows.where(F.col("namespace").isin(*self.namespaces))
        if kinds and self.kinds is not None:
            rows = rows.where(F.col("kind").isin(*self.kinds))
        rows = final(rows)
        return rows if events is None else rows.where(F.col("event_type").isin(*events))

    def changes(self, rs: DataFrame, kinds: bool = False) -> DataFrame:
        return self.rows(rs, namespaces=True, kinds=kinds, events=CHANGES)

    def object_rows(self, rs: DataFrame, kind: str, namespace: str, name: str) -> DataFrame:
        return self.rows(rs.where((F.col("kind") == kind) & (F.col("namespace") == namespace) & (F.col("name") == name)))


def _scoped(namespace: str = "namespace") -> Column:
    return F.when(F.col(namespace) == "", "(cluster-scoped)").otherwise(F.col(namespace))


# Drift by actor


def gitops_share_pct(rs: DataFrame, p: Panel) -> DataFrame:
    touched = F.count_if(F.array_contains("actors", p.manager))
    return p.changes(rs).agg(F.round(100 * touched / F.greatest(F.count("*"), F.lit(1)), 1).alias("gitops_share_pct"))


def objects_with_drift(rs: DataFrame, p: Panel) -> DataFrame:
    rows = p.changes(rs).where(~F.array_contains("actors", p.manager))
    return rows.agg(F.count_distinct("api_group", "kind", "namespace", "name").alias("objects_with_drift"))


def top_actors_excl_gitops(rs: DataFrame, p: Panel, limit: int = 20) -> DataFrame:
    actors = p.changes(rs).select(F.explode("actors").alias("actor")).where(F.col("actor") != p.manager)
    return actors.groupBy("actor").agg(F.count("*").alias("modifications")).orderBy(F.desc("modifications"), "actor").limit(limit)


def modifications_by_actor_over_time(rs: DataFrame, p: Panel) -> DataFrame:
    actors = p.changes(rs).select(bucket(p.seconds).alias("time"), F.explode("actors").alias("actor"))
    return actors.groupBy("time", "actor").agg(F.count("*").alias("modifications")).orderBy("time", "actor")


def objects_changed_without_gitops(rs: DataFrame, p: Panel) -> DataFrame:
    return library.gitops_drift(rs, p.cluster, p.start, p.end, p.manager, 100, p.namespaces)


# Flap report


def _flapping(rs: DataFrame, p: Panel) -> DataFrame:
    return p.changes(rs, kinds=True).groupBy(*_OBJECT).agg(F.count("*").alias("modifications")).where(F.col("modifications") >= p.threshold)


def objects_over_threshold(rs: DataFrame, p: Panel) -> DataFrame:
    return _flapping(rs, p).agg(F.count("*").alias("objects_over_threshold"))


def modified_rows_in_window(rs: DataFrame, p: Panel) -> DataFrame:
    return p.changes(rs, kinds=True).agg(F.count("*").alias("modified_rows"))


def flapping_over_time(rs: DataFrame, p: Panel) -> DataFrame:
    rows = p.changes(rs, kinds=True).join(_flapping(rs, p).select(*_OBJECT), _OBJECT, "left_semi")
    rows = rows.select(bucket(p.seconds).alias("time"), F.concat_ws("/", *_OBJECT).alias("object"))
    return rows.groupBy("time", "object").agg(F.count("*").alias("modifications")).orderBy("time", "object")


def threshold_series(rs: DataFrame, p: Panel) -> DataFrame:
    rows = rs.where((F.col("cluster_id") == p.cluster) & between(rs, p.start, p.end))
    return rows.select(bucket(p.seconds).alias("time")).distinct().select("time", F.lit(p.threshold).cast("int").alias("threshold")).orderBy("time")


def objects_by_change_count(rs: DataFrame, p: Panel, limit: int = 100) -> DataFrame:
    found = p.changes(rs, kinds=True).groupBy(*_OBJECT).agg(F.count("*").alias("modifications"), F.max("ts").alias("last_change"), F.array_join(union_of(), ", ").alias("field_managers"))
    return found.withColumn("threshold", F.lit(p.threshold).cast("int")).orderBy(F.desc("modifications"), *_OBJECT).limit(limit)


# Namespace activity


def change_volume_by_namespace(rs: DataFrame, p: Panel) -> DataFrame:
    rows = p.rows(rs, kinds=True, events=p.event_types).select(bucket(p.seconds).alias("time"), _scoped().alias("ns"))
    return rows.groupBy("time", "ns").agg(F.count("*").alias("changes")).orderBy("time", "ns")


def change_volume_by_event_type(rs: DataFrame, p: Panel) -> DataFrame:
    rows = p.rows(rs, kinds=True).select(bucket(p.seconds).alias("time"), "event_type")
    return rows.groupBy("time", "event_type").agg(F.count("*").alias("changes")).orderBy("time", "event_type")


def kinds_by_volume(rs: DataFrame, p: Panel, limit: int = 50) -> DataFrame:
    gvk = F.concat_ws("/", F.when(F.col("api_group") == "", "core").otherwise(F.col("api_group")), "kind")
    rows = p.rows(rs, events=p.event_types).groupBy(gvk.alias("gvk"))
    return rows.agg(F.count("*").alias("changes"), F.count_distinct("namespace", "name").alias("objects"), F.max("ts").alias("last_change")).orderBy(F.desc("changes"), "gvk").limit(limit)


def busiest_namespaces(rs: DataFrame, p: Panel, limit: int = 50) -> DataFrame:
    of = {"added": ["Added"], "modified": CHANGES, "deleted": ["Deleted"], "snapshot": ["Snapshot"]}
    counts = [F.count_if(F.col("event_type").isin(*t)).alias(name) for name, t in of.items()]
    rows = p.rows(rs, kinds=True).groupBy(_scoped().alias("ns"))
    return rows.agg(*counts, F.count("*").alias("total"), F.count_distinct("api_group", "kind", "name").alias("objects")).orderBy(F.desc("total"), "ns").limit(limit)


# Object timeline


def object_changes_over_time(rs: DataFrame, p: Panel, kind: str, namespace: str, name: str) -> DataFrame:
    rows = p.object_rows(rs, kind, namespace, name).select(bucket(p.seconds).alias("time"), "event_type")
    return rows.groupBy("time", "event_type").agg(F.count("*").alias("changes")).orderBy("time", "event_type")


def object_field_managers(rs: DataFrame, p: Panel, kind: str, namespace: str, name: str, limit: int = 20) -> DataFrame:
    rows = p.object_rows(rs, kind, namespace, name).select(F.explode("actors").alias("actor"))
    return rows.groupBy("actor").agg(F.count("*").alias("rows_touched")).orderBy(F.desc("rows_touched"), "actor").limit(limit)


def object_latest_state(rs: DataFrame, p: Panel, kind: str, namespace: str, name: str) -> DataFrame:
    rows = rs.where((F.col("cluster_id") == p.cluster) & (F.col("kind") == kind) & (F.col("namespace") == namespace) & (F.col("name") == name))
    order = latest(rs, incarnations=True)
    last = {"last_event": "event_type", "current_uid": "uid", "resource_version": "resource_version", "sha256": "sha256"}
    found = [F.coalesce(F.max_by(c, order), F.lit("")).alias(a) for a, c in last.items()]
    return rows.agg(*found, F.max("ts").alias("last_seen"), F.count("*").alias("rows_recorded"), F.count_distinct("uid").alias("incarnations"))


def object_rows_and_diffs(rs: DataFrame, p: Panel, kind: str, namespace: str, name: str, limit: int = 500) -> DataFrame:
    rows = p.object_rows(rs, kind, namespace, name).orderBy(F.desc("ts"), "api_group").limit(limit)
    return rows.select("ts", "event_type", "uid", "resource_version", managers().alias("field_managers"), change_text().alias("change"), "sha256")


def object_events(rs: DataFrame, p: Panel, kind: str, namespace: str, name: str, limit: int = 200) -> DataFrame:
    rows = p.rows(rs.where((F.col("kind") == "Event") & (F.col("namespace") == namespace))).where((subject("name") == name) & (subject("kind") == kind))
    text = [json_str("data", c).alias(a) for c, a in (("type", "severity"), ("reason", "reason"), ("message", "message"))]
    return rows.orderBy(F.desc("ts"), "api_group", "name").limit(limit).select("ts", *text, occurrences().alias("occurrences"))


# Pickers


def picker(rs: DataFrame, column: str, **equal: str) -> DataFrame:
    """Sorted distinct values of a column, among rows with the given values of others."""
    for name, value in equal.items():
        rs = rs.where(F.col(name) == value)
    return rs.select(column).distinct().orderBy(column)
