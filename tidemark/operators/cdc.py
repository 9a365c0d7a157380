"""Change capture: observations of objects become at most one row each.

:class:`Classifier` holds the decisions for one object and is the same in batch
and in streams; it sees the object's observations in order of (ts_ns, seq) and
carries a small state.  In batch, :func:`classify` deals observations out by
object, sorts each partition, and passes over it once, so the memory of a task
does not grow with the number of observations of an object.

Rows carry the observation's time, never the clock's: a task that runs again
emits the same rows.  A close-out (the deletion of an object whose name another
one has taken) comes before its successor: it is dated one nanosecond earlier,
unless the closed object has a row that late; then both share an instant, and
:func:`tidemark.sources.schema.latest` puts it first.

A ``scope_stop`` without a name stops the whole scope: all objects of its sink,
cluster, group and kind, in its namespace (or in all, if it names none).  In streams
observations carry ``scope_epoch`` instead, how often their scope has stopped (see
:func:`tidemark.operators.rules.in_epochs`): a state of an earlier epoch is
forgotten when its object is next seen, without a pass over all of a scope's
states, and observations of an earlier epoch than the state's are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.documents import Redaction, canonical_json, json_diff, normalize

#: The identity of an object within a sink.
KEY = ["sink", "cluster_id", "api_group", "kind", "namespace", "name"]
#: Before all observations.
BEFORE = -(1 << 62)
OUT = "seq long, ts_ns long, sink string, cluster_id string, event_type string, api_group string, api_version string, kind string, namespace string, name string, uid string, resource_version string, labels map<string,string>, actors array<string>, data string, diff string, sha256 string, error string"


@dataclass(frozen=True)
class State:
    """The last state that was written, at ``at`` (ns); ``json`` is None if only its hash is known (seeded from history), ``epoch`` is None if it holds in any."""

    uid: str
    sha256: str
    api_version: str = ""
    json: str | None = None
    run: int = 0
    at: int = BEFORE
    epoch: int | None = None


def ephemeral(group: str, kind: str) -> bool:
    """Events expire and are never compared with what they were."""
    return kind == "Event" and group in ("", "events.k8s.io")


def is_ephemeral(group: Column | str = "api_group", kind: Column | str = "kind") -> Column:
    group, kind = (F.col(c) if isinstance(c, str) else c for c in (group, kind))
    return (kind == "Event") & group.isin("", "events.k8s.io")


def checkpoint_due(every: int, run: int, diff_bytes: int, full_bytes: int) -> str | None:
    """Why a change is written with its full state, or None; ``run`` counts this change, ``every`` <= 0 turns both reasons off."""
    if every <= 0:
        return None
    return "count" if run >= every else "size" if diff_bytes > full_bytes else None


class Classifier:
    """Decides what an observation of one object is."""

    def __init__(self, policies: dict[str, list[str]] | None = None, checkpoint_every: int = 50) -> None:
        """``policies``: redaction paths by sink."""
        self.policies = {sink: Redaction(paths) for sink, paths in (policies or {}).items()}
        self.default, self.every = Redaction(), checkpoint_every

    def step(self, state: State | None, o: dict) -> tuple[State | None, list[dict]]:
        """The state after an observation, and the rows it gives.

        ``o``: op (upsert, delete, scope_stop), object_json, scope_warm, scope_epoch, and the key.
        """
        epoch = o.get("scope_epoch")
        if state is not None and epoch is not None and state.epoch is not None and epoch != state.epoch:
            if epoch < state.epoch:
                return state, []
            state = None
        if state is not None:
            # Whichever of the two knows the epoch: a seed learns it from what is seen first.
            epoch = state.epoch if epoch is None else epoch
            state = state if epoch == state.epoch else replace(state, epoch=epoch)
        if o["op"] == "scope_stop":
            return None, []
        events = ephemeral(o["api_group"], o["kind"])
        if o["op"] == "delete":
            return None, [] if state is None or events else [self._deleted(o, state)]
        if o["op"] != "upsert":
            return state, [self._failed(o, f"unknown op {o['op']!r}")]
        try:
            doc = json.loads(o["object_json"])
            n = normalize(doc, self.policies.get(o["sink"], self.default))
        except (ValueError, TypeError, AttributeError) as e:
            return state, [self._failed(o, f"not an object: {e}")]

        rows, event, data, diff, run = [], "Added", n["json"], "", 0
        if state is None:
            if not events and not o.get("scope_warm", True):
                event = "Snapshot"
        elif state.uid and state.uid != n["uid"]:
            if not events:
                rows.append(self._deleted(o | {"ts_ns": o["ts_ns"] - (state.at < o["ts_ns"] - 1)}, state))
        elif state.sha256 == n["sha256"]:
            return state, []
        else:
            event = "Modified"
            patch = None if events or state.json is None else self._patch(state.json, n["json"])
            if patch is not None:
                diff, run = patch, state.run + 1
                if checkpoint_due(self.every, run, len(patch.encode()), len(n["json"].encode())):
                    event, run = "Checkpoint", 0
                else:
                    data = ""
        rows.append(self._row(o, event, n["api_version"], n["uid"]) | {k: n[k] for k in ("resource_version", "labels", "actors", "sha256")} | {"data": data, "diff": diff})
        return State(n["uid"], n["sha256"], n["api_version"], None if events else n["json"], run, o["ts_ns"], epoch), rows

    @staticmethod
    def _patch(old: str, new: str) -> str | None:
        try:
            return canonical_json(json_diff(json.loads(old), json.loads(new)))
        except (ValueError, RecursionError):
            return None

    @staticmethod
    def _row(o: dict, event: str, version: str, uid: str) -> dict:
        key = {k: o[k] for k in (*KEY, "seq", "ts_ns")}
        return key | {"event_type": event, "api_version": version, "uid": uid, "resource_version": "", "labels": {}, "actors": [], "data": "", "diff": "", "sha256": "", "error": None}

    def _deleted(self, o: dict, state: State) -> dict:
        return self._row(o, "Deleted", state.api_version, state.uid)

    def _failed(self, o: dict, error: str) -> dict:
        return self._row(o, "", "", "") | {"data": o["object_json"] or "", "error": error}


def rows_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


ARROW = pa.schema(
    [("seq", pa.int64()), ("ts_ns", pa.int64()), *[(c, pa.string()) for c in ("sink", "cluster_id", "event_type", "api_group", "api_version", "kind", "namespace", "name", "uid", "resource_version")]]
    + [("labels", pa.map_(pa.string(), pa.string())), ("actors", pa.list_(pa.string())), *[(c, pa.string()) for c in ("data", "diff", "sha256", "error")]]
)


def observed(df: DataFrame) -> DataFrame:
    """Observations with defaults: one sink, one cluster, warm scopes, ts_ns from ts."""
    have = set(df.columns)
    defaults = {"sink": F.lit("default"), "cluster_id": F.lit(""), "scope_warm": F.lit(True), "scope_epoch": F.lit(None).cast("long"), "ts_ns": F.unix_micros(F.col("ts").cast("timestamp")) * 1000 if "ts" in have else F.lit(0).cast("long")}
    df = df.withColumns({k: v for k, v in defaults.items() if k not in have})
    text = {c: F.coalesce(c, F.lit("")) for c in KEY}
    return df.withColumns(text | {"scope_warm": F.coalesce("scope_warm", F.lit(True))}).select(*KEY, "seq", "ts_ns", "op", "object_json", "scope_warm", "scope_epoch")


def each_object_stopped(rows: DataFrame) -> DataFrame:
    """Stops of whole scopes as one for each object of the scope that is observed; scopes are few beside objects."""
    whole = (F.col("op") == "scope_stop") & (F.col("name") == "")
    stops = rows.where(whole).select(*[F.col(c).alias(f"s_{c}") for c in ("sink", "cluster_id", "api_group", "kind", "namespace")], "seq", "ts_ns", "op", "object_json", "scope_warm", "scope_epoch")
    named = rows.where("name <> ''").select(*KEY).distinct()
    same = [F.col(c) == F.col(f"s_{c}") for c in ("sink", "cluster_id", "api_group", "kind")]
    # By equality twice, so that no pair of rows is tried that differs in the scope's columns.
    own = named.join(stops.where("s_namespace <> ''"), [*same, F.col("namespace") == F.col("s_namespace")])
    all_of = named.join(stops.where("s_namespace = ''"), same)
    return rows.where(~whole).unionByName(own.unionByName(all_of).select(*rows.columns))


def classify(observations: DataFrame, classifier: Classifier | None = None, seed: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Rows of all observations, in batch; ``seed`` has last known states (KEY, uid, sha256, api_version), which come before everything."""
    classifier = classifier or Classifier()
    rows = each_object_stopped(observed(observations)).withColumns({"uid": F.lit(None).cast("string"), "sha256": F.lit(None).cast("string"), "api_version": F.lit(None).cast("string")})
    if seed is not None:
        start = {"seq": F.lit(-1).cast("long"), "ts_ns": F.lit(BEFORE).cast("long"), "op": F.lit("seed"), "object_json": F.lit(None).cast("string"), "scope_warm": F.lit(True), "scope_epoch": F.lit(None).cast("long")}
        rows = rows.unionByName(seed.withColumns(start).select(*rows.columns))
    dealt = rows.repartition(partitions, *KEY) if partitions else rows.repartition(*KEY)
    return dealt.sortWithinPartitions(*KEY, "ts_ns", "seq").mapInArrow(_pass(classifier), OUT)


def _pass(classifier: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out: list[dict] = []
            for o in batch.to_pylist():
                now = tuple(o[k] for k in KEY)
                if now != key:
                    key, state = now, None
                if o["op"] == "seed":
                    state = State(o["uid"], o["sha256"], o["api_version"] or "")
                    continue
                state, rows = classifier.step(state, o)
                out += rows
            if out:
                yield rows_of(out, ARROW)

    return run


def as_states(rows: DataFrame) -> DataFrame:
    """Classified rows as rows of resource_states, without those that failed."""
    good = rows.where("error is null")
    return good.withColumn("ts", F.timestamp_micros(F.expr("(ts_ns - pmod(ts_ns, 1000)) div 1000"))).withColumnRenamed("seq", "ingest_seq").drop("error")


def quarantined(rows: DataFrame) -> DataFrame:
    """What could not be read, with the reason."""
    return rows.where("error is not null").select(*KEY, "seq", "ts_ns", F.col("data").alias("object_json"), "error")


def unchanged_dropped(history: DataFrame, order: list[str]) -> DataFrame:
    """Rows of an incarnation whose hash differs from the row before: the dedup decision alone, without Python."""
    from pyspark.sql import Window

    of = Window.partitionBy("cluster_id", "api_group", "kind", "namespace", "name", "uid").orderBy(*order)
    return history.withColumn("__p", F.lag("sha256").over(of)).where("__p is null or __p <> sha256").drop("__p")


def state_row(state: State | None) -> tuple | None:
    return tuple(asdict(state).values()) if state else None
