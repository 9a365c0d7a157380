"""Schemas of the two tables and of observations, and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Objects are the same over versions of their API.
IDENTITY = ["cluster_id", "api_group", "kind", "namespace", "name"]
INCARNATION = [*IDENTITY, "uid"]
SCOPE = ["cluster_id", "api_group", "kind", "namespace"]
EVENT_TYPES = ("Added", "Modified", "Deleted", "Snapshot", "Checkpoint")
CHANGES = ("Modified", "Checkpoint")

_STATES = "ts TIMESTAMP, cluster_id STRING, event_type STRING, api_group STRING, api_version STRING, kind STRING, namespace STRING, name STRING, uid STRING, resource_version STRING, labels MAP<STRING,STRING>, actors ARRAY<STRING>, data STRING, diff STRING, sha256 STRING"
_SCOPES = "ts TIMESTAMP, cluster_id STRING, api_group STRING, api_version STRING, kind STRING, namespace STRING, action STRING, rule_ref STRING"
_OBSERVED = "seq BIGINT, ts TIMESTAMP, ts_ns BIGINT, sink STRING, op STRING, cluster_id STRING, api_group STRING, api_version STRING, kind STRING, namespace STRING, name STRING, object_json STRING, scope_warm BOOLEAN, scope_epoch BIGINT"

#: Kept beside the frozen columns: full precision of ts, and the order of arrival.
HIDDEN = "ts_ns BIGINT, ingest_seq BIGINT"

_TEXT = T.StringType()
_TYPES = {"TIMESTAMP": T.TimestampType(), "STRING": _TEXT, "BIGINT": T.LongType(), "BOOLEAN": T.BooleanType(), "MAP<STRING,STRING>": T.MapType(_TEXT, _TEXT), "ARRAY<STRING>": T.ArrayType(_TEXT)}


def _struct(ddl: str) -> T.StructType:
    """Like StructType.fromDDL, which needs a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


RESOURCE_STATES = _struct(_STATES)
WATCH_SCOPES = _struct(_SCOPES)
OBSERVATIONS = _struct(_OBSERVED)
STORED_STATES = _struct(f"{_STATES}, {HIDDEN}")


def validate_schema(df: DataFrame | None, required: T.StructType, table: str = "table") -> list[str]:
    """What is missing or differs from ``required``; extra columns don't matter."""
    if df is None:
        return [f"{table}: missing"]
    have = {f.name: f.dataType for f in df.schema}
    found = []
    for f in required:
        if f.name not in have:
            found.append(f"{table}.{f.name}: missing, want {f.dataType.simpleString()}")
        elif _plain(have[f.name]) != _plain(f.dataType):
            found.append(f"{table}.{f.name}: is {have[f.name].simpleString()}, want {f.dataType.simpleString()}")
    return found


def _plain(t: T.DataType) -> str:
    """The type without nullability; both kinds of timestamp count alike."""
    return t.simpleString().replace("timestamp_ntz", "timestamp")


def encoded(df: DataFrame) -> DataFrame:
    """Rows with the tables' defaults in place of nulls: '', [] and {}."""
    empty = {"string": F.lit(""), "array<string>": F.array().cast("array<string>"), "map<string,string>": F.create_map().cast("map<string,string>")}
    return df.withColumns({f.name: F.coalesce(F.col(f.name), empty[f.dataType.simpleString()]) for f in df.schema if f.dataType.simpleString() in empty})


def order_of(df: DataFrame, incarnations: bool = False) -> list[Column]:
    """Order of rows: by time; of one incarnation, then a deletion last, then by arrival; over ``incarnations``, then by arrival (rows without one last) and a close-out before its successor."""
    parts = [F.col("ts_ns" if "ts_ns" in df.columns else "ts")]
    gone = [F.col("event_type") == "Deleted"] if "event_type" in df.columns else []
    come = [F.coalesce("ingest_seq", F.lit((1 << 63) - 1))] if "ingest_seq" in df.columns else []
    return parts + (come + [~c for c in gone] if incarnations else gone + come)


def latest(df: DataFrame, incarnations: bool = False) -> Column:
    """The order as one value."""
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(order_of(df, incarnations))])
