"""Recovery after a restart: what history says exists, against what is there now."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cdc import is_ephemeral
from tidemark.sources.schema import IDENTITY, SCOPE, latest


class Recovered(NamedTuple):
    """States to start from, deletions and scope stops to write."""

    seed: DataFrame
    deleted: DataFrame
    stopped: DataFrame


def known(history: DataFrame) -> DataFrame:
    """The last row of each incarnation that isn't deleted, over uncollapsed history: no copy can change a maximum."""
    order = latest(history)
    last = history.groupBy(*IDENTITY, "uid").agg(F.max_by(F.struct("event_type", "sha256", "api_version"), order).alias("s"), F.max(order).alias("at"), F.max("ts").alias("ts"))
    return last.where("s.event_type <> 'Deleted'").select(*IDENTITY, "uid", "s.sha256", "s.api_version", "ts", "at")


def split_incarnations(states: DataFrame) -> DataFrame:
    """``current``: whether an incarnation is the newest of its object, by (time, uid); the others were never closed."""
    newest = Window.partitionBy(*IDENTITY).orderBy(F.desc("at"), F.desc("uid"))
    return states.withColumn("current", F.row_number().over(newest) == 1)


def unclosed_priors(history: DataFrame) -> DataFrame:
    return split_incarnations(known(history)).where("not current").select(*IDENTITY, "uid", "sha256", "api_version", "ts")


def active_before(scopes: DataFrame, epoch_start: datetime) -> DataFrame:
    """Scopes whose last action strictly before the instant was Started."""
    before = scopes.where(F.col("ts") < F.lit(f"{epoch_start:%Y-%m-%d %H:%M:%S.%f}").cast(scopes.schema["ts"].dataType))
    return before.groupBy(*SCOPE).agg(F.max_by("action", F.struct("ts", "action")).alias("a")).where("a = 'Started'").select(*SCOPE)


def in_scopes(states: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows of objects in one of the scopes; a scope without namespace is cluster-wide."""
    named = states.join(scopes, SCOPE, "left_semi")
    wide = scopes.where("namespace = ''").select("cluster_id", "api_group", "kind")
    rest = states.where("namespace <> ''").join(scopes, SCOPE, "left_anti").join(wide, ["cluster_id", "api_group", "kind"], "left_semi")
    return named.unionByName(rest)


def zombies(history: DataFrame, live: DataFrame) -> DataFrame:
    """Current incarnations that are not live: absent, or replaced by another uid."""
    return _zombies(split_incarnations(known(history)), live)


def _zombies(states: DataFrame, live: DataFrame) -> DataFrame:
    current = states.where("current").where(~is_ephemeral())
    there = live.select(*IDENTITY, F.col("uid").alias("live_uid")).distinct()
    same = current.join(live.select(*IDENTITY, "uid").distinct(), [*IDENTITY, "uid"], "left_anti")
    names = there.select(*IDENTITY).distinct().withColumn("replaced", F.lit(True))
    return same.join(names, IDENTITY, "left").select(*IDENTITY, "uid", "sha256", "api_version", "ts", F.coalesce("replaced", F.lit(False)).alias("replaced"))


class Refused(NamedTuple):
    """Deletions to write, and claims that must wait for the successor's first row."""

    deleted: DataFrame
    pending: DataFrame


def close_refused(refused: DataFrame, history: DataFrame) -> Refused:
    """Incarnations (identity, uid) known to be replaced, whose state another process had claimed, against history read again.

    One that is closed by now needs nothing; one that history has a successor of is
    closed at its own last row; one that is still the newest of its object has no row
    to be dated by and stays pending, for another call.
    """
    claims = refused.select(*IDENTITY, "uid").distinct()
    # All open incarnations of the objects: which is the newest depends on the others.
    mine = split_incarnations(known(history.join(claims.select(*IDENTITY).distinct(), IDENTITY, "left_semi")))
    open_ = mine.join(claims, [*IDENTITY, "uid"], "left_semi").where(~is_ephemeral())
    return Refused(_deletion(open_.where("not current"), F.col("ts"), F.col("api_version")), open_.where("current").select(*IDENTITY, "uid"))


def orphan_scopes(scopes: DataFrame, desired: DataFrame) -> DataFrame:
    """Open scopes that nothing wants, by exact scope."""
    last = scopes.groupBy(*SCOPE).agg(F.max_by(F.struct("action", "api_version"), F.struct("ts", "action")).alias("a")).where("a.action = 'Started'")
    return last.join(desired.select(*SCOPE).distinct(), SCOPE, "left_anti").select(*SCOPE, "a.api_version")


def _deletion(rows: DataFrame, ts, version) -> DataFrame:
    empty = [F.lit("").alias(c) for c in ("resource_version", "data", "diff", "sha256")]
    return rows.select(ts.alias("ts"), F.lit("Deleted").alias("event_type"), *IDENTITY, version.alias("api_version"), "uid", F.array().cast("array<string>").alias("actors"), *empty)


def recover(history: DataFrame, scopes: DataFrame, live: DataFrame, desired: DataFrame, epoch_start: datetime, now: datetime) -> Recovered:
    """``live``: the full inventory (identity, uid) of the scopes that run; ``desired``: the scopes that rules want.

    Deletions are written only for scopes that were open in an earlier epoch.
    Absent objects are dated now and carry no version; replaced ones and unclosed
    incarnations are dated by their own last row and carry its version.  Events are
    never deleted.
    """
    kind = history.schema["ts"].dataType
    moment = F.lit(f"{now:%Y-%m-%d %H:%M:%S.%f}").cast(kind)
    states = split_incarnations(known(history))
    seed = states.where("current").select(*IDENTITY, "uid", "sha256", "api_version", "ts")
    gone = _zombies(states, live)
    absent = _deletion(gone.where("not replaced"), moment, F.lit(""))
    priors = states.where("not current").where(~is_ephemeral()).join(live.select(*IDENTITY, "uid"), [*IDENTITY, "uid"], "left_anti")
    closed = _deletion(gone.where("replaced").drop("replaced").unionByName(priors.drop("at", "current")), F.col("ts"), F.col("api_version"))
    deleted = in_scopes(absent.unionByName(closed), active_before(scopes, epoch_start))
    stopped = orphan_scopes(scopes, desired).select(moment.alias("ts"), *SCOPE, "api_version", F.lit("Stopped").alias("action"), F.lit("").alias("rule_ref"))
    return Recovered(seed, deleted, stopped)
