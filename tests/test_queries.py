"""Every registered query against its SQL in DuckDB, and expected rows of a small history."""

import json
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark import registry
from tidemark.operators.final import final
from tidemark.operators.recover import unclosed_priors
from tidemark.plans import dashboards as d
from tidemark.plans import library as q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return str(value) if isinstance(value, datetime) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def agree(spark, duck, query, sql):
    df = query(spark, DATA)
    cur = duck.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda row: str(row)
    got = sorted((plain(tuple(r[n] for n in sorted(names))) for r in df.collect()), key=key)
    want = sorted((plain(tuple(dict(zip(names, r, strict=True))[n] for n in sorted(names))) for r in cur.fetchall()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    agree(spark, duck, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["namespace", "kind", "name", "modifications", "field_managers", "first_change", "last_change"]
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


T0 = datetime(2025, 3, 10, 8)
FLEET, ANA, BOT = "fleet", "ana", "scaler-bot"
FULL, PATCH = '{"spec":{"slots":2}}', '[{"op":"add","path":"/spec/slots","value":4}]'


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def note(reason, times, kind="Warning", about="involvedObject", counter="count", of=("CronJob", "jobs", "report", "r1")):
    """An Event's document."""
    return json.dumps({"type": kind, "reason": reason, "message": f"{reason}!", counter: times, about: dict(zip(("kind", "namespace", "name", "uid"), of, strict=True))}, separators=(",", ":"))


# One report job that people and a bot change in turn, a service that is replaced, an agent elsewhere.
REPORT, FRONT, AGENT, TICK = ("batch", "CronJob", "jobs", "report"), ("", "Service", "jobs", "front"), ("apps", "DaemonSet", "other", "agent"), ("", "Event", "jobs", "report.tick")
HISTORY = [
    (0, "Added", *REPORT, "r1", [FLEET], FULL, ""),
    (5, "Snapshot", *FRONT, "f1", [FLEET], FULL, ""),
    (20, "Added", *TICK, "t1", ["cron"], note("Missed", 2), ""),
    (40, "Modified", *REPORT, "r1", [ANA], "", PATCH),
    (41, "Modified", *REPORT, "r1", [ANA, BOT], "", PATCH),
    (70, "Modified", *FRONT, "f1", [FLEET], "", PATCH),
    (80, "Modified", *TICK, "t1", ["cron"], note("Missed", 9), ""),
    (95, "Deleted", *FRONT, "f1", [], "", ""),
    (96, "Added", *FRONT, "f2", [ANA], FULL, ""),
    (130, "Modified", *REPORT, "r1", [FLEET], "", PATCH),
    (200, "Checkpoint", *REPORT, "r1", [BOT], FULL, PATCH),
    (210, "Added", "events.k8s.io", "Event", "jobs", "report.run", "t2", ["runner"], note("Ran", 1, "Normal", "regarding", "deprecatedCount"), ""),
    (220, "Added", *AGENT, "a1", [FLEET], FULL, ""),
    (260, "Modified", *AGENT, "a1", [BOT], "", PATCH),
    (300, "Deleted", *AGENT, "a1", [], "", ""),
]
START, END = at(-60), at(3600)
JOB = ("lab", "CronJob", "jobs", "report")


@pytest.fixture(scope="module")
def lab(spark):
    """The history, with two rows delivered twice."""
    rows = [(at(r[0]), "lab", *r[1:10], f"hash-{r[0]}" if r[1] != "Deleted" else "", str(500 + r[0]), k, "v1") for k, r in enumerate([*HISTORY, HISTORY[3], HISTORY[14]])]
    return spark.createDataFrame(rows, "ts timestamp, cluster_id string, event_type string, api_group string, kind string, namespace string, name string, uid string, actors array<string>, data string, diff string, sha256 string, resource_version string, ingest_seq long, api_version string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_lab_library(lab):
    assert final(lab).count() == 15
    assert len(rows(q.incident_window(lab, "lab", "jobs", START, END))) == 12
    assert [r[:4] for r in rows(q.gitops_drift(lab, "lab", START, END, FLEET))] == [("jobs", "CronJob", "report", 3), ("jobs", "Event", "report.tick", 1), ("other", "DaemonSet", "agent", 1)]
    assert rows(q.top_flappers(lab, "lab", START, END, 2)) == [("jobs", "CronJob", "report", 4, f"{ANA}, {FLEET}, {BOT}", at(40), at(200))]
    assert rows(q.object_digest(lab, "lab", *FRONT)) == [("Added", "hash-96", "596", at(96), 2)]
    assert rows(q.object_digest(lab, "lab", *AGENT)) == [("Deleted", "", "800", at(300), 1)]
    assert rows(q.object_digest(lab, "lab", "batch", "CronJob", "jobs", "none")) == [("", "", "", None, 0)]
    assert rows(q.deleted_last_state(lab, "lab", START, END)) == [("other", "DaemonSet", "agent", "a1", at(300), FULL, at(220)), ("jobs", "Service", "front", "f1", at(95), FULL, at(5))]
    assert rows(q.events_by_uid(lab, "lab", "jobs", at(100), "r1")) == [(at(20), "Warning", "Missed", "Missed!", 2, "report.tick"), (at(80), "Warning", "Missed", "Missed!", 9, "report.tick"), (at(210), "Normal", "Ran", "Ran!", 1, "report.run")]
    assert [r[1] for r in rows(q.events_by_name(lab, *JOB, at(50), END))] == ["Missed", "Ran"]
    assert [r[1] for r in rows(q.changes_and_events(lab, "lab", "batch", "CronJob", "jobs", "report", "r1", START, END))] == ["change", "event", "change", "change", "event", "change", "change", "event"]
    assert rows(q.noisy_reasons(lab, "lab", START, END)) == [("Missed", "CronJob", 2, 1)]
    assert rows(q.latest_full_state_at(lab, *JOB, at(150))) == [(at(0), "Added", FULL)]


def test_lab_dashboards(lab):
    p = d.Panel("lab", START, END, 60, ["jobs", "other"], ["CronJob", "Service", "DaemonSet"], manager=FLEET, threshold=2)
    assert rows(d.gitops_share_pct(lab, p)) == [(28.6,)]  # two of seven changes, of events too
    assert rows(d.objects_with_drift(lab, p)) == [(3,)]
    assert rows(d.objects_over_threshold(lab, p)) == [(1,)]
    assert rows(d.modified_rows_in_window(lab, p)) == [(6,)]
    assert rows(d.object_latest_state(lab, p, *JOB[1:]))[0][0] == "Checkpoint"
    assert rows(d.object_latest_state(lab, p, *FRONT[1:]))[0][:3] == ("Added", "f2", "596")
    assert [r[1] for r in rows(d.object_rows_and_diffs(lab, p, *JOB[1:]))] == ["Checkpoint", "Modified", "Modified", "Modified", "Added"]
    assert len(rows(d.object_events(lab, p, *JOB[1:]))) == 3
    assert rows(d.picker(lab, "namespace", cluster_id="lab")) == [("jobs",), ("other",)]


def test_successive_incarnations(spark):
    """Of a name that four objects have had, those whose end history doesn't tell are open; closing one leaves the others."""
    schema = "ts timestamp, cluster_id string, api_group string, kind string, namespace string, name string, uid string, event_type string, sha256 string, api_version string, ingest_seq long"
    of = ("lab", "batch", "CronJob", "jobs", "sweep")
    seen = [("w", 10, "Snapshot", "v1"), ("w", 12, "Modified", "v1"), ("x", 20, "Added", "v1"), ("x", 25, "Deleted", "v1"), ("y", 31, "Added", "v2"), ("z", 47, "Added", "v2"), ("z", 48, "Checkpoint", "v2")]
    rs = spark.createDataFrame([(at(s), *of, uid, what, "" if what == "Deleted" else f"{uid}{s}", version, 100 - k) for k, (uid, s, what, version) in enumerate(seen)], schema)
    assert set(rows(q.last_known_states(rs, "lab", "batch", "CronJob"))) == {("jobs", "sweep", "w", "w12", "v1", at(12)), ("jobs", "sweep", "y", "y31", "v2", at(31)), ("jobs", "sweep", "z", "z48", "v2", at(48))}
    assert sorted(r.uid for r in unclosed_priors(rs).collect()) == ["w", "y"]
    # A close-out of recovery has the time of the row that it closes: the reference key loses that row, the safe one doesn't.
    closed = rs.unionAll(spark.createDataFrame([(at(12), *of, "w", "Deleted", "", "v1", 200)], schema))
    assert (final(closed).where("uid = 'w'").count(), final(closed, "safe").where("uid = 'w'").count()) == (2, 3)
    assert sorted(r[2] for r in rows(q.last_known_states(closed, "lab", "batch", "CronJob"))) == ["y", "z"]
    assert rows(q.object_digest(closed.withColumn("resource_version", F.lit("")), *of))[0][0] == "Checkpoint"
