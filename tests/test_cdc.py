import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import replay
from tidemark.operators.final import final
from tidemark.plans import library
from tidemark.operators.cdc import Classifier, State, as_states, checkpoint_due, classify, quarantined
from tidemark.functions.documents import Redaction, json_patch, normalize, sha256
from tidemark.operators.cdc import KEY
from tidemark.sources.schema import RESOURCE_STATES, STORED_STATES, validate_schema
from tidemark.sources import observations, tables
from tidemark.streaming.classify import classify_stream, write_history

COLUMNS = "seq long, ts timestamp, ts_ns long, sink string, op string, cluster_id string, api_group string, api_version string, kind string, namespace string, name string, object_json string, scope_warm boolean"


def doc(uid="u1", x=1, **more):
    return json.dumps({"apiVersion": "apps/v1", "kind": "D", "metadata": {"uid": uid, "resourceVersion": str(x)}, "spec": {"x": x, "long": "y" * 200}} | more)


def obs(op="upsert", body=None, kind="D", warm=True, group="apps", seq=0):
    return {"seq": seq, "ts_ns": seq, "op": op, "object_json": body, "scope_warm": warm, "sink": "s", "cluster_id": "c", "api_group": group, "kind": kind, "namespace": "n", "name": "a"}


def run(steps, **options):
    state, out = None, []
    c = Classifier(**options)
    for k, o in enumerate(steps):
        state, rows = c.step(state, o | {"seq": k, "ts_ns": k})
        out += rows
    return state, out


EVENT = {"kind": "Event", "group": ""}


@pytest.mark.parametrize(
    ("steps", "want"),
    [
        ([obs(body=doc())], [("Added", True, False)]),
        ([obs(body=doc(), warm=False)], [("Snapshot", True, False)]),
        ([obs(body=doc(), warm=False, **EVENT)], [("Added", True, False)]),
        ([obs(body=doc()), obs(body=doc())], [("Added", True, False)]),
        ([obs(body=doc()), obs(body=doc(x=2))], [("Added", True, False), ("Modified", False, True)]),
        ([obs(body=doc(), **EVENT), obs(body=doc(x=2), **EVENT)], [("Added", True, False), ("Modified", True, False)]),
        ([obs(body=doc()), obs(body=doc("u2"))], [("Added", True, False), ("Deleted", False, False), ("Added", True, False)]),
        ([obs(body=doc(), **EVENT), obs(body=doc("u2"), **EVENT)], [("Added", True, False), ("Added", True, False)]),
        ([obs(body=doc("")), obs(body=doc("u2"))], [("Added", True, False), ("Modified", False, True)]),
        ([obs(body=doc()), obs("delete"), obs("delete")], [("Added", True, False), ("Deleted", False, False)]),
        ([obs("delete")], []),
        ([obs(body=doc(), **EVENT), obs("delete", **EVENT)], [("Added", True, False)]),
        ([obs(body=doc()), obs("scope_stop"), obs(body=doc(), warm=False)], [("Added", True, False), ("Snapshot", True, False)]),
    ],
)
def test_decisions(steps, want):
    assert [(r["event_type"], r["data"] != "", r["diff"] != "") for r in run(steps)[1]] == want


def test_deleted_row_is_bare():
    _, rows = run([obs(body=doc()), obs("delete")])
    last = rows[-1]
    assert (last["uid"], last["api_version"], last["labels"], last["actors"], last["resource_version"], last["sha256"]) == ("u1", "v1", {}, [], "", "")


def test_seeded_state_has_no_baseline():
    state, rows = Classifier().step(State("u1", "old"), obs(body=doc()))
    assert rows[0]["event_type"] == "Modified" and rows[0]["data"] and not rows[0]["diff"]
    assert state.run == 0


@pytest.mark.parametrize(
    ("every", "run_", "diff", "full", "want"),
    [(50, 7, 120, 4000, None), (3, 3, 120, 4000, "count"), (3, 2, 120, 4000, None), (1000, 1, 4001, 4000, "size"), (1000, 1, 4000, 4000, None), (3, 3, 9000, 4000, "count"), (0, 5000, 120, 4000, None), (0, 1, 40000, 4000, None), (-1, 99, 40000, 4000, None)],
)
def test_checkpoint_due(every, run_, diff, full, want):
    assert checkpoint_due(every, run_, diff, full) == want


def test_checkpoints_come_by_count():
    _, rows = run([obs(body=doc(x=k)) for k in range(12)], checkpoint_every=4)
    assert [r["event_type"] for r in rows] == ["Added", *["Modified"] * 3, "Checkpoint", *["Modified"] * 3, "Checkpoint", *["Modified"] * 3]
    base = json.loads(rows[8]["data"])
    for r in rows[9:]:
        base = json_patch(base, json.loads(r["diff"]))
    assert base["spec"]["x"] == 11


def scenario(n=300, seed=1):
    rng, rows = random.Random(seed), []
    for seq in range(n):
        name, op = f"o{rng.randrange(12)}", rng.choice(["upsert"] * 8 + ["delete", "scope_stop"])
        kind = "Event" if name in ("o1", "o2") else "D"
        body = doc(f"{name}-{rng.randrange(2)}", rng.randrange(4)) if op == "upsert" else None
        if seq % 97 == 50:
            op, body = "upsert", "not json"
        rows.append((seq, datetime(2024, 1, 1), 10**9 * (seq + 1), "s", op, "c", "" if kind == "Event" else "apps", "v1", kind, "n", name, body, seq > 60))
    return rows


def plain(rows):
    return sorted((r.ts_ns, r.name, r.event_type, r.uid, r.data or "", r.diff or "", r.sha256 or "", r.error or "", tuple(r.actors or []), tuple(sorted((r.labels or {}).items()))) for r in rows)


def in_python(rows, **options):
    c, states, out = Classifier(**options), {}, []
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    for o in (dict(zip(names, r, strict=True)) for r in rows):
        key = tuple(o[k] for k in KEY)
        states[key], more = c.step(states.get(key), o)
        out += more
    return out


def test_batch_equals_the_rules(spark):
    rows = scenario()
    got = classify(spark.createDataFrame(random.Random(3).sample(rows, len(rows)), COLUMNS), Classifier(checkpoint_every=3))
    want = in_python(rows, checkpoint_every=3)
    assert plain(got.collect()) == plain([type("R", (), r) for r in want])
    assert quarantined(got).count() == 3
    states = as_states(got)
    assert not validate_schema(states, RESOURCE_STATES)


def test_seed(spark):
    first = spark.createDataFrame([("s", "c", "apps", "D", "n", "a", "u1", "old", "v0"), ("s", "c", "apps", "D", "n", "b", "u9", "x", "v0")], "sink string, cluster_id string, api_group string, kind string, namespace string, name string, uid string, sha256 string, api_version string")
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1), 5, "s", "upsert", "c", "apps", "v1", "D", "n", "a", doc(), True), (2, datetime(2024, 1, 1), 6, "s", "upsert", "c", "apps", "v1", "D", "n", "b", doc(), True)], COLUMNS)
    got = classify(rows, seed=first).orderBy("seq", "event_type").collect()
    assert [(r.name, r.event_type, r.uid, r.api_version) for r in got] == [("a", "Modified", "u1", "v1"), ("b", "Added", "u1", "v1"), ("b", "Deleted", "u9", "v0")]


def test_stream_equals_batch(spark, tmp_path):
    rows = scenario(120)
    for k in range(3):
        part = spark.createDataFrame(rows[k * 40 : k * 40 + 40], COLUMNS).coalesce(1)
        part.write.mode("append").json(str(tmp_path / "in"))
        stream = classify_stream(observations.read_stream(spark, str(tmp_path / "in")), Classifier(checkpoint_every=3))
        query = write_history(stream, str(tmp_path / "states"), str(tmp_path / "bad"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
    batch = as_states(classify(spark.createDataFrame(rows, COLUMNS), Classifier(checkpoint_every=3)))
    got = spark.read.parquet(str(tmp_path / "states"))
    cols = ["ts_ns", "name", "event_type", "uid", "data", "diff", "sha256"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
    assert not validate_schema(got, STORED_STATES)
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
    assert sum(p["observedMetrics"]["tidemark"]["rows"] for p in query.recentProgress if "tidemark" in p["observedMetrics"]) > 0


def test_stream_with_seed_and_sinks(spark, tmp_path):
    """State from history is there before the first batch; each sink has a state and a table of its own."""
    seed = spark.createDataFrame([("s1", "c", "apps", "D", "n", "a", "u9", "x", "v0")], "sink string, cluster_id string, api_group string, kind string, namespace string, name string, uid string, sha256 string, api_version string")
    rows = [(k, datetime(2024, 1, 1), 10**9 + k, sink, "upsert", "c", "apps", "v1", "D", "n", "a", doc(), True) for k, sink in enumerate(("s1", "s2"))]
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.json(str(tmp_path / "in"))
    stream = classify_stream(observations.read_stream(spark, str(tmp_path / "in")), seed=seed)
    write_history(stream, str(tmp_path / "states"), str(tmp_path / "bad"), str(tmp_path / "checkpoint")).awaitTermination()
    one, two = (spark.read.parquet(str(tmp_path / "states" / f"sink={s}")) for s in ("s1", "s2"))
    assert sorted((r.event_type, r.uid, r.api_version) for r in one.collect()) == [("Added", "u1", "v1"), ("Deleted", "u9", "v0")]
    assert [(r.event_type, r.uid) for r in two.collect()] == [("Added", "u1")]


def test_replay(spark):
    at = 10**9
    rows = [(k, datetime(2024, 1, 1), at * (k + 1), "s", "upsert", "c", "apps", "v1", "D", "n", "web", doc(x=k, status={"g": k, "l": list(range(k % 4))}), True) for k in range(12)]
    rows += [(20, datetime(2024, 1, 1), at * 30, "s", "delete", "c", "apps", "v1", "D", "n", "web", None, True)]
    states = as_states(classify(spark.createDataFrame(rows, COLUMNS), Classifier(checkpoint_every=4)))
    for k in (0, 3, 4, 7, 11):
        (r,) = replay.reconstruct_at(states, datetime(1970, 1, 1, 0, 0, k + 1)).collect()
        assert (json.loads(r.state)["spec"]["x"], r.verified, r.exists, r.error) == (k, True, True, None)
        assert r.steps < 4 and sha256(r.state) == r.sha256
    (r,) = replay.reconstruct_at(states, datetime(1970, 1, 1, 0, 0, 30)).collect()
    assert not r.exists and r.state is None
    assert replay.reconstruct_at(states, datetime(1969, 1, 1)).count() == 0


def observation(seq, ns, op="upsert", body=None, name="web", warm=True, namespace="n", kind="D"):
    return (seq, datetime(2024, 1, 1), ns, "s", op, "c", "apps", "v1", kind, namespace, name, body, warm)


def test_replaced_object_lives_on_as_its_successor(spark):
    """The close-out comes before the successor's first row and ends its own uid only."""
    second = 10**9
    rows = [observation(0, second, body=doc("u1")), observation(1, 2 * second, body=doc("u1", 2)), observation(2, 3 * second, body=doc("u2", 5)), observation(3, 4 * second, body=doc("u2", 6)), observation(4, 5 * second, "delete"), observation(5, 6 * second, body=doc("u3", 7))]
    states = as_states(classify(spark.createDataFrame(rows, COLUMNS)))
    assert [(r.ts_ns, r.event_type, r.uid) for r in states.orderBy("ts_ns").collect()] == [(second, "Added", "u1"), (2 * second, "Modified", "u1"), (3 * second - 1, "Deleted", "u1"), (3 * second, "Added", "u2"), (4 * second, "Modified", "u2"), (5 * second, "Deleted", "u2"), (6 * second, "Added", "u3")]
    assert final(states).count() == 7
    at = lambda s: replay.reconstruct_at(states, datetime(1970, 1, 1, 0, 0, s)).first()
    assert [(r.uid, r.exists, r.verified, json.loads(r.state)["spec"]["x"] if r.state else None) for r in map(at, range(1, 7))] == [("u1", True, True, 1), ("u1", True, True, 2), ("u2", True, True, 5), ("u2", True, True, 6), ("u2", False, None, None), ("u3", True, True, 7)]
    digest = library.object_digest(states.where(F.col("ts_ns") <= 3 * second), "c", "apps", "D", "n", "web").first()
    assert (digest.last_event, digest.incarnations) == ("Added", 2)


def test_replacement_within_one_instant(spark):
    """With no time left before the successor, both share the instant, and the order is still that of arrival."""
    rows = [observation(0, 5000, body=doc("u1")), observation(1, 5000, body=doc("u2", 2)), observation(2, 5000, body=doc("u2", 3))]
    states = as_states(classify(spark.createDataFrame(rows, COLUMNS)))
    assert {(r.event_type, r.uid, r.ts_ns) for r in states.collect()} == {("Added", "u1", 5000), ("Deleted", "u1", 5000), ("Added", "u2", 5000), ("Modified", "u2", 5000)}
    r = replay.reconstruct_at(states, datetime(1970, 1, 2)).first()
    assert (r.uid, r.exists, r.verified, r.steps) == ("u2", True, True, 1) and json.loads(r.state)["spec"]["x"] == 3
    assert library.object_digest(states, "c", "apps", "D", "n", "web").first().last_event == "Modified"
    assert final(states).first().uid == "u2"


def test_late_deletion_of_an_earlier_incarnation(spark):
    """A close-out that recovery wrote later, with or without a time of its own, changes nothing for the successor."""
    second = 10**9
    states = as_states(classify(spark.createDataFrame([observation(0, second, body=doc("u1")), observation(1, 2 * second, body=doc("u2", 4)), observation(2, 3 * second, body=doc("u2", 5))], COLUMNS)))
    late = states.where("uid = 'u1' and event_type = 'Deleted'").withColumns({"ts_ns": F.lit(9 * second), "ts": F.timestamp_micros(F.lit(9_000_000)), "ingest_seq": F.lit(99).cast("long")})
    r = replay.reconstruct_at(states.unionByName(late), datetime(1970, 1, 1, 0, 1)).first()
    assert (r.uid, r.exists, r.verified, r.steps) == ("u2", True, True, 1)


def test_times_keep_their_microsecond(spark):
    ns = 1_705_811_179_890_576_000  # as a double it would lose its last digits
    state = as_states(classify(spark.createDataFrame([observation(0, ns, body=doc()), observation(1, -1500, body=doc(), name="old")], COLUMNS)))
    assert {r.name: r.us for r in state.select("name", F.unix_micros("ts").alias("us")).collect()} == {"web": ns // 1000, "old": -2}


def test_a_scope_stops_as_a_whole(spark):
    """All objects of the scope start anew, those of other scopes don't; nothing is written for the stop."""
    rows = [observation(k, 10 + k, body=doc(), name=n, namespace=s, kind=d) for k, (n, s, d) in enumerate([("a", "n", "D"), ("b", "n", "D"), ("a", "m", "D"), ("a", "n", "E")])]
    stop = lambda s: [observation(9, 20, "scope_stop", name="", namespace=s)]
    again = [observation(10 + k, 30 + k, body=doc(), name=r[10], namespace=r[9], kind=r[8], warm=False) for k, r in enumerate(rows)]
    got = lambda s: sorted((r.namespace, r.kind, r.name) for r in classify(spark.createDataFrame(rows + stop(s) + again, COLUMNS)).where("event_type = 'Snapshot'").collect())
    assert got("n") == [("n", "D", "a"), ("n", "D", "b")]
    assert got("") == [("m", "D", "a"), ("n", "D", "a"), ("n", "D", "b")]


def test_a_seed_learns_its_epoch():
    seeded = State("u1", normalize(json.loads(doc()), Redaction())["sha256"])
    o = obs(body=doc())
    state, rows = Classifier().step(seeded, o | {"scope_epoch": 2})
    assert (state.epoch, rows) == (2, [])
    assert Classifier().step(state, o)[0].epoch == 2
    assert [r["event_type"] for r in Classifier().step(state, o | {"scope_epoch": 3})[1]] == ["Added"]


def test_epochs_of_scopes(spark, tmp_path):
    """A later epoch forgets the state without a row, an earlier one is dropped; the same in batch and in a stream."""
    steps = [(0, 0, "u1"), (1, 0, "u1"), (2, 1, "u1"), (3, 0, "u2"), (4, None, "u1"), (5, 3, "u3")]
    rows = [(*observation(k, 10 + k, body=doc(uid=u)), e) for k, e, u in steps]
    schema = f"{COLUMNS}, scope_epoch long"
    want = [(0, "Added", "u1"), (2, "Added", "u1"), (5, "Added", "u3")]
    one = spark.createDataFrame(rows, schema)
    assert [(r.seq, r.event_type, r.uid) for r in classify(one).orderBy("seq").collect()] == want
    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        if k % 2:
            stream = classify_stream(observations.read_stream(spark, str(tmp_path / "in")))
            write_history(stream, str(tmp_path / "states"), str(tmp_path / "bad"), str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "states")).orderBy("ts_ns").collect()
    assert [(r.ts_ns - 10, r.event_type, r.uid) for r in got] == want


def test_a_batch_that_runs_again_replaces_what_it_wrote(spark, tmp_path):
    states = as_states(classify(spark.createDataFrame(scenario(60), COLUMNS))).drop("sink")
    path = str(tmp_path / "states")
    for _ in range(2):
        tables.append_states(states, path, "q-0")
    tables.append_states(states.limit(3), path, "q-1")
    assert tables.read_states(spark, path).count() == states.count() + 3
    assert not validate_schema(tables.read_states(spark, path), STORED_STATES)


def test_current_and_coalesced(spark):
    rows = observations.events(spark.createDataFrame(scenario(200), COLUMNS))
    last = {}
    for r in rows.orderBy("seq").collect():
        last[r.name] = r
    assert {r.name: r.seq for r in observations.coalesced(rows).collect()} == {n: r.seq for n, r in last.items()}
    assert {r.name for r in observations.current(rows).collect()} == {n for n, r in last.items() if r.op == "upsert"}
    assert observations.coalesced(rows).where(F.col("seq").isNull()).count() == 0
