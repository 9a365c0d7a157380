from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns, selectors, sql
from tidemark.operators import metrics, recover, rules
from tidemark.sources import adapter, churn, prometheus, tables
from tidemark.sources.schema import RESOURCE_STATES, WATCH_SCOPES, validate_schema
from tidemark.streaming import watch

T0 = datetime(2026, 1, 1)


@pytest.mark.parametrize(
    ("text", "same", "yes", "no"),
    [
        ("a=b", "a=b", {"a": "b"}, {"a": "c"}),
        (" b in (y, x) , a==1", "a=1,b in (x,y)", {"a": "1", "b": "y"}, {"a": "1"}),
        ("a!=b", "a!=b", {}, {"a": "b"}),
        ("a notin (b,c)", "a notin (b,c)", {"a": "d"}, {"a": "c"}),
        ("!a,b", "!a,b", {"b": ""}, {"a": "", "b": ""}),
        ("a in (x)", "a=x", {"a": "x"}, {}),
        ("a=", "a=", {"a": ""}, {}),
    ],
)
def test_selectors(spark, text, same, yes, no):
    assert selectors.canonical(text) == same
    assert selectors.matches(text, yes) and not selectors.matches(text, no)
    df = spark.createDataFrame([(1, yes), (2, no)], "k int, labels map<string,string>")
    assert [r.k for r in df.where(selectors.condition(text)).collect()] == [1]


@pytest.mark.parametrize("text", ["a b", "in (x)", "a,", "a in x", "=b", "a in (x"])
def test_bad_selectors(text):
    with pytest.raises(ValueError):
        selectors.parse(text)


def test_selector_objects(spark):
    assert selectors.from_object({"b": "2", "a": "1"}, [{"key": "c", "operator": "NotIn", "values": ["y", "x"]}, {"key": "d", "operator": "Exists"}]) == "a=1,b=2,c notin (x,y),d"
    df = spark.createDataFrame([(None,)], "labels map<string,string>")
    assert df.where(selectors.condition("!a")).count() == 1 and df.where(selectors.condition("a")).count() == 0
    assert df.where(selectors.any_condition(["a", ""])).count() == 1


def test_plan_merges_and_unmerges(spark):
    schema = "rule_key string, sink string, namespaces array<string>, resources array<struct<`group`:string,version:string,kind:string,selector:string>>, extra_redaction array<string>"
    r1, r2 = ("r1", "s", ["n"], [("apps", "v1", "D", "b=1,a=2")], ["x"]), ("r2", "s", ["n"], [("apps", "v1", "D", "a=2,b=1"), ("", "v1", "Secret", "")], ["y", "x"])
    both = rules.plan(spark.createDataFrame([r1, r2], schema))
    assert [(r.rule_keys, r.selectors, r.redactions) for r in both.collect()] == [(["r1", "r2"], ["a=2,b=1"], ["x", "y"])]
    one = rules.plan(spark.createDataFrame([r1], schema))
    assert [(r.rule_keys, r.redactions) for r in one.collect()] == [(["r1"], ["x"])]
    other = rules.plan(spark.createDataFrame([("r3", "s", None, [("", "v1", "Node", None)], None)], schema))
    new, gone = rules.changed(one, other)
    assert [r.kind for r in new.collect()] == ["Node"] and [r.kind for r in gone.collect()] == ["D"]
    assert [tuple(r) for r in rules.targets_by_rule(both).orderBy("rule_key").collect()] == [("r1", 1), ("r2", 1)]
    assert [tuple(r) for r in rules.rules_by_sink(both).collect()] == [("s", ["r1", "r2"])]
    kinds = spark.createDataFrame([("", "v1", "Node", False), ("apps", "v1", "D", True)], "`group` string, version string, kind string, namespaced boolean")
    narrow = rules.expand_rules(spark.createDataFrame([("r", "s", ["n"], [("", "v1", "Node", ""), ("apps", "v1", "D", ""), ("x", "v1", "Y", "")], None)], schema))
    assert [r.kind for r in rules.cluster_scoped_only(narrow, kinds).collect()] == ["D"]


def test_fan_out_sees_previous_labels(spark):
    targets = spark.createDataFrame([("s", "apps", "v1", "D", "", ["r"], ["a=1"], [])], "sink string, `group` string, version string, kind string, namespace string, rule_keys array<string>, selectors array<string>, redactions array<string>")
    rows = spark.createDataFrame([(1, "apps", "D", "n", "x", {"a": "1"}), (2, "apps", "D", "n", "x", {"a": "2"}), (3, "apps", "D", "n", "x", {"a": "3"})], "seq long, api_group string, kind string, namespace string, name string, labels map<string,string>")
    told = rules.fan_out(rules.with_previous_labels(rows), targets, "previous_labels")
    assert sorted(r.seq for r in told.collect()) == [1, 2]
    assert [r.seq for r in rules.fan_out(rows, targets).collect()] == [1]


def test_fan_out_has_one_row_for_each_sink_and_no_limit_of_selectors(spark):
    """Several targets of a sink may fit; selectors are data, so thousands of them make no larger plan."""
    schema = "sink string, `group` string, version string, kind string, namespace string, rule_keys array<string>, selectors array<string>, redactions array<string>"
    many = [(f"s{k % 3}", "apps", "v1", "D", "" if k % 2 else "n", [f"r{k}"], [f"a in (x{k},y)", f"!b,c!={k}"], []) for k in range(3000)]
    rows = spark.createDataFrame([(1, "apps", "D", "n", "p", {"a": "x7", "b": "1"}), (2, "apps", "D", "n", "q", {"b": "1"}), (3, "apps", "D", "z", "r", None), (4, "apps", "D", "z", "t", {"a": "x8", "b": ""})], "seq long, api_group string, kind string, namespace string, name string, labels map<string,string>")
    out = rules.fan_out(rows, spark.createDataFrame(many, schema))
    assert sorted((r.seq, r.sink) for r in out.collect()) == [(1, "s1"), (3, "s0"), (3, "s1"), (3, "s2")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and len(plan) < 40_000
    with pytest.raises(Exception, match="can't be read"):
        rules.fan_out(rows, spark.createDataFrame([("s", "apps", "v1", "D", "", ["r"], ["a b"], [])], schema)).collect()


def test_selectors_as_data_say_what_conditions_say(spark):
    texts = ["a=b", "a!=b", "a notin (b,c)", "!a,b", "a in (b,c),d", "", "a="]
    labels = [{}, {"a": "b"}, {"a": "c", "d": "1"}, {"b": ""}, {"a": ""}, None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(labels)], "k int, labels map<string,string>")
    terms = selectors.parsed(spark.createDataFrame([(t,) for t in texts], "s string"))
    got = {(r.text, r.k) for r in df.crossJoin(terms).where(selectors.fits(F.col("terms"))).collect()}
    assert got == {(t, r.k) for t in texts for r in df.where(selectors.condition(t)).collect()}


def test_sinks_alert_by_all_their_series(spark):
    """Two counters of one sink are rated apart: their values in turn aren't resets."""
    rows = [(T0 + timedelta(minutes=m), "w", {"sink": "a", "outcome": "failed", "pod": p}, v) for m in range(6) for p, v in (("x", 1000.0), ("y", 5.0 + (m >= 3)))]
    s = spark.createDataFrame(rows, "ts timestamp, name string, labels map<string,string>, value double")
    got = {r.ts.minute: round(r.rate * 120, 6) for r in metrics.sum_of_rates(s, "sink", 120).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 0}
    assert [r.ts.minute for r in metrics.writes_failing(s, "w", 60, 120).collect()] == [4]
    assert [tuple(r) for r in metrics.latest_gauges(s, "w", "sink").collect()] == [("a", 1006.0)]
    ready = [(T0 + timedelta(minutes=m), "rules", {"condition": "Ready", "status": "false", "kind": k}, v) for m in range(4) for k, v in (("A", 1.0), ("B", float(m % 2)))]
    s = spark.createDataFrame(ready, "ts timestamp, name string, labels map<string,string>, value double")
    assert [(r.labels["kind"], r.ts.minute) for r in metrics.rules_not_ready(s, seconds=180).collect()] == [("A", 3)]


def test_redaction_texts():
    assert rules.canonical_redaction(["b", "a"], ["a", "c"]) == "a\nb\nc"
    assert rules.redaction_path({"annotation": "x.y/z"}) == 'metadata.annotations["x.y/z"]'
    with pytest.raises(ValueError):
        rules.compiled(["a..b"])


def test_recovery_gates(spark):
    of = "cluster_id string, api_group string, kind string, namespace string, name string"
    hist = [("c", "apps", "D", "n", "gone", "u1", "Added", 1), ("c", "apps", "D", "n", "new", "u2", "Added", 2), ("c", "apps", "D", "n", "same", "u3", "Added", 3), ("c", "apps", "D", "m", "closed-scope", "u4", "Added", 4), ("c", "", "Event", "n", "ev", "u5", "Added", 5), ("c", "apps", "D", "n", "twice", "u6", "Added", 6), ("c", "apps", "D", "n", "twice", "u7", "Added", 7)]
    history = spark.createDataFrame([(T0 + timedelta(hours=h[-1]), *h[:-1], "sha", "v1", h[-1]) for h in hist], f"ts timestamp, {of}, uid string, event_type string, sha256 string, api_version string, ingest_seq long")
    scopes = spark.createDataFrame([(T0, "c", "apps", "v1", "D", "n", "Started", "r"), (T0, "c", "apps", "v1", "D", "m", "Started", "r"), (T0 + timedelta(hours=1), "c", "apps", "v1", "D", "m", "Stopped", "r"), (T0, "c", "", "v1", "Event", "n", "Started", "r"), (T0 + timedelta(days=2), "c", "apps", "v1", "D", "m", "Started", "r")], "ts timestamp, cluster_id string, api_group string, api_version string, kind string, namespace string, action string, rule_ref string")
    live = spark.createDataFrame([("c", "apps", "D", "n", "new", "u2b"), ("c", "apps", "D", "n", "same", "u3"), ("c", "apps", "D", "n", "twice", "u7")], f"{of}, uid string")
    desired = spark.createDataFrame([("c", "apps", "D", "n")], "cluster_id string, api_group string, kind string, namespace string")
    now = T0 + timedelta(days=3)
    got = recover.recover(history, scopes, live, desired, T0 + timedelta(days=2), now)
    assert sorted((r.name, r.uid, r.api_version, r.ts) for r in got.deleted.collect()) == [("gone", "u1", "", now), ("new", "u2", "v1", T0 + timedelta(hours=2)), ("twice", "u6", "v1", T0 + timedelta(hours=6))]
    assert sorted((r.kind, r.namespace) for r in got.stopped.collect()) == [("D", "m"), ("Event", "n")]
    assert {r.uid for r in got.seed.collect()} == {"u1", "u2", "u3", "u4", "u5", "u7"}


def test_refused_claims_close_what_has_a_successor(spark):
    of = "cluster_id string, api_group string, kind string, namespace string, name string, uid string"
    hist = [("a", "u1", "Added", 1), ("a", "u2", "Added", 2), ("b", "u3", "Added", 3), ("c", "u4", "Added", 4), ("c", "u4", "Deleted", 5), ("c", "u5", "Added", 6), ("d", "u6", "Added", 7), ("d", "u7", "Added", 8)]
    history = spark.createDataFrame([(T0 + timedelta(hours=h[-1]), "k", "apps", "D", "n", *h[:-1], "sha", "v1", h[-1]) for h in hist], f"ts timestamp, {of}, event_type string, sha256 string, api_version string, ingest_seq long")
    claims = [("k", "apps", "D", "n", *x) for x in (("a", "u1"), ("a", "u1"), ("b", "u3"), ("c", "u4"), ("x", "u8"))]
    got = recover.close_refused(spark.createDataFrame(claims, of), history)
    assert [(r.name, r.uid, r.event_type, r.ts, r.api_version) for r in got.deleted.collect()] == [("a", "u1", "Deleted", T0 + timedelta(hours=1), "v1")]
    assert [(r.name, r.uid) for r in got.pending.collect()] == [("b", "u3")]
    none = recover.close_refused(spark.createDataFrame([], of), history)
    assert none.deleted.count() == none.pending.count() == 0


def test_epochs_count_the_stops_of_all_scopes_that_hold_an_object(spark):
    log = [(0, "n", "Started"), (2, "n", "Stopped"), (3, "n", "Started"), (3, "", "Started"), (5, "", "Stopped"), (8, "n", "Stopped")]
    transitions = spark.createDataFrame([(T0 + timedelta(hours=h), "k", "s", "apps", "D", ns, "v1", a, "r") for h, ns, a in log], watch.SCOPES)
    seen = [(h, ns, kind) for h in range(9) for ns in ("n", "m") for kind in ("D", "E")]
    observed = spark.createDataFrame([(T0 + timedelta(hours=h), "k", "s", "apps", kind, ns, -1) for h, ns, kind in seen], "ts timestamp, cluster_id string, sink string, api_group string, kind string, namespace string, scope_epoch long")
    got = rules.in_epochs(observed, transitions)
    assert got.columns == observed.columns
    want = {(h, "n"): e for h, e in ((0, 0), (1, 0), (3, 1), (4, 1), (5, 2), (6, 2), (7, 2))} | {(3, "m"): 0, (4, "m"): 0}
    rows = got.collect()
    assert {((r.ts - T0).seconds // 3600, r.namespace): r.scope_epoch for r in rows} == want and len(rows) == len(want)
    assert rules.in_epochs(observed, transitions.limit(0)).count() == 0


def test_scopes_follow_rules(spark, tmp_path):
    """Each batch evaluates the plan again; a scope that two rules want runs until the last of them goes, and a rule may come back."""
    res = lambda kind, version="v1": [("apps", version, kind, "")]
    steps = [
        [(0, "r1", "s", ["n"], res("D"), None, False), (0, "r2", "s", ["n", "m"], res("D", "v2"), None, None), (0, "r4", "s", None, [("", "v1", "Secret", "")], None, False)],
        [(1, "r1", "s", None, None, None, True), (1, "r3", "t", None, res("E"), None, False)],
        [(2, "r2", "s", ["m"], res("D"), None, False)],
        [(3, "r1", "s", ["n"], res("D"), None, False), (3, "r3", "t", None, None, None, True)],
    ]
    for k, step in enumerate(steps):
        spark.createDataFrame([(T0 + timedelta(hours=r[0]), *r[1:]) for r in step], watch.RULES).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        for _ in range(2 if k == 1 else 1):  # nothing new gives no batch
            changes = spark.readStream.schema(watch.RULES).json(str(tmp_path / "in"))
            watch.follow_rules(changes, str(tmp_path / "watch"), str(tmp_path / "checkpoint"), cluster="k").awaitTermination()
    got = watch.read_scopes(spark, str(tmp_path / "watch")).collect()
    assert sorted(((r.ts - T0).seconds // 3600, r.action, r.sink, r.kind, r.namespace, r.api_version, r.rule_ref) for r in got) == [
        (0, "Started", "s", "D", "m", "v2", "r2"),
        (0, "Started", "s", "D", "n", "v2", "r1"),
        (1, "Started", "t", "E", "", "v1", "r3"),
        (2, "Stopped", "s", "D", "n", "v2", "r1"),
        (3, "Started", "s", "D", "n", "v1", "r1"),
        (3, "Stopped", "t", "E", "", "v1", "r3"),
    ]
    epochs = rules.in_epochs(spark.createDataFrame([(T0 + timedelta(hours=h), "k", "s", "apps", "D", "n") for h in (1, 2, 3)], "ts timestamp, cluster_id string, sink string, api_group string, kind string, namespace string"), watch.read_scopes(spark, str(tmp_path / "watch")))
    assert sorted(((r.ts - T0).seconds // 3600, r.scope_epoch) for r in epochs.collect()) == [(1, 0), (3, 1)]


def test_metrics(spark):
    s = spark.createDataFrame([(T0 + timedelta(minutes=m), "c", {"sink": "a", "outcome": "failed"}, float(v)) for m, v in ((0, 10), (1, 16), (2, 4), (3, 4), (20, 4))], "ts timestamp, name string, labels map<string,string>, value double")
    got = [round(r.rate * 300, 6) for r in metrics.rate(s, ["name"], 300).orderBy("ts").collect()]
    assert got == [0, 6, 10, 10, 0]
    assert [r.ts for r in metrics.writes_failing(s, "c", 120).collect()] == [T0 + timedelta(minutes=3)]
    assert metrics.total(s, "c", sink="a").first()[0] == 38 and metrics.total(s, "x").first()[0] == 0
    assert metrics.find(s, "c", sink="b").count() == 0
    b = spark.createDataFrame([("h", 1.0, 2.0), ("h", 2.0, 4.0), ("h", float("inf"), 4.0), ("z", 1.0, 0.0)], "k string, le double, value double")
    assert [tuple(r) for r in metrics.histogram_quantile(0.75, b, ["k"]).collect()] == [("h", 1.5)]
    c = spark.createDataFrame([("Ready", "true"), ("Ready", "true"), ("Ready", "false")], "condition string, status string")
    assert sorted(map(tuple, metrics.condition_counts(c).collect())) == [("Ready", "false", 1), ("Ready", "true", 2), ("Ready", "unknown", 0)]


def test_alerts_hold(spark):
    rows = [(T0 + timedelta(minutes=m), n, {"sink": "a"}, v) for m in range(8) for n, v in (("write_queue_depth", 90.0 if m != 2 else 10.0), ("write_queue_capacity", 100.0))]
    s = spark.createDataFrame(rows, "ts timestamp, name string, labels map<string,string>, value double")
    assert sorted(r.ts.minute for r in metrics.queue_nearly_full(s, seconds=180).collect()) == [6, 7]


@pytest.mark.parametrize(
    ("line", "want"),
    [("# HELP x", None), ("  ", None), ("a 1", ("a", {}, 1.0)), ('a_b{x="y",z="q\\"r\\n"} 2e3 123', ("a_b", {"x": "y", "z": 'q"r\n'}, 2000.0)), ('h_bucket{le="+Inf"} +Inf', ("h_bucket", {"le": "+Inf"}, float("inf")))],
)
def test_metric_lines(line, want):
    assert prometheus.parse_line(line) == want


@pytest.mark.parametrize("line", ["a", "a{x=y} 1", 'a{x="y" 1', "1a 2", "a b"])
def test_bad_metric_lines(line):
    with pytest.raises(ValueError):
        prometheus.parse_line(line)


def test_metric_text(spark, tmp_path):
    (tmp_path / "m.txt").write_text('# TYPE a counter\na{s="1"} 1\n\na NaN\nbroken\n')
    got = prometheus.read(spark, str(tmp_path)).collect()
    assert len(got) == 3 and [r.line for r in got if r.line] == ["broken"]
    assert any(r.value != r.value for r in got if r.value is not None)


def test_churn(spark):
    rows = churn.churn(spark, 30, 100, 10, deletes=0.5)
    assert rows.count() == 130 and rows.select("kind").distinct().count() == 3
    assert 20 < rows.where("op = 'delete'").count() < 80
    assert churn.churn_stream(spark, 10, 5).isStreaming


def test_tables(spark, tmp_path):
    path = str(tmp_path / "states")
    rows = adapter.resource_states(spark, "/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("labels", F.create_map().cast("map<string,string>"))
    old = rows.limit(5).withColumn("ts", F.expr("ts - interval 60 days"))
    tables.append_states(rows.unionByName(old), path)
    back = tables.read_states(spark, path, "c0", datetime(2024, 1, 10), datetime(2024, 1, 12))
    assert back.count() == rows.where("cluster_id = 'c0' AND ts BETWEEN '2024-01-10' AND '2024-01-12'").count()
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster_id" in plan and "yyyymm" in plan
    assert not validate_schema(tables.read_states(spark, path), RESOURCE_STATES)
    sinks = str(tmp_path / "sinks")
    tables.append_states(old.withColumn("sink", F.lit("s")), sinks)
    assert all(g.startswith("sink=s/cluster_id=") for g in tables.expire_states(spark, sinks, datetime(2024, 1, 5)))
    before = spark.read.parquet(path).count()
    gone = tables.expire_states(spark, path, datetime(2024, 1, 5))
    assert gone and all("yyyymm=202311" in g or "yyyymm=202312" in g for g in gone)
    assert spark.read.parquet(path).count() == before - 5
    assert tables.retained(spark.read.parquet(path), datetime(2024, 1, 15)).where("ts < '2024-01-15'").count() == 0


def test_create_and_validate(spark):
    tables.create_tables(spark)
    tables.create_tables(spark)
    assert not validate_schema(spark.table("resource_states"), RESOURCE_STATES)
    assert not validate_schema(spark.table("watch_scopes"), WATCH_SCOPES)
    wrong = spark.table("watch_scopes").drop("action").withColumn("kind", F.lit(1))
    assert validate_schema(wrong, WATCH_SCOPES, "w") == ["w.kind: is int, want string", "w.action: missing, want string"]
    assert validate_schema(None, WATCH_SCOPES, "w") == ["w: missing"]


def test_macros(spark):
    spark.range(3).selectExpr("timestamp '2026-01-01 00:00:00' + make_interval(0,0,0,0,id) AS ts", "concat('n', id) AS ns").createOrReplaceTempView("macro_rows")
    sql = columns.expand("SELECT $__timeInterval(ts) AS time, count(*) AS n FROM macro_rows WHERE $__timeFilter(ts) AND ns IN (${ns:sqlstring}) GROUP BY 1 ORDER BY 1 LIMIT ${top}", {"ns": ["n1", "n2", "it's"], "top": ["5"]}, T0, T0 + timedelta(hours=1), 3600)
    assert [r.n for r in spark.sql(sql).collect()] == [1]
    for bad in ("${x}", "${ns:json}", "$__nothing(ts)"):
        with pytest.raises(ValueError):
            columns.expand(bad, {"ns": ["a"]}, T0, T0, 60)


def test_typed_parameters(spark):
    sql, args = columns.bound("SELECT {a:String} AS a, {n: UInt64} AS n, {f:Float64} AS f, {t:DateTime64(3)} AS t, '${x:sqlstring}' AS x", {"n": 7})
    assert tuple(spark.sql(sql, args).first()) == ("", 7, 0, datetime(1970, 1, 1), "${x:sqlstring}")
    assert columns.bound("SELECT {a:String}, {a:String}", {"a": "it's {b:String}"}) == ("SELECT :a, :a", {"a": "it's {b:String}"})
    for bad, given in (("{a:Array(String)}", {}), ("{a:String}", {"b": 1})):
        with pytest.raises(ValueError):
            columns.bound(bad, given)
    assert columns.bound("{a:Array(String)}", {"a": ["x"]})[1] == {"a": ["x"]}


def test_functions_for_sql(spark):
    sql.register(spark)
    doc = '{"kind":"D","metadata":{"uid":"u","resourceVersion":"7"},"spec":{"b":1,"a":"x"}}'
    df = spark.createDataFrame([(doc,), ("no json",), (None,)], "d string")
    got = df.selectExpr("normalize_object(d, array('spec.a')) AS n", "canonical_json(d) AS c", """json_patch_apply(d, json_diff(d, '{"x":1}')) AS p""", "normalize_object(d, null).uid AS uid").collect()
    assert (got[0].n.uid, got[0].n.resource_version, got[0].uid) == ("u", "7", "u") and '"a":"[REDACTED]"' in got[0].n.json
    assert got[0].c.index('"a"') < got[0].c.index('"b"') and got[0].p == '{"x":1}'
    assert all(tuple(r) == (None,) * 4 for r in got[1:])
    lines = spark.sql("""SELECT * FROM parse_metrics('# HELP a\na{s="1"} 2\nbroken\nb 3')""").collect()
    assert [(r.name, r.labels, r.value) for r in lines] == [("a", {"s": "1"}, 2.0), ("b", {}, 3.0)]


def test_json_reads(spark):
    docs = ['{"a":"x","n":5,"o":{"b":"y"},"z":null}', "", "not json", '{"a":7}']
    df = spark.createDataFrame([(k, x) for k, x in enumerate(docs)], "k int, data string").orderBy("k")
    got = df.select(columns.json_str("data", "a"), columns.json_str("data", "o", "b"), columns.json_str("data", "z"), columns.json_str("data", "o"), columns.json_uint("data", "n")).collect()
    assert [tuple(r) for r in got] == [("x", "y", "", "", 5), *[("", "", "", "", 0)] * 3]


def test_keys(spark):
    df = spark.createDataFrame([("apps", "D", "n", "a"), ("apps", "D", "", "b")], "api_group string, kind string, namespace string, name string")
    keys = [r[0] for r in df.select(columns.identity_key()).collect()]
    assert keys == ["apps|D|n/a", "apps|D|/b"]
    assert [k.startswith(columns.scope_prefix("apps", "D", "n")) for k in keys] == [True, False]
    assert all(k.startswith(columns.scope_prefix("apps", "D", "")) for k in keys)


def test_identity_is_built_in_one_place():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "tidemark"
    found = [p.name for p in root.rglob("*.py") if p.parent.name != "llm" and 'IDENTITY = ["cluster_id"' in p.read_text()]
    assert found == ["schema.py"]
    assert not [p for p in root.rglob("*.py") if p.parent.name != "llm" and "tidemark.llm" in p.read_text()]
