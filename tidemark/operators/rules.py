"""Rules to watch plan: admission, expansion to targets, merging, and the fan-out of observations to them.

rules: rule_key, sink, namespaces array (empty: all), resources array of
struct(group, version, kind, selector), extra_redaction array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.documents import Redaction, annotation_path
from tidemark.functions.selectors import fits, parsed

#: So many rows of targets are sent to all workers; more are joined by exchange.
FEW = 10_000
TARGET = ["sink", "group", "version", "kind", "namespace"]


def redaction_path(entry: dict[str, str]) -> str:
    """The path of an entry that names a field or, shorter, an annotation."""
    return annotation_path(entry["annotation"]) if entry.get("annotation") else entry["fieldPath"]


def canonical_redaction(floor: list[str], extra: list[str]) -> str:
    """A sink's floor and a rule's additions as one text; a rule can't take anything away."""
    return "\n".join(sorted({*floor, *extra}))


def compiled(paths: list[str]) -> Redaction:
    """Parse on the driver, so that a bad path fails before any job starts."""
    return Redaction(paths)


def admitted(resources: DataFrame, policy: DataFrame | None) -> DataFrame:
    """Resources (group, kind) that the policy (group, kinds array) allows; '*' allows all kinds of a group, core Secrets never pass. Without a policy the rest passes."""
    safe = resources.where(~((F.col("group") == "") & (F.col("kind") == "Secret")))
    if policy is None:
        return safe
    allowed = policy.select(F.col("group").alias("__g"), F.explode("kinds").alias("__k"))
    return safe.join(allowed, (F.col("group") == F.col("__g")) & ((F.col("kind") == F.col("__k")) | (F.col("__k") == "*")), "left_semi")


def expand_rules(rules: DataFrame) -> DataFrame:
    """One row for each rule, resource and namespace; '' stands for all namespaces."""
    spaces = F.when(F.size(F.coalesce("namespaces", F.array().cast("array<string>"))) > 0, F.array_distinct("namespaces")).otherwise(F.array(F.lit("")))
    rows = rules.select("rule_key", "sink", F.coalesce("extra_redaction", F.array().cast("array<string>")).alias("redactions"), spaces.alias("spaces"), F.explode("resources").alias("r"))
    return rows.select("rule_key", "sink", "r.group", "r.version", "r.kind", F.coalesce("r.selector", F.lit("")).alias("selector"), "redactions", F.explode("spaces").alias("namespace"))


def canonical_selectors(targets: DataFrame) -> DataFrame:
    """Selectors in one spelling each."""
    spelled = parsed(targets.select("selector")).select(F.col("text").alias("__t"), "canonical")
    return targets.join(spelled, F.col("selector") == F.col("__t")).withColumn("selector", F.col("canonical")).drop("__t", "canonical")


def cluster_scoped_only(targets: DataFrame, kinds: DataFrame) -> DataFrame:
    """Targets that can be watched; ``kinds`` (group, version, kind, namespaced): a kind without namespaces has none to be narrowed to, unknown kinds wait."""
    known = kinds.select(F.col("group").alias("__g"), F.col("version").alias("__v"), F.col("kind").alias("__k"), "namespaced")
    rows = targets.join(known, (F.col("group") == F.col("__g")) & (F.col("version") == F.col("__v")) & (F.col("kind") == F.col("__k")))
    return rows.where("namespaced or namespace = ''").drop("__g", "__v", "__k", "namespaced")


def merge_targets(targets: DataFrame) -> DataFrame:
    """One row for each target, with the rules, selectors and redactions of all its rules, sorted; an entry goes when its last rule goes."""
    sets = [F.array_sort(F.collect_set(c)).alias(a) for c, a in (("rule_key", "rule_keys"), ("selector", "selectors"))]
    return targets.groupBy(*TARGET).agg(*sets, F.array_sort(F.array_distinct(F.flatten(F.collect_set("redactions")))).alias("redactions"))


def plan(rules: DataFrame, policy: DataFrame | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """The watch plan of all rules."""
    rows = canonical_selectors(admitted(expand_rules(rules), policy))
    return merge_targets(cluster_scoped_only(rows, kinds) if kinds is not None else rows)


def rules_by_sink(targets: DataFrame) -> DataFrame:
    return targets.select("sink", F.explode("rule_keys").alias("r")).groupBy("sink").agg(F.array_sort(F.collect_set("r")).alias("rule_keys"))


def targets_by_rule(targets: DataFrame) -> DataFrame:
    return targets.select(F.explode("rule_keys").alias("rule_key")).groupBy("rule_key").agg(F.count("*").alias("targets"))


def changed(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets that are new, and targets that are gone."""
    return after.join(before, TARGET, "left_anti"), before.join(after, TARGET, "left_anti")


def fan_out(observations: DataFrame, targets: DataFrame, previous_labels: str | None = None) -> DataFrame:
    """An observation for each sink with a target it fits: same group and kind, its namespace or all, and one of the selectors.

    ``labels`` (and ``previous_labels``, so that an object that just stopped to fit is
    still told) are map columns of ``observations``.  The targets of a (sink, group,
    kind) are one row, so an observation meets each sink once and is never exchanged
    to be made distinct; selectors travel as data, however many there are.
    """
    have = observations.drop("sink").columns
    terms = parsed(targets.select(F.explode("selectors").alias("s"))).select("text", "terms")
    each = targets.select("sink", "group", "kind", "namespace", F.explode("selectors").alias("text")).join(terms, "text")
    merged = each.groupBy(F.col("sink").alias("t_sink"), F.col("group").alias("t_group"), F.col("kind").alias("t_kind")).agg(F.collect_set(F.struct("namespace", "terms")).alias("t_wants"))
    if merged.limit(FEW + 1).count() <= FEW:
        merged = F.broadcast(merged)
    rows = observations.drop("sink").join(merged, (F.col("api_group") == F.col("t_group")) & (F.col("kind") == F.col("t_kind")))

    def wanted(t: Column) -> Column:
        told = fits(t["terms"])
        if previous_labels:
            told = told | fits(t["terms"], previous_labels)
        return ((t["namespace"] == "") | (t["namespace"] == F.col("namespace"))) & told

    return rows.where(F.exists("t_wants", wanted)).select(*have, F.col("t_sink").alias("sink"))


def in_epochs(observations: DataFrame, transitions: DataFrame) -> DataFrame:
    """Observations that a running scope holds, with ``scope_epoch``: how often scopes that hold the object had stopped by then.

    ``transitions``: the log that :func:`scope_transitions` makes; a scope runs from the
    instant it starts to before the instant it stops.  The log of a (cluster, sink,
    group, kind) is one row, so an observation is never multiplied.  A stream reads
    the log when it starts.
    """
    of = {"t_cluster": "cluster_id", "t_sink": "sink", "t_group": "api_group", "t_kind": "kind"}
    stop = Window.partitionBy(*of.values(), "namespace").orderBy("ts")
    # Actions alternate within a scope, so what follows a start is its stop.
    runs = transitions.withColumn("stopped", F.lead("ts").over(stop)).where("action = 'Started'")
    logs = runs.groupBy(*[F.col(c).alias(t) for t, c in of.items()]).agg(F.collect_list(F.struct("namespace", F.col("ts").alias("started"), "stopped")).alias("t_runs"))
    if logs.limit(FEW + 1).count() <= FEW:
        logs = F.broadcast(logs)
    have = [c for c in observations.columns if c != "scope_epoch"]
    rows = observations.join(logs, [F.col(c).eqNullSafe(F.col(t)) for t, c in of.items()])

    def holds(r: Column) -> Column:
        return (r["namespace"] == "") | (r["namespace"] == F.col("namespace"))

    def running(r: Column) -> Column:
        return holds(r) & (r["started"] <= F.col("ts")) & (r["stopped"].isNull() | (F.col("ts") < r["stopped"]))

    ended = F.filter("t_runs", lambda r: holds(r) & (r["stopped"] <= F.col("ts")))
    return rows.where(F.exists("t_runs", running)).select(*have, F.size(ended).cast("long").alias("scope_epoch"))


def with_previous_labels(observations: DataFrame) -> DataFrame:
    before = Window.partitionBy("api_group", "kind", "namespace", "name").orderBy("seq")
    return observations.withColumn("previous_labels", F.lag("labels").over(before))


def scope_transitions(changes: DataFrame) -> DataFrame:
    """Started and Stopped rows from a log of targets (ts, cluster_id, sink, api_group, api_version, kind, namespace, rule_key, delta: 1 or -1).

    A scope starts when its first target comes and stops when the last one goes;
    changes of one instant count together.  The rule is the first by name.
    """
    scope = ["cluster_id", "sink", "api_group", "kind", "namespace"]
    at = changes.groupBy(*scope, "ts").agg(F.sum("delta").alias("d"), F.min("rule_key").alias("rule_ref"), F.max("api_version").alias("api_version"))
    running = Window.partitionBy(*scope).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("n", F.sum("d").over(running)).withColumn("was", F.col("n") - F.col("d"))
    action = F.when((F.col("was") <= 0) & (F.col("n") > 0), "Started").when((F.col("was") > 0) & (F.col("n") <= 0), "Stopped")
    return at.withColumn("action", action).where("action is not null").select("ts", *scope, "api_version", "action", "rule_ref")
