"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a text is content-addressed by its SHA-256.  The ledger holds
one row for each pair of a blob and a rule version that was ever scanned, with
the spans found (often none), so a rerun scans only pairs it has not seen: new
texts, and old texts under new rule versions.  A ledger row is the finding and
the proof of the scan at once; both appear in one write.  Findings are joined
back to every path that holds the blob.

Positions come from the pieces between matches: a pattern splits the text, and
lengths of pieces and matches add up to starts, in code points.

Defined cases: a null text is the empty one.  Each row is a version of its path,
repeated rows and ids stay as they are.  A blob that a third of all rows share is
scanned once, and joins back as a skewed key that adaptive execution splits.  An
empty table gives no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch_dir, stored


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The patterns of the base rules.
_KEYWORDS = "|".join([*map(_either_case, ["password", "passwd", "secret", "token"]), f"{_either_case('api')}_?{_either_case('key')}"])
ASSIGN = rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` of which ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}/{self.version}"


#: Greedy runs: asking for the least length inside the pattern keeps the same matches and skips short ones early.
BASE = (Rule("assign", ASSIGN, 6, 2), Rule("access", "AKIA[A-Z0-9]{16,}"), Rule("hex", "[0-9a-f]{24,}"))
RULES = (*BASE, Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}"), Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"))


def spans(text: Column, rule: Rule) -> Column:
    """Array of struct(start, end) of the rule's matches, end exclusive, in code points."""
    pattern = F.lit(rule.pattern)
    lengths = F.transform(F.regexp_extract_all(text, pattern, 0), F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    values = F.transform(F.regexp_extract_all(text, pattern, rule.group), F.length)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, m):
        start = acc["at"] + m["gap"]
        found = F.when(m["value"] >= rule.least, F.array_append(acc["out"], F.struct(start.alias("start"), (start + m["length"]).alias("end")))).otherwise(acc["out"])
        return F.struct((start + m["length"]).alias("at"), found.alias("out"))

    steps = F.zip_with(F.arrays_zip(lengths.alias("length"), values.alias("value")), F.slice(gaps, 1, F.size(lengths)), lambda m, gap: F.struct(m["length"].alias("length"), m["value"].alias("value"), gap.alias("gap")))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(text.rlike(rule.pattern), F.aggregate(steps, start, step, lambda acc: acc["out"])).otherwise(none)


class Ledger:
    """The table of scanned pairs in a folder: sha, rule (kind/version), spans."""

    SCHEMA = "sha string, rule string, spans array<struct<start:int,end:int>>"

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}"

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
        """Scan what is unseen, add it to the ledger; returns ``id_col``, sha and found: array of (kind, start, end) by start, then rule order."""
        text = F.coalesce(F.col("text"), F.lit(""))
        versions = docs.select(F.col(id_col), text.alias("text"), F.sha2(text, 256).alias("sha"))
        paths = stored(versions.select(id_col, "sha"))
        wanted = F.array(*[F.lit(r.key) for r in rules])
        blobs = paths.groupBy("sha").agg(F.min(id_col).alias("holder"))
        if self.exists():
            seen = self.rows().groupBy("sha").agg(F.collect_set("rule").alias("seen"))
            blobs = blobs.join(seen, "sha", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
        else:
            blobs = blobs.withColumn("todo", wanted)
        blobs = blobs.select(F.col("sha").alias("b"), "holder", "todo").hint("shuffle_hash")
        unseen = versions.join(blobs, (F.col("sha") == F.col("b")) & F.col(id_col).eqNullSafe(F.col("holder")))
        scans = F.array(*[F.struct(F.lit(r.key).alias("rule"), F.when(F.array_contains("todo", r.key), spans(F.col("text"), r)).alias("spans")) for r in rules])
        unseen.select("sha", F.inline(scans)).where("spans is not null").dropDuplicates(["sha", "rule"]).write.mode("append").parquet(self.path)

        order = {r.key: k for k, r in enumerate(rules)}
        rank = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.lit(order[r.key]))])
        hits = (
            self.rows().where(F.col("rule").isin(*order)).where(F.size("spans") > 0)
            .select("sha", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[F.col("rule")].alias("rank"), F.split_part(F.col("rule"), F.lit("/"), F.lit(1)).alias("kind"), s["end"].alias("end"))).alias("s"))
            .groupBy("sha").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("found"))
        )
        none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
        return paths.join(hits, "sha", "left").withColumn("found", F.coalesce("found", none))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base rules, the SHA-256 of their spans, and all spans."""
    base = [r.kind for r in BASE]
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *map(count, base), F.sha2(text(F.filter("found", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def oracle() -> str:
    """DuckDB SQL for :func:`digest` over ``documents``."""
    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        # A trailing sentinel keeps the last gap; matches and gaps alternate.
        parts.append(f"""SELECT t, {k} AS rank, '{r.kind}' AS kind, st AS s, st + ml AS e FROM (
          SELECT t, unnest(list_transform(range(1, len(m) + 1), lambda i: (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT)) AS st,
            unnest(list_transform(m, lambda x: length(x))) AS ml, unnest(list_transform(v, lambda x: length(x))) AS vl
          FROM (SELECT t, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {r.group}) AS v, string_split_regex(t, '{p}') AS g FROM b) WHERE len(m) > 0) WHERE vl >= {r.least}""")
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank){}, '')"
    base = listed.format(f" FILTER (rank < {len(BASE)})")
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    none = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), b AS (SELECT DISTINCT t FROM d),
    f AS ({" UNION ALL ".join(parts)}),
    x AS (SELECT t, {counts}, {base} AS base, {listed.format("")} AS spans FROM f GROUP BY t)
    SELECT doc_id, {none}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x USING (t)"""
