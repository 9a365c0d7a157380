"""URL filters: allow and block rules, and a ratio of character language models for the rest, in DataFrame operations only.

The longest rule that fits decides.  URLs that rules accept or reject also train
two variable-order Markov models over characters: the probability of a character
after four others, smoothed towards the one after three, two, one and none.  The
two models are tables over distinct five-character grams, so the text of a URL
meets them in one join; the counts of shorter contexts are sums over that table.
A URL's score is the mean over its characters of the difference of the two
log-likelihoods; the cut-off is calibrated on every fifth URL with a rule, which
trains nothing, where the mean of both classes' error rates is lowest.

Defined cases: a null URL is empty; no ``://``: host and path are empty and no
rule fits; empty URLs are judged by their end alone.  Repeated rows are judged
alike (a sum over n equal URLs, divided by n times the length).  Without rules
that decide anything the models are equal and the cut-off is 0, which allows all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, stored

# The rules of the query (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

ORDER = 4
#: Weight of the shorter context, in characters seen.
PRIOR = 4.0
BIN = 0.01
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """Lower-cased host, and path, of a URL."""
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, _URL, 1)), F.regexp_extract(url, _URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def _grams(text: Column) -> Column:
    """The runs of ORDER + 1 characters that end at each character and at the text's end."""
    chars = F.split(F.concat(F.lit("\x02" * ORDER), text, F.lit("\x03")), "")
    return F.transform(F.sequence(F.lit(1), F.size(chars) - ORDER), lambda i: F.array_join(F.slice(chars, i, ORDER + 1), ""))


def models(grams: DataFrame) -> DataFrame:
    """gram, diff: log-likelihood ratio of its last character after the others; ``grams`` has gram, a, r (counts)."""
    chars = grams.select(F.expr("right(gram, 1)").alias("g"), "a", "r").groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    n, a, r = chars.agg(F.count("*"), F.sum("a"), F.sum("r")).first()
    below = chars.select("g", *[((F.col(x) + 1) / F.lit(float((t or 0) + (n or 0) + 1))).alias(f"p{x}") for x, t in (("a", a), ("r", r))])
    for k in range(1, ORDER + 1):
        level = grams.select(F.expr(f"right(gram, {k + 1})").alias("g"), "a", "r").groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        before = level.groupBy(F.expr(f"left(g, {k})").alias("h")).agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
        shorter = below.select(F.col("g").alias("s"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        below = (
            level.join(before, F.expr(f"left(g, {k}) = h")).join(shorter, F.expr(f"right(g, {k}) = s"))
            .select("g", *[((F.col(x) + PRIOR * F.col(f"q{x}")) / (F.col(f"t{x}") + PRIOR)).alias(f"p{x}") for x in "ar"])
        )
        below = stored(below)
    return below.select(F.col("g").alias("gram"), (F.ln("pa") - F.ln("pr")).alias("diff"))


def cut_off(bins: DataFrame) -> float:
    """Midway between the bins to block and to allow; ``bins`` has bin, a, r (accepted and rejected URLs) and few rows."""
    rows = sorted(bins.collect())
    a, r = sum(x.a for x in rows), sum(x.r for x in rows)
    if not a or not r:
        return 0.0
    best, at, below_a, below_r, last = 2.0, 0.0, 0, 0, rows[0].bin - 1
    for x in rows:
        error = below_a / a + (r - below_r) / r
        if error < best - 1e-12:
            best, at = error, (last + 1 + x.bin) / 2 * BIN
        below_a, below_r, last = below_a + x.a, below_r + x.r, x.bin
    return at


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides)."""
    url = F.coalesce("url", F.lit(""))
    host, path = parts(F.col("url"))
    base = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"), F.xxhash64("page_id", url).alias("k")).withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    held = F.coalesce(F.col("page_id") % 5 == 0, F.lit(False))
    rows = stored(base.select("k", F.col("ruled.verdict").alias("v"), held.alias("held"), F.explode(_grams(F.regexp_replace(lower_ascii(F.col("url")), "^https?://", ""))).alias("gram")))
    counted = stored(rows.groupBy("gram").agg(F.expr("count_if(v = 'allow' and not held)").alias("a"), F.expr("count_if(v = 'block' and not held)").alias("r")))
    scores = stored(
        rows.where("v is null or held").join(models(counted), "gram")
        .groupBy("k").agg((F.sum("diff") / F.count("*")).alias("score"), F.first("v").alias("v"))
        .withColumn("bin", F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.round("score", 9) / BIN))).cast("int"))
    )
    cut = cut_off(scores.where("v is not null").groupBy("bin").agg(F.expr("count_if(v = 'allow')").alias("a"), F.expr("count_if(v = 'block')").alias("r")))
    unruled = scores.where("v is null").select("k", "score")
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(F.round("score", 9) >= cut, "allow").otherwise("block"))
    return base.join(unruled, "k", "left").select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), "score")
