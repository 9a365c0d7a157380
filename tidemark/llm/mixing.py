"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power ``a``, normalised: a = 1 keeps
the natural shares, a = 0 makes them equal.  The exponent is found by repeated
bisection (a 16-way section per pass, which is four bisections at once) over the
table of source totals, which is never collected: each pass is one aggregate
with a fixed number of results.

The weights are realised as budgeted block permutations.  A source's documents
are dealt into shards of about ``SHARD_TOKENS`` tokens (and at most ``SHARD_ROWS``
rows, so that blank texts are dealt too) by a hash of doc_id, or of the text where
there is no doc_id; a source with a third of all rows has a third of all shards.
Within a shard every epoch has its own permutation.  A document stands at
(epoch + share of the shard's tokens before its middle) of its source's passes;
documents below the passes that the budget allows are emitted, and the position
in proportion gives the output block.  So each output block holds each source in
its weight, and each shard meets its part of the budget to within half a document.

Hashes are the first 60 bits of MD5, which other engines have too.

Defined cases: null is a source like any other; rows without doc_id are dealt by
their texts; repeated rows are separate documents; documents without words
cost nothing and are emitted as often as their neighbours; sources without any
words have no share and are left out; an empty table gives no rows.  Columns
named as the result's own (epoch, block, order_key, n_tokens) are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, n_tokens, stored

SHARD_TOKENS = 1 << 18
#: Rows that a shard takes on average at most, however few tokens they have.
SHARD_ROWS = 1 << 16
BLOCK_TOKENS = 1 << 20
ADDED = ["n_tokens", "epoch", "block", "order_key"]


def exponent(shares: DataFrame, ratio: float, target_entropy: float | None, max_repeats: float | None, tolerance: float = 1e-9) -> float:
    """The largest exponent at which the entropy reaches its target, raised until no source repeats too often.

    ``shares`` has a column ``share`` (positive, sum 1); ``ratio`` is budget / tokens;
    ``target_entropy`` is a part of the largest entropy, log(number of sources).
    Targets out of reach give the nearest end of [0, 1].
    """

    def at(exponents: list[float]) -> list[tuple[float, float]]:
        log = F.log("share")
        sums = [x for a in exponents for x in (F.sum(F.exp(log * a)), F.sum(F.exp(log * a) * log), F.max(F.exp(log * (a - 1))))]
        *got, n = shares.agg(*[x.alias(f"x{k}") for k, x in enumerate(sums)], F.count("*")).first()
        full = math.log(n) if n > 1 else 1.0
        return [((math.log(z) - a * s / z) / full, ratio * m / z) for a, z, s, m in zip(exponents, got[::3], got[1::3], got[2::3], strict=True)]

    def search(ok) -> float:
        """The largest exponent in [0, 1] for which ``ok`` holds, which holds below it; 0 if none."""
        low, high = 0.0, 1.0
        if ok(*at([high])[0]):
            return high
        while high - low > tolerance:
            grid = [low + (high - low) * k / 16 for k in range(1, 16)]
            good = [ok(*x) for x in at(grid)]
            first = good.index(False) if False in good else 15
            low, high = ([low, *grid][first], [*grid, high][first])
        return low

    a = 1.0 if target_entropy is None else search(lambda h, _: h >= target_entropy)
    if max_repeats is not None:
        a = max(a, 0.0 if at([0.0])[0][1] <= max_repeats else search(lambda _, r: r > max_repeats) + tolerance)
    return min(1.0, a)


def weights(docs: DataFrame, budget: int | None = None, target_entropy: float | None = 0.98, max_repeats: float | None = 4.0) -> DataFrame:
    """source, tokens, share, weight, passes and shards; ``budget`` is in tokens, all tokens by default."""
    totals = stored(docs.select("source", n_tokens(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")).where("tokens > 0"))
    total = totals.agg(F.sum("tokens")).first()[0]
    if not total:
        return totals.selectExpr("*", "0D share", "0D weight", "0D passes", "1L shards", "1L blocks")
    budget = total if budget is None else budget
    shares = totals.withColumn("share", F.col("tokens") / F.lit(float(total)))
    a = exponent(shares, budget / total, target_entropy, max_repeats)
    z = shares.agg(F.sum(F.pow("share", F.lit(a)))).first()[0]
    return (
        shares.withColumn("weight", F.pow("share", F.lit(a)) / z)
        # Rounded, so that a cap of whole passes is met exactly however the exponent was found.
        .withColumn("passes", F.round(F.col("weight") * float(budget) / F.col("tokens"), 6))
        .withColumn("shards", F.greatest(F.ceil(F.col("tokens") / SHARD_TOKENS), F.ceil(F.col("docs") / SHARD_ROWS)))
        .withColumn("blocks", F.lit(max(1, round(budget / BLOCK_TOKENS))).cast("long"))
    )


def _hash(*parts: Column | int) -> Column:
    """60 bits of the parts, which are separated by colons."""
    text = F.concat_ws(":", *[F.lit(str(p)) if isinstance(p, int) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def mix_sources(docs: DataFrame, budget: int | None = None, target_entropy: float | None = 0.98, max_repeats: float | None = 4.0, seed: int = 7) -> DataFrame:
    """All columns of ``docs``, with n_tokens, epoch (from 0), block and order_key: sort by (block, order_key) for the mixture."""
    docs = docs.drop(*ADDED)
    of, passes, shards, blocks, shard, at, name = fresh([*docs.columns, *ADDED], "of", "passes", "shards", "blocks", "shard", "at", "name")
    plan = weights(docs.select("source", "text"), budget, target_entropy, max_repeats).select(*[F.col(c).alias(a) for c, a in (("source", of), ("passes", passes), ("shards", shards), ("blocks", blocks))])
    dealt = (
        docs.withColumn("n_tokens", n_tokens(F.col("text")))
        .join(plan, F.col("source").eqNullSafe(F.col(of)))
        .withColumn(name, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")).cast("binary")))))
        .withColumn(shard, F.pmod(_hash(seed, F.col(name)), F.col(shards)))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(passes).cast("int") - 1, F.lit(0)))))
        .withColumn("order_key", _hash(seed + 1, F.col("epoch"), F.col(name)))
    )
    whole = Window.partitionBy(of, shard, "epoch")
    ordered = whole.orderBy("order_key", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    middle = (F.sum("n_tokens").over(ordered) - F.col("n_tokens") / 2) / F.greatest(F.sum("n_tokens").over(whole), F.lit(1))
    return (
        dealt.withColumn(at, F.col("epoch") + middle)
        .where(F.col(at) < F.col(passes))
        .withColumn("block", F.least(F.floor(F.col(at) / F.col(passes) * F.col(blocks)), F.col(blocks) - 1))
        .select(*docs.columns, *ADDED)
    )
