"""Quotation linking: conversations without quotes, each message with the one it answers.

A line's quote level is the number of ``>`` marks before its text.  Consecutive
lines of one level form a passage.  Quoted passages (level 1 and deeper) are
normalised (marks off, white space collapsed, lower-cased), hashed, and joined to
the messages of the same conversation whose own words hold the passage as their
whole own text, a paragraph, a line, or as many lines in a row as the passage has
(blank lines aside), so that a part of a paragraph or several paragraphs link too.
A message answers the latest earlier message that its shallowest linked passage
matches; without a link, the message before it.  A part of a line, or lines
wrapped anew, link nothing.  What remains of a message are its own lines, without
quotes and without the line that announces one ("... wrote:").

A conversation's order is by turn, which puts every answer after what it answers.
Positions, the message before, and the last holder of a passage before a quote come
from two levels: turns are dealt into buckets of ``BUCKET`` turns, sorted each for
itself, and then the far shorter list of buckets; so a conversation that holds a
third of all rows isn't sorted in one task.  A passage that many messages hold and
many quote never makes pairs of them: each (passage, turn) looks up one holder.

Defined cases: rows of null conv_id form one conversation; a null turn comes
first, holds nothing for others and links by order only; rows that repeat a turn are
ordered by role and text and don't answer each other by quotes, only by order.  A
null text stays null and has no quotes; a text of quotes only becomes empty.  A
passage of white space only links nothing.  Time for a text grows with its lines
(times the different lengths, in lines, of the passages that its conversation
quotes).  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1024
_MARKS = r"^[ \t]*((?:>[ \t]?)*)"
_ANNOUNCES = r"(?i)^[^\n]*\b(wrote|writes|schrieb|escribió|a écrit)\s*:\s*$"


def _lines(text: Column) -> Column:
    """Array of struct(level, words) of the lines."""
    return F.transform(
        F.split(text, "\r?\n"),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS, "").alias("words"), x.alias("raw")),
    )


def _normal(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"\s+", " ")))


def _passages(lines: Column) -> Column:
    """Array of struct(level, text, n): maximal runs of lines of one level, with the number of lines that aren't blank; blank own lines end a run and are in none."""
    level = F.transform(lines, lambda x: F.when((x["level"] == 0) & (F.btrim(x["words"]) == ""), -1).otherwise(x["level"]))
    # Bound as fields of structs, so that each is computed once and not for every line.
    with_levels = F.struct(lines.alias("lines"), level.alias("level"))
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    begins = F.transform(F.array(with_levels), lambda v: F.struct(v["lines"].alias("lines"), v["level"].alias("level"), F.filter(places, lambda i: (i == 0) | (F.get(v["level"], i) != F.get(v["level"], i - 1))).alias("begin")))

    def runs(v):
        def run(at, k):
            until = F.coalesce(F.get(v["begin"], k + 1), F.size(v["level"]))
            inside = F.slice(v["lines"], at + 1, until - at)
            return F.struct(F.get(v["level"], at).alias("level"), F.array_join(F.transform(inside, lambda x: x["words"]), "\n").alias("text"), F.size(F.filter(inside, lambda x: F.btrim(x["words"]) != "")).alias("n"))

        return F.filter(F.transform(v["begin"], run), lambda p: p["level"] >= 0)

    return F.when(F.size(lines) > 0, F.flatten(F.transform(begins, runs))).otherwise(F.array().cast("array<struct<level:int,text:string,n:int>>"))


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(5), text).alias("h2")]


def _last_holders(asked: DataFrame, held: DataFrame) -> DataFrame:
    """``asked`` (conv_id, h1, h2, turn; distinct) with ``source``: the last turn before it among ``held`` (likewise), if any."""
    of = ["conv_id", "h1", "h2"]
    both = asked.withColumn("holds", F.lit(None).cast("long")).unionByName(held.withColumn("holds", F.col("turn").cast("long"))).withColumn("b", F.floor(F.col("turn") / BUCKET))
    own = Window.partitionBy(*of, "b").orderBy(F.col("turn").cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*of).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = both.groupBy(*of, "b").agg(F.max("holds").alias("last")).withColumn("earlier", F.max("last").over(along)).select(*[F.col(c).alias(f"_{c}") for c in (*of, "b")], "earlier")
    inside = both.withColumn("near", F.max("holds").over(own)).where("holds is null")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("b") == F.col("_b"))
    return inside.join(before, same).select(*of, "turn", F.coalesce("near", "earlier").alias("source")).where("source is not null")


def _numbered(rows: DataFrame) -> DataFrame:
    """position (from 1) and previous turn of each row of a conversation, in two levels."""
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.withColumn("_b", F.floor(F.coalesce("turn", F.lit(-1)) / BUCKET))
    own = Window.partitionBy("conv_id", "_b").orderBy(*order)
    rows = rows.withColumn("_n", F.row_number().over(own)).withColumn("_before", F.lag(F.struct("turn")).over(own))
    buckets = rows.groupBy("conv_id", "_b").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    along = Window.partitionBy("conv_id").orderBy("_b")
    buckets = buckets.select(
        F.col("conv_id").alias("_c"), F.col("_b").alias("_d"),
        F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_sum"),
        F.lag("last").over(along).alias("_last"),
    )
    return (
        rows.join(buckets, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_d")))
        .withColumn("position", (F.col("_sum") + F.col("_n")).cast("long"))
        .withColumn("previous_turn", F.when(F.col("_before").isNotNull(), F.col("_before.turn")).otherwise(F.col("_last")))
        .drop("_b", "_n", "_before", "_c", "_d", "_sum", "_last")
    )


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, text (without quotes), parent_turn, link (quote, order or null), n_quoted, max_level."""
    fields = ["conv_id", "turn", "role", "text"]
    rows = messages.select(*fields, F.xxhash64(*fields).alias("k"), F.xxhash64(F.lit(3), *fields).alias("k2"))
    marked = F.coalesce(F.col("text").contains(">"), F.lit(False))  # no other text has quotes, and none is parsed in vain

    def parsed(some: DataFrame) -> DataFrame:
        return some.withColumn("lines", _lines(F.col("text"))).withColumn("passages", _passages(F.col("lines")))

    quoted = (
        parsed(rows.where(marked & F.col("turn").isNotNull()))
        .select("conv_id", "turn", "k", "k2", F.explode(F.filter("passages", lambda p: p["level"] > 0)).alias("p"))
        .select("conv_id", "turn", "k", "k2", F.col("p.level").alias("level"), F.col("p.n").alias("n"), _normal(F.col("p.text")).alias("quote")).where("quote <> ''")
        .select("conv_id", "turn", "k", "k2", "level", "n", *_hashes(F.col("quote"))).distinct()
    )
    # Only conversations that quote at all need their messages' passages; of several lines, those of quoted lengths.
    wanted = quoted.groupBy(F.col("conv_id").alias("_q")).agg(F.collect_set(F.when(F.col("n") > 1, F.col("n"))).alias("lengths"))
    own = F.filter("lines", lambda x: x["level"] == 0)
    words = F.filter(F.transform(own, lambda x: _normal(x["words"])), lambda x: x != "")
    in_a_row = F.transform(F.filter("lengths", lambda n: n <= F.size("words")), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " ")))
    whole = F.transform(F.concat(F.array(F.array_join(F.transform(own, lambda x: x["words"]), "\n")), F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["text"])), _normal)
    held = (
        parsed(rows.where(F.col("turn").isNotNull() & F.col("text").isNotNull()).join(wanted, F.col("conv_id").eqNullSafe(F.col("_q"))))
        .select("conv_id", "turn", "lengths", whole.alias("whole"), words.alias("words"))
        .select("conv_id", "turn", F.explode(F.array_distinct(F.concat("whole", "words", F.flatten(in_a_row)))).alias("x")).where("x <> ''")
        .select("conv_id", "turn", *_hashes(F.col("x"))).distinct()
    )
    found = _last_holders(quoted.select("conv_id", "h1", "h2", "turn").distinct(), held).select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "h1", "h2", "turn")], "source")
    parents = (
        quoted.join(found, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("turn") == F.col("_turn")))
        .groupBy(F.col("k").alias("_k"), F.col("k2").alias("_k2")).agg(F.max(F.struct((-F.col("level")).alias("l"), F.col("source"))).alias("best"))
        .select("_k", "_k2", F.col("best.source").cast(messages.schema["turn"].dataType).alias("quoted_turn"))
    )
    kept = F.filter(F.transform(own, lambda x: x["raw"]), lambda x: ~x.rlike(_ANNOUNCES))
    read = F.struct(
        F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).alias("max_level"),
        F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("long").alias("n_quoted"),
        F.btrim(F.array_join(kept, "\n"), F.lit(" \t\r\n")).alias("text"),
    )
    plain = rows.where(~marked).withColumns({"max_level": F.lit(0), "n_quoted": F.lit(0).cast("long")})
    marks = parsed(rows.where(marked)).withColumn("read", read).withColumns({"max_level": F.col("read.max_level"), "n_quoted": F.col("read.n_quoted"), "text": F.when(F.col("read.max_level") > 0, F.col("read.text")).otherwise(F.col("text"))})
    clean = plain.unionByName(marks.select(*plain.columns))
    return (
        _numbered(clean).join(parents, (F.col("k") == F.col("_k")) & (F.col("k2") == F.col("_k2")), "left")
        .withColumn("parent_turn", F.coalesce("quoted_turn", "previous_turn"))
        .withColumn("link", F.when(F.col("quoted_turn").isNotNull(), "quote").when(F.col("position") > 1, "order"))
        .select("conv_id", "position", "turn", "role", "text", "parent_turn", "link", "n_quoted", "max_level")
    )
