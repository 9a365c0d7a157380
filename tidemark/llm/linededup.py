"""Line dedup over overlapping three-line windows.

Every three consecutive lines (without white space around them) form a window
with a 128-bit hash.  Windows that occur more than once anywhere are repeated;
the occurrence in the smallest document, at its smallest position, stays.  All
lines covered by a later occurrence go, the covered positions of a document being
merged.  A document of one or two lines is one window of all its lines, which is
compared with other documents of as many lines.

A document is a (doc_id, text); the order is by doc_id, then by a hash of the
text, then by position.  Windows are hashed once and written to the shared
folder; only hashes and positions are exchanged for the search.  Counting combines
on the map side, and a window that a third of all documents hold is a skewed join
key that adaptive execution splits.  The texts move once, to meet their positions.

Defined cases: windows of blank lines only don't count.  Null texts and rows
without doc_id stay as they are.  A later occurrence that overlaps the first one
in the same document gives up only lines after it, so a run of equal lines keeps
three.  Rows that repeat a doc_id and its text are one document and are treated
alike; with another text they are another document.  An empty table gives no
rows.  Columns named n_lines and n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, stored

WINDOW = 3


def _text_key() -> Column:
    """A number that tells texts of one doc_id apart: 60 bits of a hash that other engines have too."""
    return F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 15), 16, 10).cast("long")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the remaining lines as text, and n_lines, n_removed (long)."""
    docs = docs.drop("n_lines", "n_removed")
    of, of_text, key, gone = fresh([*docs.columns, "n_lines", "n_removed"], "of", "of_text", "key", "gone")
    clean = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))
    starts = F.sequence(F.lit(1), F.greatest(F.size("l") - (WINDOW - 1), F.lit(1)))

    def window(i):
        lines = F.slice("l", i, WINDOW)
        # An array's lengths are hashed by its values alone; the separator keeps line ends apart.
        joined = F.array_join(lines, "\n")
        return F.struct((i - 1).alias("pos"), F.xxhash64(joined).alias("h1"), F.xxhash64(F.lit(11), joined).alias("h2"), (F.concat_ws("", lines) == "").alias("blank"))

    found = stored(
        docs.where("doc_id is not null and text is not null")
        .select("doc_id", _text_key().alias("key"), clean.alias("l"))
        .select("doc_id", "key", F.least(F.size("l"), F.lit(WINDOW)).alias("n"), F.inline(F.transform(starts, window)))
        .where("not blank").drop("blank")
    )
    firsts = found.groupBy("h1", "h2", "n").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "key", "pos")).alias("first")).where("c > 1")
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    later = (
        found.join(firsts, ["h1", "h2", "n"])
        .where(~same | (F.col("pos") != F.col("first.pos")))
        .withColumn("from", F.when(same, F.greatest("pos", F.col("first.pos") + F.col("n"))).otherwise(F.col("pos")))
        .where(F.col("from") < F.col("pos") + F.col("n"))
    )
    covered = later.groupBy(F.col("doc_id").alias(of), F.col("key").alias(of_text)).agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("from", F.col("pos") + F.col("n") - 1)))).alias(gone))
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    return (
        docs.withColumn(key, _text_key())
        .join(covered, (F.col("doc_id") == F.col(of)) & (F.col(key) == F.col(of_text)), "left")
        .withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
        .withColumn("n_removed", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
        .withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")))
        .drop(of, of_text, key, gone)
    )


ORACLE = """
WITH l AS (SELECT row_number() OVER () AS r, doc_id, text, ('0x' || md5(text)[1:15])::BIGINT AS key, string_split(text, chr(10)) AS lines FROM documents),
v AS (SELECT DISTINCT doc_id, key, lines FROM l WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, key, least(len(lines), 3) AS n, unnest(range(greatest(len(lines) - 2, 1))) AS pos, list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS c FROM v),
k AS (SELECT doc_id, key, n, pos, array_to_string(c[pos + 1:pos + n], chr(10)) AS win FROM w WHERE array_to_string(c[pos + 1:pos + n], '') <> ''),
o AS (SELECT *, count(*) OVER (PARTITION BY win, n) AS times, first_value(doc_id) OVER f AS fd, first_value(key) OVER f AS fk, first_value(pos) OVER f AS fp FROM k WINDOW f AS (PARTITION BY win, n ORDER BY doc_id, key, pos)),
g AS (SELECT doc_id, key, list(DISTINCT p) AS gone FROM (
  SELECT doc_id, key, unnest(range(CASE WHEN doc_id = fd AND key = fk THEN greatest(pos, fp + n) ELSE pos END, pos + n)) AS p FROM o WHERE times > 1 AND NOT (doc_id = fd AND key = fk AND pos = fp)) GROUP BY doc_id, key)
SELECT l.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(len(lines)), lambda i: NOT list_contains(gone, i)), lambda i: lines[i + 1]), chr(10)) END AS text
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.key = g.key
"""
