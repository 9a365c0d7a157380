"""Exact n-gram Jaccard join: components of documents whose shingle sets are alike.

1. Equal sets become one class, known by a 128-bit fingerprint and represented
   by the smallest doc_id.  Later steps see classes only, so a group of exact
   copies costs one row.
2. A sketch of fixed size (2^20 counters, summed over partitions) estimates how
   frequent each shingle is.  Shingles are ordered rare first by the sketch (in
   logarithmic steps, which no corpus exhausts), then by hash; any order is exact,
   a good one is fast.
3. The prefix of a set of size n has n - ceil(t n) + 1 shingles: two alike sets
   share one of theirs (prefix filter).  Each prefix shingle that occurs in several
   prefixes is a posting (shingle, document, size, position); a bitmap of these
   shingles keeps the others off the exchange.
4. Star pass: within each shingle's postings everybody is paired with one pivot,
   the document with the most frequent shingles, if length and positional
   filters allow; a pair found under several shingles meets the suffix filter and
   is verified once.  This is linear in the postings, however large the group.
5. Verified pairs give components.  Shingles whose postings are all in one
   component are done.  In the others, pairs across components that pass the
   length, positional and suffix filter (a 1024-bit parity sketch of each set: its
   Hamming distance never exceeds the symmetric difference) are verified too.
   What is not paired lies in one component already, so the components are exact.
6. On request (``links=True``) each document's links are counted: all pairs of classes
   within a component are compared, by tiles of ``TILE_BYTES`` of sets, and a class
   weighs as many as its copies.  The work grows with the square of a component's
   classes, the rows with their number of tiles.

No pairs of a group are listed for their own sake, nothing is collected but the
sketch, and no caps apply.  Shingles are compared by 64-bit hashes.

Defined cases: a null or blank text has an empty set and links with nothing;
texts with fewer words than a shingle have one shingle, the whole sequence.  A
doc_id that repeats is one node that links where any of its texts does (so it
may join two groups).  Rows without doc_id link with nothing and have no component.  An empty table gives
no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Words, dropped, fresh, mix, rolling, slices, stored

SKETCH_BITS = 20
#: Bitmaps spare rows that meet nothing the way to a join: 16 bits for each value, within these bounds (as powers of two).
FEWEST_BITS, MOST_BITS = 20, 27
#: A shingle's place in the order: its frequency in this many steps for each doubling, then its hash.
STEPS = 1 << 11
#: 64-bit lanes of the parity sketch.
LANES = 16
_PARITY = [f"s{k}" for k in range(LANES)]
#: The same sketch folded to fewer lanes, to go with each posting.
FOLDED = 4
_FOLDED = [f"f{k}" for k in range(FOLDED)]
PARTS = 16
#: Sets compared at once when links are counted: bytes of shingles, and sets.
TILE_BYTES, TILE_SETS = 4 << 20, 2048
#: Shingles whose columns are multiplied at once.
STRIP = 2048
_SECOND = np.uint64(0xD1B54A32D192ED03)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin."""
    words = Words(texts)
    lengths, starts = words.lengths, words.starts
    tokens = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    ends = starts[1:]
    at = np.flatnonzero(np.arange(len(tokens)) + n <= ends[owner]) if len(tokens) else np.zeros(0, np.int64)
    values, doc = rolling(tokens, n)[at], owner[at]
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    if len(short):
        whole = np.array([rolling(tokens[starts[d] : ends[d]], int(lengths[d]))[0] + np.uint64(lengths[d]) for d in short], np.uint64)
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        values, doc = np.concatenate([values, whole])[order], doc[order]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(lengths)))])
    for a, b in zip(cuts, cuts[1:], strict=False):
        values[a:b].sort()
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[first], np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=len(lengths)))])


def _by_text(reduce, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``reduce`` (a ufunc) over each text's values, 0 where there are none."""
    out = np.zeros(len(starts) - 1, values.dtype)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = reduce.reduceat(values, starts[full])
    return out


def _profile(n: int):
    """Fingerprints of the sets, and at the end of a partition the counters of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        any_row = False
        for batch in slices(batches):
            any_row = True
            values, starts = shingle_sets(batch.column(1), n)
            counts += np.bincount((values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            f1, f2 = (_by_text(np.add, mix(values ^ salt), starts).view(np.int64) for salt in (np.uint64(0), _SECOND))
            none = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts)), pa.array(f1), pa.array(f2), none, pa.nulls(batch.num_rows, pa.binary())], names=["doc_id", "n", "f1", "f2", "part", "counts"])
        if any_row:
            cells = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, PARTS)]
            no = pa.nulls(PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([no, no, no, no, pa.array(range(PARTS), pa.int32()), pa.array(cells, pa.binary())], names=["doc_id", "n", "f1", "f2", "part", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of counters by part, within a partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(zlib.decompress(cell.as_py()), np.uint32).astype(np.uint64)
            sums[part] = np.minimum(sums.get(part, 0) + x, np.uint64(0xFFFFFFFF))
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in sums.values()], pa.binary())], names=["part", "counts"])


def _sketch(cells: DataFrame) -> np.ndarray:
    """All counters: PARTS cells of fixed size come to the driver."""
    summed = cells.repartition(PARTS, "part").mapInArrow(_added, "part int, counts binary")
    counts = np.zeros((PARTS, (1 << SKETCH_BITS) // PARTS), np.uint32)
    for part, cell in summed.collect():
        counts[part] = np.frombuffer(zlib.decompress(bytes(cell)), np.uint32)
    return counts.ravel()


def _prefixes(n: int, num: int, den: int, shared):
    """doc_id, n, score, prefix (keys in order), and the parity sketch of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in slices(batches):
            values, starts = shingle_sets(batch.column(1), n)
            sizes = np.diff(starts)
            often = counts[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
            # Keys that clash only add candidates: both prefixes hold the key of the rarest common shingle.
            keys = (np.log2(often + 1.0) * STEPS).astype(np.uint64) << np.uint64(47) | (mix(values) >> np.uint64(17))
            for a, b in zip(starts, starts[1:], strict=False):
                keys[a:b].sort()
            score = _by_text(np.add, often, starts) // np.maximum(sizes, 1).astype(np.uint64)
            taken = np.where(sizes > 0, sizes - -(-num * sizes // den) + 1, 0)
            inside = np.arange(len(keys)) - np.repeat(starts[:-1], sizes) < np.repeat(taken, sizes)
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(taken)]), pa.int32()), pa.array(keys[inside].view(np.int64)))
            bit = (mix(values ^ _SECOND) % np.uint64(64 * LANES)).astype(np.int64)
            odd = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * (64 * LANES) + bit, minlength=len(sizes) * 64 * LANES) & 1
            parity = np.packbits(odd.astype(np.uint8).reshape(len(sizes), -1), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(score.astype(np.int64)), prefix, *map(pa.array, parity.T.copy())], names=["doc_id", "n", "score", "prefix", *_PARITY])

    return run


def _marks(values: np.ndarray, bits: int) -> np.ndarray:
    return (mix(values.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _held(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are marked (others may share a mark)."""
    at = _marks(values, len(bitmap).bit_length() + 2)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _marked(bits: int):
    """The distinct marks of a batch, dealt into PARTS ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.unique(_marks(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits))
            cuts = np.searchsorted(marks, np.arange(1, PARTS) << (bits - 4))
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.astype(np.int32).tobytes() for x in np.split(marks, cuts)], pa.binary())], names=["part", "marks"])

    return run


def _joined(bits: int):
    """The bits of each range, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                into = whole.setdefault(part, np.zeros((1 << bits) // PARTS, bool))
                into[np.frombuffer(cell.as_py(), np.int32) - (part << (bits - 4))] = True
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.int32()), pa.array([zlib.compress(np.packbits(x).tobytes(), 1) for x in whole.values()], pa.binary())], names=["part", "bits"])

    return run


def _bitmap(values: DataFrame, count: int) -> np.ndarray:
    """Marks of all values as packed bits: of bounded size, however many values there are (too many mark everything, and the join that follows drops the rest)."""
    bits = min(MOST_BITS, max(FEWEST_BITS, (16 * count).bit_length()))
    cells = np.zeros((PARTS, (1 << bits) // (8 * PARTS)), np.uint8)
    for part, cell in values.mapInArrow(_marked(bits), "part int, marks binary").repartition(PARTS, "part").mapInArrow(_joined(bits), "part int, bits binary").collect():
        cells[part] = np.frombuffer(zlib.decompress(bytes(cell)), np.uint8)
    return cells.ravel()


def _postings(shared):
    """The keys of prefixes that are marked, each with the document, its size and score, and the position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            lists = batch.column(3)
            keys, lengths = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            at = np.flatnonzero(_held(wanted, keys))
            row = np.repeat(np.arange(len(lengths)), lengths)[at]
            place = at - (np.cumsum(lengths) - lengths)[row]
            of = [batch.column(k).take(pa.array(row)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), of[0], of[1].cast(pa.int32()), pa.array(place.astype(np.int32)), of[2]], names=["key", "id", "n", "pos", "score"])

    return run


def _sets(n: int, shared):
    """The sets of the texts whose ids are marked (a few others may share a mark; joins drop them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in slices(batches):
            batch = batch.filter(pa.array(_held(wanted, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))
            if not batch.num_rows:
                continue
            values, starts = shingle_sets(batch.column(1), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.view(np.int64)))], names=["id", "shingles"])

    return run


def components(links: DataFrame) -> DataFrame:
    """id, label (smallest id of its component) of all ends of ``links`` (a, b)."""
    edges = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    after = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("new")))
    while True:
        last, labels = after, after.select("id", F.col("new").alias("label"))
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("id") == F.col("n"), "left").select("id", "label", F.least("label", "near").alias("new"))
        root = labels.select(F.col("id").alias("r"), F.col("label").alias("root"))
        after = stored(lower.join(root, F.col("new") == F.col("r"), "left").select("id", "label", F.least("new", "root").alias("new")))
        dropped(last)
        if after.where("new <> label").isEmpty():
            dropped(edges)
            return after


def _may_link(n1: Column, i: Column, n2: Column, j: Column, num: int, den: int) -> Column:
    """Length and positional filters, for positions from 0."""
    need = F.ceil((n1 + n2) * num / (den + num))  # exact: whole numbers far below 2^53
    return (n1 * den >= n2 * num) & (n2 * den >= n1 * num) & (F.least(n1 - i, n2 - j) >= need)


def _apart(x, y, lanes: list[str] = _PARITY) -> Column:
    """Lower bound of the symmetric difference; ``x`` and ``y`` give the columns of the two sets."""
    return sum((F.bit_count(x(c).bitwiseXOR(y(c))) for c in lanes), F.lit(0))


def _folded() -> list[Column]:
    return [reduce(lambda a, b: a.bitwiseXOR(b), [F.col(c) for c in _PARITY[k::FOLDED]]).alias(f"f{k}") for k in range(FOLDED)]


def _suffix_filtered(pairs: DataFrame, lead: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose parity sketches let them be alike."""
    sides = [lead.select(F.col("doc_id").alias(e), F.struct("n", *_PARITY).alias(s)).hint("merge") for e, s in ("ax", "by")]
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    return pairs.join(sides[0], "a").join(sides[1], "b").where(_apart(x, y) <= _may_differ(x("n"), y("n"), num, den)).select("a", "b")


def _may_differ(n1: Column, n2: Column, num: int, den: int) -> Column:
    """The largest symmetric difference of two alike sets."""
    return n1 + n2 - 2 * F.ceil((n1 + n2) * num / (den + num))


def _verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    ends = pairs.select(F.col("a").alias("e")).unionAll(pairs.select("b"))
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(ends, 2 * pairs.count()))
    sets = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(_sets(n, shared), "id long, shingles array<long>")
    one, two = (sets.select(F.col("id").alias(e), F.col("shingles").alias(s)).hint("merge") for e, s in ("ax", "by"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * den >= (F.size("x") + F.size("y") - common) * num).select("a", "b").distinct()


def _class_sets(n: int, shared):
    """The sets of the texts whose ids are marked, with the fingerprint of each."""
    sets = _sets(n, shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sets(batches):
            lists = batch.column(1)
            values, starts = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            f1, f2 = (_by_text(np.add, mix(values ^ salt), starts).view(np.int64) for salt in (np.uint64(0), _SECOND))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f1), pa.array(f2), pa.array(np.diff(starts)), lists], names=["id", "s1", "s2", "sn", "shingles"])

    return run


def _alike(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which sets of ``left`` (rows) and ``right`` (columns) are alike."""
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(v) for v in x])) for x in (left, right)]
    both = np.intersect1d(*(v for v, _ in sides))
    inside = []
    for values, owner in sides:
        at = np.minimum(np.searchsorted(both, values), max(0, len(both) - 1))
        held = both[at] == values if len(both) else np.zeros(len(values), bool)
        order = np.argsort(at[held], kind="stable")
        inside.append((at[held][order], owner[held][order]))
    common = np.zeros((len(left), len(right)), np.int64)
    for a in range(0, len(both), STRIP):
        dense = []
        for (at, owner), rows in zip(inside, (len(left), len(right)), strict=True):
            lo, hi = np.searchsorted(at, [a, a + STRIP])
            cells = np.zeros((rows, min(STRIP, len(both) - a)), np.float32)
            cells[owner[lo:hi], at[lo:hi] - a] = 1
            dense.append(cells)
        common += (dense[0] @ dense[1].T).astype(np.int64)
    n1, n2 = (np.array([len(v) for v in x], np.int64) for x in (left, right))
    return common * den >= (n1[:, None] + n2[None, :] - common) * num


def _tile(num: int, den: int):
    """Weights of the alike sets that a tile holds for each of its sets; the components of a tile are apart."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        label, block, weight = (table.column(c).to_numpy() for c in ("label", "block", "weight"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        lists = table.column("shingles").combine_chunks()
        values, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False)
        sets = [values[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        found = np.zeros(len(label), np.int64)
        order = np.argsort(label, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            if lo == hi:
                alike = _alike(*[[sets[r] for r in rows]] * 2, num, den)
                found[rows] = alike @ weight[rows] - weight[rows]
                continue
            left, right = rows[block[rows] == lo], rows[block[rows] == hi]
            if len(left) and len(right):
                alike = _alike([sets[r] for r in left], [sets[r] for r in right], num, den)
                found[left], found[right] = alike @ weight[right], weight[left] @ alike
        return pa.table({"f1": table.column("f1"), "f2": table.column("f2"), "m": table.column("m"), "found": found})

    return run


def _linked(docs: DataFrame, rows: DataFrame, classes: DataFrame, labels: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """g1, g2, gm (a class), copies, found: its different ids, and those of the other classes alike to it."""
    ours = rows.where("n > 0 and doc_id is not null").distinct().groupBy(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("gm")).agg(F.count("*").alias("copies"))
    named = classes.join(labels, F.col("rep") == F.col("id")).select("f1", "f2", "m", "rep", "label")
    spread = named.groupBy("label").agg(F.count("*").alias("c"), F.sum("m").alias("s")).where("c > 1")
    spread = stored(spread.select(F.col("label").alias("l"), F.greatest(F.ceil(F.col("c") / TILE_SETS), F.ceil(8 * F.col("s") / TILE_BYTES)).cast("int").alias("blocks"), F.col("s")))
    small = spread.where("blocks = 1").agg(F.sum("s")).first()[0] or 0
    member = stored(
        named.join(spread, F.col("label") == F.col("l"))
        .join(ours, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("m") == F.col("gm")))
        .select("f1", "f2", "m", "rep", "label", "blocks", F.col("copies").alias("weight"), F.expr("pmod(f1, blocks)").cast("int").alias("block"))
    )
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(member.select("rep"), member.count()))
    sets = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(_class_sets(n, shared), "id long, s1 long, s2 long, sn long, shingles array<long>")
    # A row that repeats an id and a set comes once.
    sets = sets.join(member, (F.col("id") == F.col("rep")) & (F.col("s1") == F.col("f1")) & (F.col("s2") == F.col("f2")) & (F.col("sn") == F.col("m"))).dropDuplicates(["f1", "f2", "m"])
    tiles = (
        sets.withColumn("group", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(max(1, 8 * small // TILE_BYTES)))).otherwise(F.col("label")))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("f1", "f2", "m", "label", "block", "weight", "shingles", "group", (F.col("blocks") > 1).alias("large"), F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"))
    )
    found = tiles.groupBy("large", "group", "lo", "hi").applyInArrow(_tile(num, den), "f1 long, f2 long, m long, found long").groupBy("f1", "f2", "m").agg(F.sum("found").alias("found"))
    return stored(ours.join(found, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("m") == F.col("gm")), "left").select("g1", "g2", "gm", "copies", F.coalesce("found", F.lit(0)).alias("found")))


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id: documents link when den * |intersection| >= num * |union|; with ``links`` also n_links, the alike texts of other ids (of each id, each different set) for this row's text."""
    counted = links
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    profile = stored(docs.mapInArrow(_profile(n), "doc_id long, n long, f1 long, f2 long, part int, counts binary"))
    rows = profile.where("part is null").select("doc_id", "n", "f1", "f2")
    classes = stored(rows.where("n > 0 and doc_id is not null").groupBy("f1", "f2", F.col("n").alias("m")).agg(F.min("doc_id").alias("rep")))
    shared = spark.sparkContext.broadcast(_sketch(profile.where("part is not null").select("part", "counts")))

    reps = classes.select(F.col("rep").alias("r")).distinct()
    lead = stored(docs.mapInArrow(_prefixes(n, num, den, shared), f"doc_id long, n long, score long, prefix array<long>, {', '.join(f'{c} long' for c in _PARITY)}").where("n > 0").join(reps, F.col("doc_id") == F.col("r"), "left_semi"))
    signs = stored(lead.drop("prefix", "score"))
    keys = stored(lead.select(F.explode("prefix").alias("k")).groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k"))
    marked = spark.sparkContext.broadcast(_bitmap(keys, keys.count()))
    postings = lead.select("doc_id", "n", "score", "prefix").mapInArrow(_postings(marked), "key long, id long, n int, pos int, score long")
    members = stored(postings.join(keys, F.col("key") == F.col("k"), "left_semi"))
    dropped(lead, keys)

    pivots = members.groupBy(F.col("key").alias("k")).agg(F.min(F.struct((-F.col("score")).alias("s"), "id", "n", "pos")).alias("p"))
    star = members.join(pivots, (F.col("key") == F.col("k")) & (F.col("id") != F.col("p.id")) & _may_link(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos"), num, den))
    pairs = stored(_suffix_filtered(star.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct(), signs, num, den))
    # A doc_id that repeats with other texts is one node: it joins what its texts are alike to.
    several = rows.where("n > 0 and doc_id is not null").distinct().withColumn("texts", F.count("*").over(Window.partitionBy("doc_id"))).where("texts > 1")
    bridges = several.join(classes, ["f1", "f2"]).where("n = m and doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = stored(_verified(pairs, docs, n, num, den).unionAll(bridges).distinct())
    labels = components(links)

    open_rows = stored(members.join(labels.select(F.col("id").alias("l"), F.col("new").alias("label")), F.col("id") == F.col("l"), "left").select("key", "id", "n", "pos", F.coalesce("label", "id").alias("label")))
    dropped(members)
    open_keys = open_rows.groupBy(F.col("key").alias("k")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("k")
    signed = signs.select(F.col("doc_id").alias("l"), *_folded())
    rest = stored(open_rows.join(open_keys, F.col("key") == F.col("k"), "left_semi").join(signed, F.col("id") == F.col("l")).drop("l"))
    dropped(open_rows)
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    apart = _apart(x, y, _FOLDED) <= _may_differ(x("n"), y("n"), num, den)
    across = rest.alias("x").join(rest.alias("y"), (x("key") == y("key")) & (x("id") < y("id")) & (x("label") != y("label")) & _may_link(x("n"), x("pos"), y("n"), y("pos"), num, den) & apart)
    tried = pairs.select(F.col("a").alias("pa"), F.col("b").alias("pb"))
    untried = across.select(x("id").alias("a"), y("id").alias("b")).distinct().join(tried, (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb")), "left_anti")
    more = stored(_suffix_filtered(untried, signs, num, den))
    dropped(rest, pairs, signs)
    if not more.isEmpty():
        found = stored(_verified(more, docs, n, num, den))
        if not found.isEmpty():
            dropped(labels)
            labels = components(links.unionAll(found))
        dropped(found)
    dropped(more, links)
    labels = labels.select("id", F.col("new").alias("label"))

    named = classes.join(labels, F.col("rep") == F.col("id"), "left").select("f1", "f2", "m", F.coalesce("label", "rep").alias("component_id"))
    out = (
        rows.join(named, (rows.f1 == named.f1) & (rows.f2 == named.f2) & (rows.n == named.m), "left")
        .select("doc_id", rows.f1, rows.f2, F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    )
    if not counted:
        return out.drop("f1", "f2")
    of = _linked(docs, rows, classes, labels, n, num, den)
    return (
        out.join(of, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n_shingles") == F.col("gm")), "left")
        .select("doc_id", "n_shingles", "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("copies") - 1 + F.col("found"), F.lit(0))).alias("n_links"))
    )


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The row with the smallest doc_id of each component, all columns; rows without doc_id stay, of rows that repeat a doc_id one."""
    found = stored(near_duplicates(docs, n, num, den))
    of, place = fresh(docs.columns, "of", "place")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(of)).distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col(of), "left_anti")
    repeated = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(of)).agg(F.count("*").alias(place)).where(F.col(place) > 1).select(of)
    if repeated.isEmpty():
        return kept
    first = Window.partitionBy("doc_id").orderBy("text")
    one = kept.join(repeated, F.col("doc_id") == F.col(of), "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return kept.join(repeated, F.col("doc_id") == F.col(of), "left_anti").unionAll(one)
