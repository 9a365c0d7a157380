"""Scoring by a hidden Markov language model.

A word is a symbol if it is among the ``TOP`` most frequent training words; any
other belongs to one of ``CLASSES`` symbols by its last three characters.  States
emit symbols; a class emits a word with the smoothed relative frequency that the
word has in its class, (c + 1) / (N_class + V_class + 1), which leaves room for one
unknown word per class.  A text is its words and one end, so its probability is
that of a complete sequence, summed over all state paths by the scaled forward
recursion.

Word counts cover every training text: hashes of words with counts are summed
over partitions.  Training texts are then written as symbols once.  Baum-Welch
starts from all of them too: the principal directions of their shares of the
``NEAR`` most frequent symbols (from sums over the corpus) divide the texts by the
sides on which they lie, a state for each combination, and a state emits what its
texts hold.  Each of ``PASSES`` passes then runs forward and backward over all
training texts, whole, and adds up the expected counts of partitions.  These tables
are of fixed size; they are summed in ``PARTS`` pieces, and only the sums come to the
driver.

Forward and backward take runs of ``RUN`` symbols side by side, so that one long text
doesn't hold its task up.  What enters and leaves a run of a longer text is exact:
the products of the steps of each run, multiplied along the text.

Counts of the most frequent words, at most ``KNOWN``, travel to the workers (a table
of counts of counts tells from which count on); the counts of all other words meet
the texts in a join on the word's hash.

Defined cases: null and blank texts are the end alone.  A null doc_id trains (its
row isn't held out).  Rows that repeat a doc_id are scored each for itself.
Without training texts every count is 0 and all symbols are alike.  An empty
table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Words, dropped, hash_strings, slices, stored

TOP, CLASSES, KNOWN = 6144, 2047, 65536
SYMBOLS = TOP + CLASSES + 1  # the last is the end
STATES = 8
PASSES = 3
RUN = 1024
PARTS = 8
#: Symbols whose shares of a text decide where training puts it at first, and texts handled at once for that.
NEAR, TEXTS = 512, 4096
#: How likely a state stays at first.
STAY = 0.95
#: Bytes of symbols handled at once.
SYMBOL_BYTES = 1 << 20
PRIOR = 50.0


class Model:
    """Start, transition and emission probabilities; float32, emissions by symbol."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = (x.astype(np.float32) for x in (start, move, emit))

    @staticmethod
    def of(counts: list[np.ndarray], base: np.ndarray) -> Model:
        """From expected counts of starts, moves and emissions (symbols by states); ``base`` smooths the emissions."""
        start, move, emit = counts
        emit = (emit + PRIOR * base[:, None]) / (emit.sum(0) + PRIOR)
        return Model((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(1, keepdims=True), emit)


def _by_time(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences from long to short, positions in order of time (then of that order), and where each time begins."""
    order = np.argsort(-lengths, kind="stable")
    ends = np.sort(lengths)
    active = len(ends) - np.searchsorted(ends, np.arange(ends[-1] if len(ends) else 0), side="right")
    begins = np.concatenate([[0], np.cumsum(active)])
    time = np.repeat(np.arange(len(active)), active)
    rank = np.arange(begins[-1]) - begins[time]
    return order, starts[order][rank] + time, begins


def _forward(model: Model, symbols: np.ndarray, begins: np.ndarray, enter: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities and scales, both in order of time; ``enter``: what each sequence begins with, if not the model's start."""
    alpha = model.emit[symbols]
    scale = np.empty(len(symbols), np.float32)
    before = None
    for a, b in zip(begins, begins[1:], strict=False):
        now = alpha[a:b]
        now *= (model.start if enter is None else enter) if before is None else before[: b - a] @ model.move
        scale[a:b] = s = now.sum(1)
        now /= s[:, None]
        before = now
    return alpha, scale


def log_likelihoods(model: Model, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each whole sequence of symbols."""
    order, at, begins = _by_time(starts, lengths)
    _, scale = _forward(model, symbols[at], begins)
    rank = np.arange(len(at)) - np.repeat(begins[:-1], np.diff(begins))
    out = np.zeros(len(lengths))
    out[order] = np.bincount(rank, np.log10(scale, dtype=np.float64), len(lengths))
    return out


def _runs(lengths: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of runs of at most ``run`` symbols, and the place of each in its text."""
    n = -(-lengths // run)
    text = np.repeat(np.arange(len(lengths)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][text] + place * run
    return starts, np.minimum(run, lengths[text] - place * run), place


def _products(model: Model, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each run the product of its steps (from the state before it to its last), each scaled to sum 1."""
    states = len(model.start)
    order, at, begins = _by_time(starts, lengths)
    emit = model.emit[symbols[at]]
    out = np.tile(np.eye(states, dtype=np.float32), (len(lengths), 1, 1))
    for a, b in zip(begins, begins[1:], strict=False):
        now = (out[: b - a] @ model.move) * emit[a:b, None, :]
        out[: b - a] = now / now.sum((1, 2), keepdims=True)
    back = np.empty_like(out)
    back[order] = out
    return back.astype(np.float64)


def _borders(model: Model, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By run: the states before it (for runs that go on), what it begins with, and the backward probabilities at its end."""
    states, n = len(model.start), len(lengths)
    before, enter, leave = np.zeros((n, states)), np.tile(model.start.astype(np.float64), (n, 1)), np.ones((n, states))
    on = np.flatnonzero(place > 0)
    if not len(on):
        return before, enter, leave
    product = np.empty((n, states, states))
    product[on] = _products(model, symbols, starts[on], lengths[on])
    heads = on[place[on] == 1] - 1
    order, at, begins = _by_time(starts[heads], lengths[heads])
    alpha, _ = _forward(model, symbols[at], begins)
    ends = np.zeros((n, states))
    ends[heads[order]] = alpha[begins[lengths[heads][order] - 1] + np.arange(len(heads))]
    for k in range(1, place.max() + 1):  # all texts that have a k-th run
        runs = np.flatnonzero(place == k)
        before[runs] = ends[runs - 1]
        enter[runs] = ends[runs - 1] @ model.move
        now = np.einsum("rs,rst->rt", ends[runs - 1], product[runs])
        ends[runs] = now / now.sum(1, keepdims=True)
    for k in range(place.max(), 0, -1):
        runs = np.flatnonzero(place == k)
        now = np.einsum("rst,rt->rs", product[runs], leave[runs])
        leave[runs - 1] = now / (ends[runs - 1] * now).sum(1, keepdims=True)
    return before, enter, leave


def expected_counts(model: Model, symbols: np.ndarray, lengths: np.ndarray, run: int = RUN) -> list[np.ndarray]:
    """Baum-Welch counts of starts, moves and emissions over whole texts, which stand one after another in ``symbols``."""
    states = len(model.start)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((len(model.emit), states))
    if not len(lengths):
        return [start, move, emit]
    starts, sizes, place = _runs(lengths, run)
    order, at, begins = _by_time(starts, sizes)
    before, enter, leave = (x[order].astype(np.float32) for x in _borders(model, symbols, starts, sizes, place))
    seen = symbols[at]
    gamma, scale = _forward(model, seen, begins, enter)
    after = None
    for t in range(len(begins) - 2, -1, -1):
        a, b = begins[t], begins[t + 1]
        beta = leave[: b - a].copy()
        if after is not None:
            moved = model.emit[seen[b : b + len(after)]] * after / scale[b : b + len(after), None]
            move += model.move * (gamma[a : a + len(after)].T @ moved)
            beta[: len(after)] = moved @ model.move.T
        after = beta
        gamma[a:b] *= beta  # alpha of this time is no longer needed
    first = place[order] == 0
    moved = model.emit[seen[: begins[1]]] * after / scale[: begins[1], None]
    move += model.move * (before[~first].T @ moved[~first])
    start += gamma[: begins[1]][first].sum(0)
    for k in range(states):
        emit[:, k] = np.bincount(seen, gamma[:, k], len(emit))
    return [start, move, emit]


def _shares(symbols: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Square roots of the shares of the first NEAR symbols, of some texts at a time, and where these stand."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for a in range(0, len(lengths), TEXTS):
        b = min(a + TEXTS, len(lengths))
        part = symbols[ends[a] : ends[b]]
        text = np.repeat(np.arange(b - a), lengths[a:b])[part < NEAR]
        counts = np.bincount(text * NEAR + part[part < NEAR], minlength=(b - a) * NEAR).reshape(b - a, NEAR)
        yield slice(ends[a], ends[b]), np.sqrt(counts / np.maximum(counts.sum(1), 1)[:, None])


def moments(symbols: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Number of texts, sum and sum of squares of their shares."""
    sums = [np.zeros(1), np.zeros(NEAR), np.zeros((NEAR, NEAR))]
    for _, x in _shares(symbols, lengths):
        sums = [a + b for a, b in zip(sums, (np.full(1, len(x)), x.sum(0), x.T @ x), strict=True)]
    return sums


def directions(sums: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and as many principal directions as tell ``states`` combinations of sides apart."""
    n, total, squares = sums[0], sums[1 : NEAR + 1], sums[NEAR + 1 :].reshape(NEAR, NEAR)
    mean = total / n
    _, vectors = np.linalg.eigh(squares / n - np.outer(mean, mean))
    return mean, vectors[:, ::-1][:, : max(1, (states - 1).bit_length())]


def divided(mean: np.ndarray, axes: np.ndarray, states: int, symbols: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """How often each state's texts hold each symbol."""
    counts = np.zeros(SYMBOLS * states, np.int64)
    ends = np.cumsum(lengths)
    for at, x in _shares(symbols, lengths):
        state = ((x - mean) @ axes > 0) @ (1 << np.arange(axes.shape[1])) % states
        own = lengths[np.searchsorted(ends, at.start, side="right") :][: len(x)]
        counts += np.bincount(symbols[at] * states + np.repeat(state, own), minlength=len(counts))
    return [counts.astype(np.float64)]


class Lexicon:
    """What workers know of words: the frequent ones (by hash, sorted) with counts, and the sizes of the classes."""

    def __init__(self, known: list[tuple[int, int]], classes: dict[int, tuple[int, int]], total: int, distinct: int, texts: int) -> None:
        known = sorted(known, key=lambda x: (-x[1], x[0]))
        rank = np.arange(len(known))
        hashes, counts = (np.array([x[k] for x in known], np.int64) for k in (0, 1))
        order = np.argsort(hashes)
        self.hashes, self.counts, self.rank = hashes[order], counts[order], rank[order]
        self.total, self.distinct, self.texts = total, distinct, texts
        sizes = np.zeros((CLASSES, 2))
        for k, (n, v) in classes.items():
            sizes[k] = n, v
        symbol = np.zeros(SYMBOLS)
        symbol[: min(TOP, len(known))] = counts[:TOP]
        symbol[TOP:-1] = sizes[:, 0]
        symbol[-1] = texts
        self.room = np.log10(sizes.sum(1) + 1)
        self.base = (symbol + 1) / (symbol + 1).sum()

    def look_up(self, hashes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words, and their counts (-1: to be joined)."""
        if not len(self.hashes):
            return TOP + kinds, np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        top = hit & (self.rank[at] < TOP)
        return np.where(top, self.rank[at], TOP + kinds), np.where(hit, self.counts[at], -1)


def _kinds(vocab: pa.Array) -> np.ndarray:
    """Class of each word by its last three characters."""
    tails = pc.utf8_slice_codeunits(pc.utf8_reverse(vocab), 0, 3).dictionary_encode()
    kinds = (hash_strings(tails.dictionary) % np.uint64(CLASSES)).astype(np.int64)
    return kinds[tails.indices.to_numpy(zero_copy_only=False)] if len(kinds) else np.zeros(0, np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = Words(batch.column(0))
        counts = np.bincount(words.codes, minlength=len(words.vocab))
        yield pa.RecordBatch.from_arrays([pa.array(words.hashes().view(np.int64)), pa.array(_kinds(words.vocab).astype(np.int32)), pa.array(counts)], names=["h", "kind", "c"]).filter(pa.array(counts > 0))


def _symbols(words: Words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, symbol and count by vocabulary; all symbols with the ends put in, and lengths with the end."""
    hashes, kinds = words.hashes().view(np.int64), _kinds(words.vocab)
    symbol, count = lexicon.look_up(hashes, kinds)
    flat = symbol[words.codes] if len(words.codes) else np.zeros(0, np.int64)
    return hashes, symbol, count, np.insert(flat, words.starts[1:], SYMBOLS - 1), words.lengths + 1


def _packed(sums: list[np.ndarray]) -> pa.RecordBatch:
    """Tables of a partition in PARTS pieces."""
    pieces = np.array_split(np.concatenate([x.ravel() for x in sums]), PARTS)
    return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in pieces], pa.binary())], names=["part", "counts"])


def _encoded(shared):
    """Each text's symbols, with the end, as 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            *_, symbols, lengths = _symbols(Words(batch.column(0)), shared.value)
            at = np.concatenate([[0], 2 * np.cumsum(lengths)]).astype(np.int32)
            cells = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(symbols.astype(np.int16).tobytes())])
            yield pa.RecordBatch.from_arrays([cells], names=["symbols"])

    return run


def _summed(encoded: DataFrame, of) -> np.ndarray | None:
    """Sums over all texts of the tables that ``of`` (symbols, lengths) makes of some; None without texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in slices(batches, "symbols", SYMBOL_BYTES):
            cells = batch.column(0)
            lengths = pc.binary_length(cells).to_numpy(zero_copy_only=False).astype(np.int64) // 2
            symbols = np.frombuffer(b"".join(cells.to_pylist()), np.int16).astype(np.int64)
            got = of(symbols, lengths)
            sums = got if sums is None else [x + y for x, y in zip(sums, got, strict=True)]
        if sums is not None:
            yield _packed(sums)

    pieces = encoded.mapInArrow(run, "part int, counts binary").repartition(PARTS, "part").mapInArrow(_added, "part int, counts binary")
    got = dict(pieces.collect())
    return np.concatenate([np.frombuffer(bytes(got[k])) for k in range(PARTS)]) if got else None


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(cell.as_py()))
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])


def lexicon_of(counts: DataFrame, texts: int) -> Lexicon:
    """``counts`` has h, kind, c for every distinct training word."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # Counts below 256 and 32 steps for each doubling above: few steps, whatever the corpus.
    step = F.when(F.col("c") < 256, F.col("c")).otherwise(256 + F.floor(F.log2(F.col("c") / 256) * 32)).cast("long")
    cut, room = 1 << 60, KNOWN
    for x in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        room -= x.n
        if room < 0:
            break
        cut = x.step
    known = [(x.h, x.c) for x in counts.where(step >= cut).select("h", "c").collect()]
    top = sorted(known, key=lambda x: (-x[1], x[0]))[:TOP]
    if len(top) == TOP:
        others = counts.where((F.col("c") < top[-1][1]) | (F.col("c") == top[-1][1]) & (F.col("h") > top[-1][0]))
    else:
        others = counts.where(step < cut)
    classes = {x.kind: (x.n, x.v) for x in others.groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    return Lexicon(known, classes, total + texts, distinct + (texts > 0), texts)


def train(texts: DataFrame, lexicon: Lexicon, states: int = STATES, passes: int = PASSES) -> Model:
    """Baum-Welch over all rows of ``texts`` (column text)."""
    context = texts.sparkSession.sparkContext
    stay = (1 - STAY) / states + np.eye(states) * STAY
    encoded = stored(texts.mapInArrow(_encoded(context.broadcast(lexicon)), "symbols binary"))
    sums = _summed(encoded, moments)
    if sums is None:
        dropped(encoded)
        return Model(np.full(states, 1 / states), stay, np.tile(lexicon.base[:, None], (1, states)))
    mean, axes = directions(sums, states)
    emit = _summed(encoded, lambda symbols, lengths: divided(mean, axes, states, symbols, lengths)).reshape(SYMBOLS, states)
    model = Model.of([np.zeros(states), np.zeros((states, states)), emit], lexicon.base)
    model.move = stay.astype(np.float32)
    for _ in range(passes):
        shared = context.broadcast(model)
        flat = _summed(encoded, lambda symbols, lengths, shared=shared: expected_counts(shared.value, symbols, lengths))
        start, move, emit = np.split(flat, [states, states + states**2])
        model = Model.of([start, move.reshape(states, states), emit.reshape(SYMBOLS, states)], lexicon.base)
    dropped(encoded)
    return model


def _score(shared):
    """A row for each text, then one for each of its words whose count is to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lexicon = shared.value
        for batch in slices(batches):
            n = batch.num_rows
            words = Words(batch.column(1))
            hashes, symbol, count, symbols, lengths = _symbols(words, lexicon)
            likely = log_likelihoods(model, symbols, np.cumsum(lengths) - lengths, lengths)
            owner = np.repeat(np.arange(n), words.lengths)
            logs = np.log10(np.maximum(count, 0) + 1.0)
            in_class = symbol >= TOP
            known, local, inside = (np.zeros(n) for _ in range(3))
            if len(owner):
                known = np.bincount(owner, (count > 0)[words.codes], n)
                local = np.bincount(owner, logs[words.codes], n)
                room = lexicon.room[np.where(in_class, symbol - TOP, 0)]
                inside = np.bincount(owner, np.where(in_class, logs - room, 0.0)[words.codes], n)
            end = math.log10(lexicon.texts + 1)
            key = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [key, pa.nulls(n, pa.int64()), pa.array(lengths), pa.array((known + (lexicon.texts > 0)).astype(np.int64)), pa.array(local + end), pa.array(likely + inside)],
                names=["row", "h", "n", "known", "base", "score"],
            )
            rare = np.flatnonzero((count < 0)[words.codes]) if len(owner) else np.zeros(0, np.int64)
            if len(rare):
                pairs, times = np.unique(owner[rare] * len(hashes) + words.codes[rare], return_counts=True)
                none = pa.nulls(len(pairs), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [key.take(pa.array(pairs // len(hashes))), pa.array(hashes[pairs % len(hashes)]), pa.array(times), pa.nulls(len(pairs), pa.int64()), none, none],
                    names=["row", "h", "n", "known", "base", "score"],
                )

    return run


def score_texts(docs: DataFrame, held_out: Column, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; rows that aren't held out train."""
    docs = docs.select("doc_id", F.col("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = docs.where("not held_out").select("text")
    counts = stored(training.mapInArrow(_count_words, "h long, kind int, c long").groupBy("h", "kind").agg(F.sum("c").alias("c")))
    lexicon = lexicon_of(counts, training.count())
    model = train(training, lexicon, passes=passes)
    shared = docs.sparkSession.sparkContext.broadcast((model, lexicon))
    rows = docs.select(F.struct("doc_id", "held_out", F.monotonically_increasing_id().alias("id")).alias("row"), "text")
    kind = f"struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()},held_out:boolean,id:long>"
    out = stored(rows.mapInArrow(_score(shared), f"row {kind}, h long, n long, known long, base double, score double"))
    rare = (
        out.where("h is not null").select(F.col("row.id").alias("r"), "h", "n")
        .join(counts.select(F.col("h").alias("k"), "c").hint("shuffle_hash"), F.col("h") == F.col("k"))
        .groupBy("r").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs"))
    )
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return (
        out.where("h is null").join(rare, F.col("row.id") == F.col("r"), "left")
        .select("row.doc_id", "row.held_out", F.col("n").alias("n_tokens"), (F.col("known") + more).alias("n_known"), F.lit(lexicon.total).cast("long").alias("train_tokens"),
                (F.col("base") + logs - F.col("n") * math.log10(lexicon.total + lexicon.distinct + 1)).alias("base_score"), (F.col("score") + logs).alias("score"))
    )
