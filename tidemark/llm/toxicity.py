"""Toxicity by a bidirectional gated recurrent network with attention pooling, over words and their characters.

A word's input is its own embedding (vocabulary of the training sample) plus the
mean embedding of its character runs (four bytes with edges, hashed), so unknown
spellings have one too.  Windows of ``WINDOW`` words overlap by half; in each the
two directions' states are pooled by attention to one logit.  Every window of
every text is scored; a text's logit is its highest, turned into a probability by
two calibration parameters.

Training is in numpy, by one task (the driver gets the network alone), on a bounded sample of labelled rows
(``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` rows with texts of at most ``SAMPLE_BYTES``
bytes, in the order of a hash of doc_id; every fifth only calibrates, with the
classes weighted as they are among all labels).  Only the texts of labelled documents say which words occur in
toxic ones; the embeddings start from those log-odds.  As a label is about a whole
text, each epoch trains on the window of each text that the network finds most
toxic by then, and a random one of each clean text.

Scoring is a map over the documents: nothing is shuffled, windows are handled in
batches of bounded size, and the network (of fixed size) travels to the workers.

Defined cases: null and blank texts are one empty window.  Labels that are null
or have no document don't train; a document with labels of both kinds trains as
toxic.  With labels of one kind only (or none) every score is the share of toxic
labels (0 without any).  Rows that repeat a doc_id are scored each for itself.
An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Words, mix, release, slices, stored

WINDOW, STRIDE = 32, 16
HIDDEN, DIM = 8, 8
VOCAB, LEAST_DOCS = 30_000, 3
RUN, BUCKETS = 4, 1 << 15
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 1500, 2500, 8192
EPOCHS, BATCH, RATE = 6, 64, 0.01
THRESHOLD = 0.3


def char_runs(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the RUN-byte runs of each word, edges marked by zero bytes, and where each word's begin."""
    data = pa.array([b"\0" + x + b"\0" * (RUN - 1) for x in vocab.cast(pa.binary()).to_pylist()], pa.binary())
    offsets = np.frombuffer(data.buffers()[1], np.int32)[: len(data) + 1].astype(np.int64)
    flat = np.frombuffer(data.buffers()[2], np.uint8)[: offsets[-1]].astype(np.uint64) if len(data) else np.zeros(0, np.uint64)
    code = np.zeros(max(0, len(flat) - RUN + 1), np.uint64)
    for k in range(RUN):
        code = code << np.uint64(8) | flat[k : k + len(code)]
    sizes = np.diff(offsets) - (RUN - 1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    at = offsets[:-1][owner] + np.arange(starts[-1]) - starts[owner]
    return (mix(code[at]) % np.uint64(BUCKETS)).astype(np.int64), starts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters by name (float32), the vocabulary, and the calibration (slope, shift)."""

    def __init__(self, vocab: pa.Array, rng: np.random.Generator) -> None:
        normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.vocab = vocab
        self.p = {"words": normal(len(vocab) + 1, DIM), "runs": normal(BUCKETS, DIM), "v": normal(2 * HIDDEN), "w": normal(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"W{side}": normal(DIM, 3 * HIDDEN) * 3, f"U{side}": normal(HIDDEN, 3 * HIDDEN) * 2, f"b{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.slope, self.shift, self.constant = 1.0, 0.0, None

    def inputs(self, vocab: pa.Array) -> np.ndarray:
        """Embedding of each word of ``vocab``; one more row, of zeros, stands for no word."""
        out = np.zeros((len(vocab) + 1, DIM), np.float32)
        if len(vocab):
            own = pc.fill_null(pc.index_in(vocab, self.vocab), len(self.vocab)).to_numpy(zero_copy_only=False).astype(np.int64)
            for a in range(0, len(vocab), 1 << 15):
                runs, starts = char_runs(vocab[a : a + (1 << 15)])
                out[a : a + len(starts) - 1] = self.inputs_of(own[a : a + (1 << 15)], runs, np.diff(starts))
        return out

    def inputs_of(self, own: np.ndarray, runs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Embeddings of words given by vocabulary codes and the buckets of their runs, ``sizes`` for each."""
        out = np.where((own < len(self.vocab))[:, None], self.p["words"][own], 0)
        return out + np.add.reduceat(self.p["runs"][runs], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None] if len(own) else out

    def _side(self, side: str, gates: np.ndarray, codes: np.ndarray, none: int, states: np.ndarray, saved: list | None = None) -> None:
        """Run one direction; writes the states (windows by time by HIDDEN)."""
        u = self.p[f"U{side}"]
        h = np.zeros((len(codes), HIDDEN), np.float32)
        for t in range(codes.shape[1])[:: 1 if side == "f" else -1]:
            x, hu = gates[codes[:, t]], h @ u
            rz = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            there = (codes[:, t] != none)[:, None]
            if saved is not None:
                saved.append((t, h, r, z, n, hu[:, 2 * HIDDEN :], there))
            h = new if there.all() else np.where(there, new, h)
            states[:, t] = h

    def _pool(self, states: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = states @ self.p["v"]
        e = np.where(there, e, -np.inf)
        top = e.max(1, keepdims=True)
        a = np.where(there, np.exp(e - np.where(np.isfinite(top), top, 0)), 0)
        a /= np.maximum(a.sum(1, keepdims=True), 1e-9)
        return a, np.einsum("bt,bth->bh", a, states)

    def logits(self, inputs: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Logit of each window; ``codes`` index ``inputs``, whose last row is no word."""
        none = len(inputs) - 1
        gates = {side: inputs @ self.p[f"W{side}"] + self.p[f"b{side}"] for side in "fb"}
        out = np.empty(len(codes), np.float32)
        for a in range(0, len(codes), 2048):
            some = codes[a : a + 2048]
            states = np.empty((*some.shape, 2 * HIDDEN), np.float32)
            self._side("f", gates["f"], some, none, states[:, :, :HIDDEN])
            self._side("b", gates["b"], some, none, states[:, :, HIDDEN:])
            out[a : a + 2048] = self._pool(states, some != none)[1] @ self.p["w"] + self.p["c"]
        return out

    def gradients(self, inputs: np.ndarray, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weighted log loss: of the parameters, and of ``inputs``."""
        none, there = len(inputs) - 1, codes != len(inputs) - 1
        states = np.empty((*codes.shape, 2 * HIDDEN), np.float32)
        saved: dict[str, list] = {"f": [], "b": []}
        for k, side in enumerate("fb"):
            gates = inputs @ self.p[f"W{side}"] + self.p[f"b{side}"]
            self._side(side, gates, codes, none, states[:, :, k * HIDDEN : (k + 1) * HIDDEN], saved[side])
        a, pooled = self._pool(states, there)
        error = ((_sigmoid(pooled @ self.p["w"] + self.p["c"]) - labels) * weights / len(codes)).astype(np.float32)
        g = {"w": pooled.T @ error, "c": error.sum(keepdims=True)}
        d_pooled = error[:, None] * self.p["w"]
        d_a = np.einsum("bh,bth->bt", d_pooled, states)
        d_e = a * (d_a - (a * d_a).sum(1, keepdims=True))
        d_states = a[:, :, None] * d_pooled[:, None] + d_e[:, :, None] * self.p["v"]
        g["v"] = np.einsum("bt,bth->h", d_e, states)
        d_inputs = np.zeros_like(inputs)
        for k, side in enumerate("fb"):
            u = self.p[f"U{side}"]
            d_u, d_gates = np.zeros_like(u), np.zeros((len(inputs), 3 * HIDDEN), np.float32)
            d_h = np.zeros((len(codes), HIDDEN), np.float32)
            for t, h, r, z, n, hn, seen in reversed(saved[side]):
                d_h = d_h + d_states[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                d_new = np.where(seen, d_h, 0)
                d_n = d_new * (1 - z) * (1 - n * n)
                d_r = d_n * hn * r * (1 - r)
                d_z = d_new * (h - n) * z * (1 - z)
                d_hu = np.concatenate([d_r, d_z, d_n * r], 1)
                np.add.at(d_gates, codes[:, t], np.concatenate([d_r, d_z, d_n], 1))
                d_u += h.T @ d_hu
                d_h = np.where(seen, d_new * z, d_h) + d_hu @ u.T
            d_gates[-1] = 0
            g |= {f"U{side}": d_u, f"W{side}": inputs.T @ d_gates, f"b{side}": d_gates.sum(0)}
            d_inputs += d_gates @ self.p[f"W{side}"].T
        return g, d_inputs

    def probability(self, logits: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logits), self.constant)
        return _sigmoid(np.clip(self.slope * logits.astype(np.float64) + self.shift, -30, 30))


def windows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of all overlapping windows (len(vocab): no word), and the text of each; a text has at least one."""
    lengths = words.lengths
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(lengths)), n)
    first = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    at = first[:, None] + np.arange(WINDOW)
    inside = at < lengths[text][:, None]
    flat = np.append(words.codes, len(words.vocab))
    return flat[np.where(inside, at + words.starts[:-1][text][:, None], -1)].astype(np.int32), text


def _held_by(texts: np.ndarray, features: np.ndarray, n: int, labels: np.ndarray) -> np.ndarray:
    """How many texts of each class (clean, toxic) hold each feature; pairs may repeat."""
    pairs = np.unique(texts * n + features)
    texts, features = pairs // n, pairs % n
    return np.stack([np.bincount(features, labels[texts] == k, n) for k in (0, 1)])


def _log_odds(held: np.ndarray, share: float, smooth: float = 20.0) -> np.ndarray:
    """Log-odds of the toxic class among texts that hold each feature, towards the mean by ``smooth`` texts."""
    return (np.log((held[1] + smooth * share) / (held[0] + smooth * (1 - share))) - np.log(share / (1 - share))).astype(np.float32)


def _of(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the runs of some words, and how many each has."""
    sizes = starts[which + 1] - starts[which]
    return np.repeat(starts[which], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes


def fit(texts: list[str], labels: np.ndarray, clean_weight: float = 1.0, seed: int = 5) -> Network:
    """Train on texts with labels 0 and 1; a clean text of the sample stands for ``clean_weight`` toxic ones' worth of labels."""
    rest, every = np.arange(len(texts)) % 5 != 4, np.arange(len(texts))
    if min(labels[rest].sum(), (1 - labels[rest]).sum(), labels[~rest].sum(), (1 - labels[~rest]).sum()) < 5:
        return _fit(texts, labels, texts, labels, clean_weight, seed)  # too few to set some apart
    return _fit([texts[k] for k in every[rest]], labels[rest], [texts[k] for k in every[~rest]], labels[~rest], clean_weight, seed)


def top_logits(net: Network, words: Words) -> np.ndarray:
    """The highest logit among each text's windows."""
    codes, text = windows(words)
    top = np.full(len(words.lengths), -np.inf, np.float32)
    np.maximum.at(top, text, net.logits(net.inputs(words.vocab), codes))
    return top


def _fit(texts: list[str], labels: np.ndarray, others: list[str], other_labels: np.ndarray, clean_weight: float, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    words = Words(pa.array(texts, pa.string()))
    owner = np.repeat(np.arange(len(texts)), words.lengths)
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        net = Network(words.vocab[:0], rng)
        net.constant = share
        return net
    docs = np.bincount(np.unique(words.codes * len(texts) + owner) // len(texts), minlength=len(words.vocab))
    often = np.argsort(-docs, kind="stable")[:VOCAB]
    often = often[docs[often] >= LEAST_DOCS]
    net = Network(words.vocab.take(pa.array(often)), rng)
    net.p["words"][:-1, 0] = _log_odds(_held_by(owner, words.codes, len(words.vocab), labels), share)[often]
    runs, starts = char_runs(words.vocab)
    held = np.zeros((2, BUCKETS))
    for a in range(0, len(texts), 128):  # each word's runs, for every text that holds the word
        here = np.unique(words.codes[words.starts[a] : words.starts[min(a + 128, len(texts))]] * len(texts) + owner[words.starts[a] : words.starts[min(a + 128, len(texts))]])
        at, sizes = _of(starts, here // len(texts))
        held += _held_by(np.repeat(here % len(texts), sizes), runs[at], BUCKETS, labels)
    net.p["runs"][:, 1] = _log_odds(held, share)
    own = pc.fill_null(pc.index_in(words.vocab, net.vocab), len(net.vocab)).to_numpy(zero_copy_only=False).astype(np.int64)

    codes, text = windows(words)
    begins = np.concatenate([[0], np.cumsum(np.bincount(text))])
    evidence = np.append(net.inputs(words.vocab)[:-1, :2].sum(1), np.float32(-9))
    score = np.concatenate([np.partition(evidence[some], WINDOW - 2, axis=1)[:, -2:].sum(1) for some in np.array_split(codes, 1 + len(codes) // 4096)])
    moments = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = np.lexsort((-score, text))
        best = order[begins[:-1]]  # the most toxic window of each text
        random = (begins[:-1] + rng.random(len(texts)) * np.diff(begins)).astype(np.int64)
        clean = np.flatnonzero(labels == 0)
        pick = np.concatenate([best, random[clean]])
        weight = np.where(labels[text[pick]] == 1, 1.0, 0.5)
        for rows in np.array_split(rng.permutation(len(pick)), max(1, len(pick) // BATCH)):
            some = codes[pick[rows]]
            used, which = np.unique(some, return_inverse=True)
            which = which.reshape(some.shape)
            real = used[used < len(words.vocab)]
            at, sizes = _of(starts, real)
            inputs = np.zeros((len(real) + 1, DIM), np.float32)
            inputs[:-1] = net.inputs_of(own[real], runs[at], sizes)
            g, d_inputs = net.gradients(inputs, which, labels[text[pick[rows]]], weight[rows])
            g["words"], g["runs"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["runs"])
            np.add.at(g["words"], own[real], d_inputs[:-1])
            np.add.at(g["runs"], runs[at], np.repeat(d_inputs[:-1] / sizes[:, None], sizes, axis=0))
            step += 1
            for k, x in net.p.items():
                m, v = moments[k]
                m += 0.1 * (g[k] - m)
                v += 0.001 * (g[k] * g[k] - v)
                x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        score = net.logits(net.inputs(words.vocab), codes)
    net.slope, net.shift = _calibrated(top_logits(net, Words(pa.array(others, pa.string()))).astype(np.float64), other_labels, np.where(other_labels == 1, 1.0, clean_weight))
    return net


def _calibrated(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression on one variable, by Newton's method."""
    x = np.stack([logits, np.ones_like(logits)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(np.clip(x @ beta, -30, 30))
        gradient = x.T @ (weights * (p - labels)) + 0.1 * (beta - [1, 0])
        beta = beta - np.clip(np.linalg.solve((x.T * (weights * p * (1 - p))) @ x + 0.1 * np.eye(2), gradient), -1, 1)
    return float(max(beta[0], 1e-3)), float(beta[1])


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """Fit on a bounded sample of labelled documents; ``labels`` has doc_id and toxic."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("d")).agg((F.max("toxic") > 0).alias("toxic"))
    # Ids and sizes meet the labels; the texts of the sample alone come after.
    sized = docs.select("doc_id", F.octet_length("text").alias("bytes")).where(F.col("bytes") <= SAMPLE_BYTES)
    rows = stored(sized.join(marked, F.col("doc_id") == F.col("d")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n_toxic, n_clean = rows.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    order = F.xxhash64("doc_id")
    # A share by hash first: no task then has more rows to send than the sample needs.
    share = lambda most, of: F.pmod(order, F.lit(1 << 30)) < int(min(1.0, 4 * most / max(1, of)) * (1 << 30))
    kinds = ((True, SAMPLE_TOXIC, n_toxic), (False, SAMPLE_CLEAN, n_clean))
    chosen = [rows.where((F.col("toxic") == kind) & share(most, of)).orderBy(order, "doc_id").limit(most) for kind, most, of in kinds]
    ids = chosen[0].unionAll(chosen[1]).select(F.col("doc_id").alias("d"), "toxic")  # a bounded number of rows
    sample = docs.where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(ids), F.col("doc_id") == F.col("d")).select("text", "toxic", order.alias("o"), "doc_id")
    sample = sample.orderBy("o", "doc_id", "text").limit(SAMPLE_TOXIC + SAMPLE_CLEAN).select("text", "toxic")  # one partition
    weight = (n_clean / min(n_clean, SAMPLE_CLEAN)) / (n_toxic / min(n_toxic, SAMPLE_TOXIC)) if n_toxic and n_clean else 1.0
    got = sample.mapInArrow(_trained(weight), "network binary").collect()
    return pickle.loads(got[0].network) if got else fit([], np.zeros(0), weight)


def _trained(weight: float):
    """The network, fitted on all rows of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        if texts:
            network = pickle.dumps(fit(texts, np.array(labels, float), weight))
            del texts, labels
            release()
            yield pa.RecordBatch.from_arrays([pa.array([network], pa.binary())], names=["network"])

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in slices(batches, most=2 << 20):
            words = Words(batch.column(1))
            top = top_logits(net, words) if net.constant is None else np.zeros(batch.num_rows, np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.probability(top))], names=["row", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id), held_out, score and predicted of each row; rows that aren't held out may train."""
    keep = keep or ["doc_id"]
    held_out = F.coalesce(held_out, F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.where(~held_out).select("doc_id", "text"), labels))
    rows = docs.select(F.struct(*keep, held_out.alias("__held_out")).alias("row"), "text")
    out = rows.mapInArrow(_score(shared), f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return out.select("row.*", "score").withColumnRenamed("__held_out", "held_out").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.where(~F.coalesce(held_out, F.lit(False))).select("doc_id", "text"), labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _score(shared)
        for batch in slices(batches, most=2 << 20):
            texts = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["row", "text"])
            found = pa.concat_arrays([x.column(1) for x in score(iter([texts]))])
            yield batch.filter(pc.less(found, THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
