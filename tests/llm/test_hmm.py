import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import hmm

DATA = "/root/testdata/sf0.001"


def model(rng, states, symbols):
    start, move, emit = rng.random(states), rng.random((states, states)), rng.random((symbols, states))
    return hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def paths(m, seq):
    """Probability of each state path."""
    for path in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, s in zip(path, path[1:], seq[1:], strict=False):
            p *= m.move[a, b] * m.emit[s, b]
        yield path, float(p)


@pytest.mark.parametrize("run", [1, 2, 3, 9])
def test_forward_and_counts_against_enumeration(run):
    """Whatever the length of the runs that a text is cut into."""
    rng = np.random.default_rng(2)
    m = model(rng, 2, 4)
    seqs = [rng.integers(0, 4, k) for k in (3, 1, 7, 4)]
    flat, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    starts = np.cumsum(lengths) - lengths
    got = hmm.log_likelihoods(m, flat, starts, lengths)
    start, move, emit = hmm.expected_counts(m, flat, lengths, run)
    want_start, want_move, want_emit = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for k, s in enumerate(seqs):
        total = sum(p for _, p in paths(m, s))
        assert got[k] == pytest.approx(math.log10(total), abs=1e-5)
        for path, p in paths(m, s):
            want_start[path[0]] += p / total
            for a, b in zip(path, path[1:], strict=False):
                want_move[a, b] += p / total
            for x, state in zip(s, path, strict=True):
                want_emit[x, state] += p / total
    for a, b in ((start, want_start), (move, want_move), (emit, want_emit)):
        assert a == pytest.approx(b, abs=1e-4)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(3)
    truth = model(rng, 3, 6)
    flat = rng.choice(6, 3000, p=truth.emit[:, 0] / truth.emit[:, 0].sum())
    lengths = np.full(100, 30)
    starts = np.cumsum(lengths) - lengths
    m, last = model(rng, 3, 6), -np.inf
    hmm_prior, hmm.PRIOR = hmm.PRIOR, 0.0
    for _ in range(5):
        now = hmm.log_likelihoods(m, flat, starts, lengths).sum()
        assert now > last - 0.5
        last = now
        m = hmm.Model.of(hmm.expected_counts(m, flat, lengths, 7), np.full(6, 1 / 6))
    hmm.PRIOR = hmm_prior


def test_long_texts_equal_short_steps():
    rng = np.random.default_rng(4)
    m = model(rng, 4, 9)
    seq = rng.integers(0, 9, 20_000)
    alpha, total = None, 0.0
    for s in seq:
        alpha = (m.start if alpha is None else alpha @ m.move.astype(float)) * m.emit[s].astype(float)
        total += math.log10(alpha.sum())
        alpha = alpha / alpha.sum()
    assert hmm.log_likelihoods(m, seq, np.array([0]), np.array([len(seq)]))[0] == pytest.approx(total, rel=1e-6)


def test_training_on_a_long_text_equals_training_uncut():
    rng = np.random.default_rng(5)
    m = model(rng, 5, 30)
    lengths = np.array([4001, 3, 800, 1, 1600])
    flat = rng.integers(0, 30, lengths.sum())
    whole = hmm.expected_counts(m, flat, lengths, 1 << 20)
    for run in (1, 100, 800):
        for a, b in zip(hmm.expected_counts(m, flat, lengths, run), whole, strict=True):
            assert a == pytest.approx(b, rel=2e-3, abs=2e-3)
    assert whole[2].sum() == pytest.approx(lengths.sum(), rel=1e-4) and whole[1].sum() == pytest.approx((lengths - 1).sum(), rel=1e-4)


def test_the_start_divides_texts_by_what_they_hold(monkeypatch):
    """Texts of two vocabularies begin in different states; sums over parts are those of the whole."""
    monkeypatch.setattr(hmm, "NEAR", 20)
    monkeypatch.setattr(hmm, "TEXTS", 7)
    monkeypatch.setattr(hmm, "SYMBOLS", 24)
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 50, 200)
    texts = [rng.integers(0, 12, n) * 2 + k % 2 for k, n in enumerate(lengths)]
    flat, half = np.concatenate(texts), lengths[:100].sum()
    whole = np.concatenate([x.ravel() for x in hmm.moments(flat, lengths)])
    parts = [np.concatenate([x.ravel() for x in hmm.moments(*x)]) for x in ((flat[:half], lengths[:100]), (flat[half:], lengths[100:]))]
    assert sum(parts) == pytest.approx(whole)
    mean, axes = hmm.directions(whole, 2)
    (counts,) = hmm.divided(mean, axes, 2, flat, lengths)
    counts = counts.reshape(24, 2)
    assert counts.sum(1) == pytest.approx(np.bincount(flat, minlength=24))
    own = counts[:20].argmax(1)
    assert len(set(own[::2])) == len(set(own[1::2])) == 1 and own[0] != own[1]


def plain_scores(texts, train, m):
    """The model's log10 probability of each text by the definition, one word after another, in plain Python."""
    counts = Counter(w for t in train for w in t)
    word = {w: int(np.array([xxhash.xxh3_64_intdigest(w)], np.uint64).view(np.int64)[0]) for w in {x for t in texts for x in t} | counts.keys()}
    ranked = sorted(counts, key=lambda w: (-counts[w], word[w]))
    cut = min(c for c in range(1, 256) if sum(n >= c for n in counts.values()) <= hmm.KNOWN)  # words of one count are known or not together
    top = {w: k for k, w in enumerate([w for w in ranked if counts[w] >= cut][: hmm.TOP])}
    kind = lambda w: xxhash.xxh3_64_intdigest(w[::-1][:3]) % hmm.CLASSES
    total, distinct = Counter(), Counter()
    for w in ranked[len(top) :]:
        total[kind(w)] += counts[w]
        distinct[kind(w)] += 1
    out = []
    for t in texts:
        alpha, score = None, 0.0
        for w in [*t, None]:
            s = hmm.SYMBOLS - 1 if w is None else top.get(w, hmm.TOP + kind(w))
            alpha = (m.start.astype(float) if alpha is None else alpha @ m.move.astype(float)) * m.emit[s].astype(float)
            score += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
            if w is not None and w not in top:
                score += math.log10((counts[w] + 1) / (total[kind(w)] + distinct[kind(w)] + 1))
        out.append(score)
    return out


def test_each_score_against_plain_python(make_docs, monkeypatch):
    """Frequent words, words of classes, joined rare words and unknown ones."""
    monkeypatch.setattr(hmm, "KNOWN", 300)
    rng = np.random.default_rng(7)
    texts = [[f"w{int(min(20_000, rng.pareto(0.5) * 9))}" if rng.random() < 0.3 else f"v{rng.integers(20_000)}" for _ in range(int(rng.integers(0, 250)))] for k in range(90)]
    docs = make_docs([(k, " ".join(t), "s") for k, t in enumerate(texts)])
    seen = {}
    trained = hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a, **b: seen.setdefault("m", trained(*a, **b)))
    rows = {r.doc_id: r.score for r in hmm.score_texts(docs, F.col("doc_id") % 3 == 1, passes=2).collect()}
    want = plain_scores(texts, [t for k, t in enumerate(texts) if k % 3 != 1], seen["m"])
    assert [rows[k] for k in range(90)] == pytest.approx(want, rel=1e-5, abs=1e-4)


def held(column="doc_id"):
    return F.crc32(F.col(column).cast("string")) % 7 == 2


def test_scores(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = hmm.score_texts(docs, held()).collect()
    counts = Counter()
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    for i, w in texts.items():
        if not out[i]:
            counts.update([*w, None])
    n, v = sum(counts.values()), len(counts)
    gain = Counter()
    for r in rows:
        w = [*texts[r.doc_id], None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        gain[r.held_out] += r.score - r.base_score
    assert gain[True] > 0 and gain[False] > 0


def test_classes_are_distributions(spark):
    """Each state's emissions sum to 1, and each class leaves its words and one unknown word no more than 1."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text")
    counts = docs.mapInArrow(hmm._count_words, "h long, kind int, c long").groupBy("h", "kind").agg(F.sum("c").alias("c")).cache()
    lexicon = hmm.lexicon_of(counts, docs.count())
    m = hmm.train(docs, lexicon, passes=1)
    assert m.emit.sum(0) == pytest.approx(np.ones(hmm.STATES), abs=1e-3)
    assert m.move.sum(1) == pytest.approx(np.ones(hmm.STATES), abs=1e-5) and m.start.sum() == pytest.approx(1, abs=1e-5)
    rows = counts.collect()
    symbol, _ = lexicon.look_up(np.array([r.h for r in rows]), np.array([r.kind for r in rows]))
    mass = Counter()
    for r, s in zip(rows, symbol, strict=True):
        if s >= hmm.TOP:
            mass[s] += (r.c + 1) / 10 ** lexicon.room[s - hmm.TOP]
    assert all(x + 10 ** -lexicon.room[s - hmm.TOP] == pytest.approx(1, abs=1e-9) for s, x in mass.items())


def test_odd_rows(odd, empty):
    got = hmm.score_texts(odd, held(), passes=1).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1
    assert by[6].n_tokens == 60_001 and by[None].held_out is False
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert hmm.score_texts(empty, held(), passes=1).count() == 0
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in hmm.score_texts(odd, F.lit(True), passes=1).collect())
